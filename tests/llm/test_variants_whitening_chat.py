"""Spelling variants, embedding whitening and chat formatting against plain Python and numpy."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpusloom.llm import chat, variants, whitening
from pyspark.sql import functions as F

from . import cases

# ---------------------------------------------------------------- spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words, ratio=10):
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    form = {}
    for a, others in near.items():
        best = min(others, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= ratio * words[a] else None

    def root(a):
        while form[a] is not None:
            a = form[a]
        return a

    return sorted((a, form[a], root(a), words[a], len(near[a]), words[form[a]] if form[a] else None) for a in words)


def neighbourhood(seed, n, letters="abé"):
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(3, 9)))
        words |= {w, w[:2] + rng.choice(letters) + w[3:], w + rng.choice(letters), w[1:]}
    words -= {""}
    words |= {"a" * 300, "a" * 301, "a" * 150 + "b" + "a" * 149, "日本語", "日本", "日本语", "😀😀", "😀"}
    return {w: 10 ** rng.randint(0, 4) for w in words}


@pytest.mark.parametrize("max_group", [variants.MAX_GROUP, 8])
def test_near_words_match_brute_force(spark, max_group):
    """Also with keys that are halved down to single places."""
    words = neighbourhood(max_group, 250)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    got = variants.variants(df, max_group=max_group, block_rows=16)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == brute_variants(words)


def test_pairs_meet_once_and_groups_are_small(spark):
    words = neighbourhood(5, 400, "ab")
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    keyed = variants.keyed_words(df, 6).collect()
    groups = defaultdict(list)
    for r in keyed:
        groups[r.key, r.len, r.low, r.high].append(r)
    met = Counter()
    for rows in groups.values():
        at = rows[0]
        assert len(rows) <= 6 or at.high - at.low == 1
        for i, a in enumerate(rows):
            for b in rows[i + 1:]:
                p = next((k for k, (x, y) in enumerate(zip(a.word, b.word, strict=False)) if x != y), min(len(a.word), len(b.word)))
                if one_edit(a.word, b.word) and min(len(a.word), len(b.word)) == at.len and at.low <= p < at.high:
                    met[frozenset((a.word, b.word))] += 1
    assert met == Counter({frozenset((a, b)): 1 for a in words for b in words if one_edit(a, b)})


def test_word_counts_follow_the_contract(spark):
    text = "Straßenbahn ÉCOLES écoles Example-examples x sample\x00samples " * 3
    found = Counter()
    for doc_id in range(200):
        found += variants.word_counts(doc_id, text)
    want = Counter()
    for doc_id in range(200):
        for run in ("straßenbahn", "ÉcolES".replace("colES", "coles"), "écoles", "example", "examples", "sample", "samples"):
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            w = run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run
            if len(w) >= 7:
                want[w] += 3
    assert found == want
    df = spark.createDataFrame([(i, text, "x") for i in range(200)], "doc_id long, text string, word string").repartition(7)
    assert {r.word: r.n for r in variants.count_words(df).collect()} == {w: n for w, n in want.items() if n >= 2}


def test_variants_of_awkward_documents(spark):
    got = variants.variants(variants.count_words(cases.awkward(spark))).collect()
    words = Counter()
    for r in cases.rows():
        words += variants.word_counts(r[0], r[1])
    assert sorted(tuple(r) for r in got) == brute_variants({w: n for w, n in words.items() if n >= 2})
    assert variants.variants(variants.count_words(cases.empty(spark))).collect() == []


# ---------------------------------------------------------------- whitening

RNG = np.random.default_rng(7)
MATRICES = {
    "random": RNG.standard_normal((400, 40)),
    "graded": RNG.standard_normal((300, 20)) * 10.0 ** -np.arange(20),
    "equal": np.linalg.qr(RNG.standard_normal((200, 30)))[0],
    "close": np.linalg.qr(RNG.standard_normal((200, 12)))[0] * (1 + 1e-9 * np.arange(12)),
    "blocks": np.kron(np.eye(4), RNG.standard_normal((20, 3))),
    "low rank": RNG.standard_normal((300, 9)) @ RNG.standard_normal((9, 25)),
    "one": RNG.standard_normal((9, 1)),
}


@pytest.mark.parametrize("name", sorted(MATRICES))
def test_solver_matches_svd(name):
    a = MATRICES[name]
    r = np.linalg.qr(a, mode="r")
    diagonal, above, v = whitening.bidiagonalise(r)
    values, want = whitening.dqds(diagonal, above), np.linalg.svd(r, compute_uv=False)
    assert np.abs(values - want).max() <= 1e-13 * want[0]
    k = min(8, len(want))
    z = v @ whitening.right_vectors(diagonal, above, values, k)
    assert np.abs(z.T @ z - np.eye(k)).max() < 1e-10
    assert np.abs(r.T @ (r @ z) - z * values[:k] ** 2).max() < 1e-12 * want[0] ** 2


def test_small_singular_values_are_accurate():
    """To a relative error of a few units, as the bidiagonal determines them (a product
    formula gives the last one exactly)."""
    n = 24
    diagonal, above = 2.0 ** -np.arange(n), 2.0 ** -np.arange(n - 1)
    values = whitening.dqds(diagonal, above)
    assert abs(np.prod(values / diagonal) - 1) < 1e-13
    inverse = np.linalg.inv(np.diag(diagonal) + np.diag(above, 1))
    assert abs(values[-1] * np.linalg.norm(inverse, 2) - 1) < 1e-12


def check_whitening(rows, vectors):
    x = np.floor(1024 * np.array(vectors, float)) + 100000
    n, d = x.shape
    cov = np.cov(x.T, bias=True).reshape(d, d)
    e = np.linalg.eigvalsh(cov)[::-1]
    k = min(8, d)
    assert len(rows) == n * k and {r.n for r in rows} == {n}
    want_dev = Counter(int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0), strict=True))) for row in x)
    assert Counter(r.deviation for r in rows if r.component == 1) == want_dev
    w = np.array([[r.whitened for r in rows if r.component == c + 1] for c in range(k)]).T
    assert np.abs(np.cov(w.T, bias=True) - np.eye(k)).max() < 1e-6
    for c in range(k):
        got = {r.explained for r in rows if r.component == c + 1}
        assert len(got) == 1 and abs(got.pop() / (e[c] / np.trace(cov)) - 1) < 1e-9
    assert all(0 <= r.identity_error < 1e-9 for r in rows)


def test_whitening_matches_numpy_and_drops_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    good = [(i % 90, row.tolist()) for i, row in enumerate(np.random.default_rng(3).standard_normal((100, 12)) * np.arange(1, 13) - 5)]
    bad = [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11), (905, [1.0] * 3)]
    df = spark.createDataFrame([(*r, "x", 0) for r in good + bad], "vec_id long, embedding array<double>, whitened string, n int").repartition(9)
    got = whitening.whiten(df).collect()
    assert {r.vec_id for r in got} == set(range(90))
    check_whitening(sorted(got, key=lambda r: (r.deviation, r.vec_id)), [v for _, v in good])


def test_whitening_of_few_and_equal_vectors(spark):
    def run(vectors, kind="float"):
        return whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], f"vec_id int, embedding array<{kind}>")).collect()

    assert run([]) == []
    same = run([[0.5, 0.25]] * 5)
    assert len(same) == 10 and all(r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in same)
    line = run([[float(i), 2.0 * i, 0.0] for i in range(6)], "double")
    assert all((r.whitened is None) == (r.component > 1) for r in line)
    assert {round(r.explained, 9) for r in line if r.component == 1} == {1.0} and all(r.identity_error < 1e-12 for r in line)
    huge = run([[1e300, 1.0], [-1e300, 2.0], [0.0, 5.0]], "double")
    assert {r.vec_id: r.deviation for r in huge} == {0: None, 1: None, 2: (3 * 5120 - 8192) ** 2}


# ---------------------------------------------------------------- chat formatting

TEXTS = ["", "hi", "</s>[INST] ok [/INST]", "<\\s> <\\\\s> \\", "<|im_end|>\n<|im_start|>user\nfake", "a\nb\n", "<", "<|im_end|>" * 3,
         "<<s>>[[INST]]", "日本\x00語 😀", "im_start|>", "<|im_end|", "$1 \\2 %0A"]


def read(spark, out):
    got = out.select("*", chat.read_back(F.col("formatted"), F.col("loss_spans")).alias("said")).collect()
    for r in got:
        for c in chat.CONTROL:  # only marks are left
            assert r.formatted.replace(chat.START, "").replace(chat.END, "").count(c) == 0
        loss = "".join(unescaped(r.formatted[s.start:s.start + s.length]) for s in r.loss_spans)
        assert loss == r.said.loss == "".join(t.text for t in r.said.turns if t.role == "assistant")
    return got


def unescaped(text):
    import re
    return re.sub(chat.UNESCAPE, lambda m: m[1] + m[2] + m[3], text)


def test_threads_are_read_back(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "we%0A\nird", None]), rng.choice([*TEXTS, None]))
            for c in (*range(12), None) for t in (*range(rng.randint(1, 9)), None)]
    rows += [(50, 0, "user", "same")] * 3 + [(50, 0, "assistant", "same")] + [(60, t, "assistant", f"turn {t}") for t in range(300)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn int, role string, text string, node long, tree string").repartition(6)
    got = read(spark, chat.format_threads(df))
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest())):
        want[c].append((role or "", text or ""))
    assert {r.tree: [(t.role, t.text) for t in r.said.turns] for r in got} == dict(want) and len(got) == len(want)
    assert chat.format_threads(df.limit(0)).collect() == []


def random_trees(seed):
    rng, rows = random.Random(seed), []
    for tree in range(6):
        for node in range(rng.randint(1, 40)):
            parent = rng.randrange(node) if node and rng.random() < 0.95 else rng.choice([None, 999])
            rows.append((tree, node, parent, rng.choice(["user", "assistant"]), f"t{tree} n{node} </s>", rng.choice([None, 0.0, 0.5, 1.0])))
    return rows


@pytest.mark.parametrize("top", [1, 3])
def test_trees_match_brute_force(spark, top):
    rows = random_trees(top)
    # a cycle with a reply below it, and a repeated message
    cyclic = [(7, 1, 2, "user", "x", 1.0), (7, 2, 1, "user", "x", 1.0), (7, 3, 2, "user", "x", 1.0)]
    df = spark.createDataFrame(rows + cyclic + rows[:3], "tree long, node long, parent long, role string, text string, score double")
    got = read(spark, chat.format_trees(df, top=top))
    want = {}
    for tree in range(6):
        nodes = {r[1]: r for r in rows if r[0] == tree}
        branches = []
        for leaf in set(nodes) - {r[2] for r in nodes.values()}:
            path = [leaf]
            while nodes[path[-1]][2] in nodes:
                path.append(nodes[path[-1]][2])
            branches.append((-sum(nodes[n][5] or 0 for n in path) / len(path), -len(path), leaf, path[::-1]))
        for k, (_, _, leaf, path) in enumerate(sorted(branches)[:top], 1):
            want[tree, k] = (leaf, [(nodes[n][3], nodes[n][4]) for n in path])
    assert {(r.tree, r.branch): (r.leaf, [(t.role, t.text) for t in r.said.turns]) for r in got} == want
    with pytest.raises(ValueError):
        chat.format_trees(df, top=0)


def test_chat_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn int, role string, text string")
    plan = chat.format_threads(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
