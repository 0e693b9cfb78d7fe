"""Language ID, toxicity, BPE and Katz scores: held-out accuracy, round trips, brute force."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import md5, sha256

import numpy as np
import pytest
import tokenizers
from corpusloom.llm import bpe, katz, lang_id, toxicity
from corpusloom.llm.common import held_out
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from . import cases

SMALL = "/root/testdata/sf0.001/documents.parquet"


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet(SMALL)
    model = lang_id.fit(docs.where("doc_id % 4 <> 0"), sample_per_language=200)
    got = lang_id.identify(docs.where("doc_id % 4 = 0"), model).join(docs, "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()
    odd = {str(r.doc_id): r for r in lang_id.identify(cases.awkward(spark), model).collect()}
    assert len(odd) == len({str(r[0]) for r in cases.rows()})
    assert odd["1"].lang_pred == odd["3"].lang_pred == odd["9"].lang_pred == "und" and odd["9"].score == 0
    assert odd["5"].lang_pred in {"en", "de", "fr", "es"}


def test_language_id_with_few_or_no_labels(spark):
    docs = cases.awkward(spark)
    none = lang_id.fit(docs.where("lang = 'xx'"))
    assert {r.lang_pred for r in lang_id.identify(docs, none).collect()} == {"und"}
    one = lang_id.fit(docs.where("lang = 'de'"))
    assert {r.lang_pred for r in lang_id.identify(docs, one).collect()} == {"de", "und"}
    assert lang_id.identify(cases.empty(spark), one).count() == 0


def test_toxicity_chain(spark):
    bad, plain = ["scum", "loser", "idiots"], [f"word{k}x" for k in range(40)]
    rows = []
    for i in range(240):
        words = [plain[(i * 7 + k * k) % 40] for k in range(30)]
        toxic = i % 3 == 0
        if toxic:
            words[i % 30] = bad[i % 9 // 3]
            if i % 2:
                words[(i + 11) % 30] = bad[(i // 9) % 3]
        rows.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain = toxicity.fit(df.where("doc_id < 200"), ["toxic"], graded=True, folds=2)
    assert chain.categories == ["has_terms", "repeats_terms", "toxic"]
    assert [len(w) for w in chain.weights] == [len(chain.index) + k for k in (1, 2, 3)]
    got = toxicity.score(df.where("doc_id >= 200"), chain).join(df, "doc_id").toPandas()
    assert ((got.p_toxic >= 0.5) == (got.toxic == 1)).all()
    left = toxicity.drop_toxic(df, chain)
    assert left.columns == df.columns and {r.toxic for r in left.collect()} == {0} and left.count() == 160
    odd = toxicity.score(cases.awkward(spark), chain)
    assert odd.count() == len(cases.rows()) and odd.where("p_toxic >= 0.5").count() == 0
    none = toxicity.fit(df.where("doc_id < 0"), ["toxic"], graded=True)
    assert toxicity.score(df, none).agg(F.max("p_toxic")).first()[0] < 0.01


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_tokenizer())


@pytest.fixture(scope="module")
def codec():
    arrays = bpe.read_tokenizer(bpe.default_tokenizer())
    words = [w.encode() for w in "the cat sat on mat and then dog came in from rain word words".split()]
    words += [b" " + w for w in words]
    return bpe.Codec(arrays | bpe.compile_lexicon(words, bpe.Merger(arrays)))


def test_lexicon_is_minimal_and_complete(codec):
    arrays = bpe.read_tokenizer(bpe.default_tokenizer())
    words = sorted({bytes([a, b, c]) for a in b"ab" for b in b"ab" for c in b"xyz"})
    lex = bpe.compile_lexicon(words + words[:2], bpe.Merger(arrays))
    assert len(lex["ends"]) == 4  # one state for each place: all suffixes are shared
    mini = bpe.Codec(arrays | lex)
    assert mini.lookup([*words, b"", b"a", b"abxx", b"q"]).tolist() == [*range(12), -1, -1, -1, -1]
    none = bpe.Codec(arrays | bpe.compile_lexicon([], bpe.Merger(arrays)))
    assert none.lookup([b"a"]).tolist() == [-1]


PIECES = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "the", " the", "'ll", "é", "²", "١", "日本", "😀", "x" * 60,
          "<|endoftext|>", "<|", "_", "́"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=6)), max_size=12).map("".join))
def test_bpe_matches_the_library(library, codec, text):
    text = text.encode("utf-8", "ignore").decode()
    (ids,) = codec.encode([text])
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_bpe_query_form(spark, library):
    df = cases.awkward(spark)
    lexicon = bpe.build_lexicon(df, bpe.default_tokenizer(), lexicon_words=20)
    got = bpe.encode(df, lexicon)
    want = Counter()
    for doc_id, text, *_ in cases.rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[(doc_id, len(ids), np.array(ids, "<u4").tobytes(), text or "")] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got.collect()) == want
    again = {(r.doc_id, r.decoded) for r in bpe.decode(got.select("doc_id", "ids"), lexicon).collect()}
    assert again == {(d, t or "") for d, t, *_ in cases.rows()}
    digest = {r.doc_id: r for r in bpe.digests(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()}
    assert digest[1].ids_sha256 == sha256(b"").hexdigest() and digest[1].n_tokens == 0
    assert bpe.digests(cases.empty(spark)).count() == 0


def test_long_words_merge_like_short_ones():
    merger = bpe.Merger(bpe.read_tokenizer(bpe.default_tokenizer()))
    for word in (b"antidisestablishmentarianism" * 4, b"aaaa" * 40, b"thethethe" * 9):
        ids, n = [int(merger.byte_ids[b]) for b in word], len(word)
        assert n > 48
        while True:
            ranked = [(merger.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merger.rank]
            if not ranked:
                break
            _, i = min(ranked)
            ids[i:i + 2] = [merger.rank[(ids[i], ids[i + 1])][1]]
        assert merger.encode([word])[0].tolist() == ids


def brute_katz(docs, held):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold)), None] for t in docs]
    one, two, after = Counter(), Counter(), Counter()
    for words, out in zip(tokens, held, strict=True):
        if not out:
            before = ["\n", *words[:-1]]
            one.update(words)
            two.update(zip(before, words, strict=True))
            after.update(before)

    def hist(c):
        h = np.zeros(katz.FITTED + 4, np.int64)
        for v in c.values():
            h[min(v, katz.FITTED + 2)] += 1
        return h

    def cut(h, c):
        return float(katz.discounts(h, np.array([c]))[0])

    h1, h2, n = hist(one), hist(two), sum(one.values())
    unknown = 1 - sum(cut(h1, c) * c for c in one.values()) / n if n else 1.0

    def p1(w):
        return cut(h1, one[w]) * one[w] / n if one[w] else unknown

    seen, lower = Counter(), Counter()
    for (h, w), c in two.items():
        seen[h] += cut(h2, c) * c / after[h]
        lower[h] += p1(w)

    def p2(h, w):
        if two[h, w]:
            return cut(h2, two[h, w]) * two[h, w] / after[h]
        return p1(w) * ((1 - seen[h]) / (1 - lower[h]) if after[h] else 1)

    for h in [*list(after)[:20], "never"]:  # every history's probabilities sum to one
        assert sum(p2(h, w) for w in one) + p2(h, "not a word") == pytest.approx(1)
    v = len(one)
    return [(len(ws), sum(one[w] > 0 for w in ws), n, sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws),
             sum(math.log10(p2(h, w)) for h, w in zip(["\n", *ws[:-1]], ws, strict=True))) for ws in tokens]


@pytest.mark.parametrize(("block", "bucket"), [(1 << 21, 1 << 21), (3000, 5000)])
def test_katz_matches_brute_force(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", bucket)
    docs = spark.read.parquet(SMALL).select("doc_id", "text")
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], brute_katz([r.text for r in rows], [
        zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows]), strict=True))
    got = katz.score(docs, held_out(F.col("doc_id"), 10, 0)).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][3:])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)


def test_katz_awkward_and_untrained(spark):
    df = cases.awkward(spark)
    out = held_out(F.col("doc_id"), 10, 0)
    got = sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in katz.score(df, out).collect())
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 10 == 0 for r in cases.rows()]
    want = brute_katz([r[1] for r in cases.rows()], held)
    assert got == sorted((str(r[0]), w[0], round(w[4], 6)) for r, w in zip(cases.rows(), want, strict=True))
    assert {r.score for r in katz.score(df, F.lit(True)).collect()} == {0.0}
    assert katz.score(cases.empty(spark), out).count() == 0


def newton_logistic(x, y, ridge):
    x = np.hstack([x, np.ones((len(x), 1))])
    w, hold = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    hold[-1] = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (p - y) / len(y) + hold * w
        if np.abs(grad).max() < 1e-10:
            break
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(hold + 1e-12), grad)
    return w


def brute_chain(rows, folds, n_features, ridge):
    """Features chosen outside each fold, graded categories, out-of-fold probabilities: all by hand."""
    sets, label = [toxicity.features(t) for _, t, _ in rows], np.array([y for *_, y in rows])
    fold = np.array([int(int(md5(f"fold:{i}".encode()).hexdigest()[:13], 16) / (1 << 52) * folds) for i, *_ in rows])

    def prepare(train):
        n, a = Counter(), Counter()
        for s, y, t in zip(sets, label, train, strict=True):
            if t:
                n.update(s)
                a.update(s if y else ())
        pos, neg = label[train].sum(), (1 - label[train]).sum()

        def gain(f):
            return sum(c * math.log(c / (n[f] * of / (pos + neg))) for c, of in ((a[f], pos), (n[f] - a[f], neg)) if c)

        top = sorted((f for f in n if n[f] >= toxicity.MIN_ROWS), key=lambda f: (-round(gain(f), 9), f))[:n_features]
        terms = {f for f in top if a[f] / n[f] >= toxicity.MIN_TERM_PRECISION}
        hits = np.array([len(terms & s) for s in sets])
        return top, np.array([[f in s for f in top] for s in sets], float), [label * (hits >= 1), label * (hits >= toxicity.REPEATED_TERMS), label]

    made = {k: prepare(fold != k) for k in (*range(folds), -1)}
    earlier, final = np.zeros((len(rows), 0)), []
    for level in range(3):
        q = np.zeros(len(rows))
        for k, (_, x, ys) in made.items():
            full = np.hstack([x, earlier])
            y = ys[level][fold != k]
            rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
            w = newton_logistic(full[fold != k], y, ridge) if len(set(y)) > 1 else np.append(np.zeros(full.shape[1]), math.log(rate / (1 - rate)))
            if k < 0:
                final.append(w)
            else:
                q[fold == k] = 1 / (1 + np.exp(-(full[fold == k] @ w[:-1] + w[-1])))
        earlier = np.column_stack([earlier, q])
    x, probabilities = made[-1][1], np.zeros((len(rows), 0))
    for w in final:
        probabilities = np.column_stack([probabilities, 1 / (1 + np.exp(-(np.hstack([x, probabilities]) @ w[:-1] + w[-1])))])
    return made[-1][0], probabilities


@pytest.mark.parametrize("noise", [0.02, 0.1])  # with much noise no term is precise in some folds
def test_toxicity_chain_matches_brute_force(spark, noise):
    rng = random.Random(11)
    words, bad = [f"{c}{v}{c}" for c in "bdfgklmnprst" for v in "aeiou"], ["zarkon", "quibble", "vexing", "wretch", "zounds"]
    rows = []
    for i in range(240):
        y = int(rng.random() < 0.4)
        rows.append((i, " ".join(rng.choices(words, k=12) + (rng.choices(bad, k=rng.randint(0, 4)) if y or rng.random() < noise else [])), y))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, toxic int, features string").repartition(3)
    chain = toxicity.fit(df, ["toxic"], n_features=25, folds=3, graded=True, ridge=0.02, steps=500)
    vocabulary, want = brute_chain(rows, 3, 25, 0.02)
    assert chain.categories == ["has_terms", "repeats_terms", "toxic"] and set(chain.index) == set(vocabulary)
    got = {r.doc_id: (r.p_has_terms, r.p_repeats_terms, r.p_toxic) for r in toxicity.score(df, chain).collect()}
    assert np.abs(np.array([got[i] for i, *_ in rows]) - want).max() < 5e-3


def test_toxicity_with_few_or_one_sided_labels(spark):
    docs = spark.createDataFrame([(i, "vile vile insult" if i < 4 else f"a kind word {i}") for i in range(40)], "doc_id long, text string")

    def run(labels):
        chain = toxicity.fit_labels(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        return chain, {r.doc_id for r in toxicity.drop_toxic(docs, chain).collect()}

    chain, kept = run([(i, int(i < 4)) for i in range(8)])  # eight labels are enough to tell these apart
    assert chain.informed and kept == set(range(4, 40))
    for labels in ([(i, 1) for i in range(4)], [(i, 0) for i in range(4, 9)], [], [(1, None)], [(999, 1), (998, 0)]):
        chain, kept = run(labels)  # nothing to tell apart: nothing is rejected
        assert not chain.informed and kept == set(range(40))
        verdict = toxicity.score(docs, chain).withColumn("toxic", chain.rejects(F.col("p_toxic")))
        assert verdict.where("toxic").count() == 0 and verdict.count() == 40
    # labels that repeat an id, and rows that do
    again = docs.unionByName(docs.where("doc_id < 8"))
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(8)] * 50, "doc_id long, toxic int")
    chain = toxicity.fit_labels(again, labels)
    assert {r.doc_id for r in toxicity.drop_toxic(again, chain).collect()} == set(range(4, 40))


def test_toxicity_of_awkward_rows(spark):
    df = cases.awkward(spark)
    chain = toxicity.fit_labels(df, spark.createDataFrame([(4, 1), (5, 0), (6, 0), (20, 1), (21, 0), (None, 1)], "doc_id long, toxic int"))
    assert toxicity.score(df, chain).count() == len(cases.rows())
    kept = toxicity.drop_toxic(df, chain)
    assert kept.columns == df.columns and kept.count() <= len(cases.rows())
    none = cases.empty(spark)
    empty = toxicity.fit_labels(none, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert toxicity.score(none, empty).count() == 0 and toxicity.drop_toxic(df, empty).count() == len(cases.rows())


def test_family_codes():
    of = lang_id.family_of
    assert of("en") == of("eng") == of("de-AT") == of("sv_SE") == "germanic" and of("spa") == of("pt-BR") == "romance"
    assert of("tgl") == of("fil") == of("hil") == "austronesian" and of("swe") == "germanic" and of("fin") == "uralic"
    assert of("xx") == "xx" and of("zh-Hant") == "zh-Hant"


def test_language_votes_match_a_plain_count(spark):
    """Family by the greatest margin, then every pair of its languages votes."""
    model = lang_id.fit(spark.read.parquet(SMALL))
    rows = spark.read.parquet(SMALL).select("doc_id", "text").collect()
    got = {r.doc_id: r for r in lang_id.identify(spark.read.parquet(SMALL), model).collect()}
    for doc_id, text in rows[:120]:
        x = lang_id.features(text or "")
        if x is None:
            assert got[doc_id].lang_pred == "und"
            continue
        x = np.append(x, 1.0)
        margins = {f: model.family_weights[k] @ x for k, f in enumerate(model.names)}
        family = max(margins, key=margins.get) if len(margins) > 1 else model.names[0]
        votes = Counter(a if model.pair_weights[k] @ x >= 0 else b for k, (a, b) in enumerate(model.pairs) if a in model.families[family])
        most = max(votes.values(), default=0)
        assert got[doc_id].family_pred == family
        assert got[doc_id].lang_pred in ([lang for lang, v in votes.items() if v == most] or model.families[family])
        assert 0 <= got[doc_id].score <= 1
