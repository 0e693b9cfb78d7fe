"""License scan, quality rules and syncmers against plain Python."""

import itertools
import random
import re
import struct
from collections import Counter
from hashlib import sha256
from string import ascii_lowercase

import pytest
import regex
import xxhash
from corpusloom.llm import license_scan, quality, syncmers
from corpusloom.llm.common import let
from pyspark.sql import functions as F

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    under = {k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(under))


def test_quality_counts_match_brute_force(spark):
    df = cases.awkward(spark)
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
                 for r in quality.quality(df).collect())
    want = []
    for doc_id, text, *_ in cases.rows():
        c = counts(text)
        want.append((str(doc_id), *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert [g[:-1] for g in got] == sorted(want)
    assert all(not (g[-1] and g[-2]) for g in got)


def test_quality_rejects_symbols_and_keeps_prose(spark):
    prose = [(i, " ".join(f"the w{i * 1000 + k} of" for k in range(120)), "en", "s", 1) for i in range(40)]
    junk = [(99, " ".join(f"w{k}#$% ***" for k in range(150)), "en", "s", 1)]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(prose + junk, cases.SCHEMA)).collect()}
    assert not got.pop(99) and all(got.values())


def test_quality_rejects_gibberish_and_wrong_languages(spark):
    rng = random.Random(7)

    def word(n):
        return "".join(rng.choices(ascii_lowercase, k=n))

    common = {x: [word(3) for _ in range(quality.COMMON_WORDS)] for x in ("en", "de")}
    rare = {x: [word(6) for _ in range(5000)] for x in ("en", "de")}

    def prose(lang):  # common words hold 28% of the words
        return " ".join(rng.choice((common if rng.random() < 0.28 else rare)[lang]) for _ in range(400))

    clean = [(i, prose(x), x, "s", 1) for i, x in enumerate(["en", "de"] * 100)]
    junk = [(1000 + i, " ".join(word(rng.choice((3, 6, 6))) for _ in range(500)), "en", "s", 1) for i in range(3)]
    wrong = [(2000 + i, prose("en"), "de", "s", 1) for i in range(3)]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(clean + junk + wrong, cases.SCHEMA)).collect()}
    assert {i for i, kept in got.items() if not kept} == {x[0] for x in junk + wrong}


@pytest.mark.parametrize("share", [0.15, 0.22, 0.28])
def test_quality_limit_follows_the_language(spark, share):
    """Gibberish fails and prose stays, however many words of a language its common words hold."""
    rng = random.Random(int(share * 100))

    def word(n):
        return "".join(rng.choices(ascii_lowercase, k=n))

    common, rare = [word(3) for _ in range(quality.COMMON_WORDS)], [word(6) for _ in range(20000)]
    clean = [(i, " ".join(rng.choice(common if rng.random() < share else rare) for _ in range(400)), "en", "s", 1) for i in range(200)]
    junk = [(1000 + i, " ".join(word(rng.choice((4, 6, 7))) for _ in range(500)), "en", "s", 1) for i in range(3)]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(clean + junk, cases.SCHEMA)).collect()}
    assert {i for i, kept in got.items() if not kept} == {x[0] for x in junk}


def test_js_distance(spark):
    r = spark.range(1).select(
        quality.js_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(5.0))).alias("far"),
        quality.js_distance(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(2.0), F.lit(6.0))).alias("same"),
        quality.js_distance(F.array(F.lit(0.0)), F.array(F.lit(2.0))).alias("none")).first()
    assert r.far == pytest.approx(1.0) and r.same == pytest.approx(0.0, abs=1e-7) and r.none is None


def brute_license(text, threshold=license_scan.THRESHOLD):
    best, n = None, 0
    gap = re.compile(r"\n(?:[ \t\x0b-\r]*\n)+")
    parts = (text or "").split("\n") + [p for p in gap.split(text or "") if "\n" in p] + ([text] if gap.search(text or "") else [])
    for part in parts:
        words = re.sub(r"[\W_]+", " ", part.lower()).split()
        if len(part) <= 2 or len(words) < 2:
            continue
        a, found = set(zip(words, words[1:], strict=False)), []
        for name, texts in license_scan.TEMPLATES.items():
            for t in texts:
                ws = license_scan.template_words(t)
                b = set(zip(ws, ws[1:], strict=False))
                dice = 2 * len(a & b) / (len(a) + len(b))
                if dice >= threshold:
                    found.append((-dice, name))
        if found:
            n += 1
            best = min(found + ([best] if best else []))
    return (best[1] if best else None, -best[0] if best else 0.0, n)


def brute_windows(text, threshold=license_scan.THRESHOLD):
    """Every window of every template's size, compared."""
    ws = regex.sub(r"[^\p{L}\p{N}]+", " ", (text or "").lower()).split()
    bs, out = [" ".join(p) for p in zip(ws, ws[1:], strict=False)], []
    for name, texts in license_scan.TEMPLATES.items():
        for t in texts:
            tw = license_scan.template_words(t)
            own, m = {" ".join(p) for p in zip(tw, tw[1:], strict=False)}, len(tw) - 1
            dice = [2 * len(own & w) / (len(own) + len(w)) for w in (set(bs[i:i + m]) for i in range(len(bs) - m + 1))]
            if dice and max(dice) >= threshold:
                out.append((-max(dice), name))
    return sorted(out)


def test_licenses_within_prose_on_one_line_and_in_comments(spark):
    t = license_scan.TEMPLATES
    prose = "this helper was rewritten last year and nobody has looked at it since then so take care "
    texts = {
        "one line": (" ".join(t["MIT"][2].split()), "MIT"),
        "one line among others": (prose * 3 + t["MIT"][2] + prose * 2, "MIT"),
        "short notice in prose": (prose + "Released under the MIT License. " + prose, "MIT"),
        "cc in prose": ("Some prose. Licensed under CC BY 4.0. More prose", "CC-BY-4.0"),
        "comment header": ("/*\n * Copyright A\n *\n * " + t["GPL-3.0"][1].replace(" or ", "\n * or ") + "\n *\n */\nint main", "GPL-3.0"),
        "hash header": ("# " + t["Apache-2.0"][1].replace("; ", ";\n#\n# ") + "\nimport os\n" + prose, "Apache-2.0"),
        "two licences": (t["ISC"][0] + " " + prose + t["Zlib"][0], "ISC"),
        "small edits": (prose + t["BSD"][2].replace("copyright holder nor", "Example Company nor").replace("2.", "b)") + prose, "BSD"),
        "words of it only": ("software permission copyright license conditions warranty " * 30, None),
        "prose": (prose * 20, None),
        "repeats": ("the license MIT and the license under MIT released " * 40, None),
        "none": (None, None),
    }
    df = spark.createDataFrame([(k, v[0], "x") for k, v in texts.items()], "doc_id string, text string, windows string")
    for r in license_scan.scan(df).collect():
        text, want = texts[r.doc_id]
        best = brute_windows(text)
        assert r.license == want, r.doc_id
        assert r.n_windows == len(best), r.doc_id
        if best:
            assert r.dice >= -best[0][0] - 1e-12


def test_needed_words_are_in_every_match():
    for texts in license_scan.TEMPLATES.values():
        for t in texts:
            ws = license_scan.template_words(t)
            bigrams = set(zip(ws, ws[1:], strict=False))
            need = license_scan.needed_words(ws, 0.8)
            assert need and sum(not set(b) & set(need) for b in bigrams) < license_scan.least_shared(len(bigrams), 0.8)
            few = set(license_scan.needed_bigrams(ws, 0.8))
            assert few and len(bigrams - few) < license_scan.least_shared(len(bigrams), 0.8)
    # the bound itself: fewer shared bigrams never reach the threshold, whatever the window
    assert all(2 * (license_scan.least_shared(a, 0.8) - 1) / (a + license_scan.least_shared(a, 0.8) - 1) < 0.8 for a in range(1, 400))


def test_license_scan_matches_brute_force(spark):
    mit = license_scan.TEMPLATES["MIT"][1]
    texts = [None, "", "x", "Some prose.\nReleased under the MIT license\nmore prose", mit.replace(", ", ",\n"),
             "Copyright A\n\n" + mit + "\n\nlicensed under cc by nc 4.0", "Released under the MIT",
             "LICENSED under the apache license version 2.0", "the the the " * 5000,
             "Licensed under the Apache License, Version 2.0. \t\n \nLicensed under the GNU General Public License, version 3."]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    for r in license_scan.scan(df).collect():
        want = brute_license(texts[r.doc_id])
        assert (r.license, pytest.approx(r.dice), r.n_matches) == want, texts[r.doc_id]
    assert license_scan.scan(cases.awkward(spark)).count() == len(cases.rows())
    # a text is lower-cased once, not once for each word that is sought in it
    plan = license_scan.scan(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") < 10


def test_syncmer_edits_and_order(spark):
    df = cases.awkward(spark)
    got = syncmers.fingerprint_edits(df).collect()
    assert len(got) == len(cases.rows())
    unique = [(7, "a b c d e f g h i j"), (3, "k l m n o p"), (9, None), (5, "x y z " * 200)]
    found = {r.doc_id: r for r in syncmers.fingerprint_edits(
        spark.createDataFrame([(*u, 1) for u in unique], "doc_id long, text string, range int")).collect()}
    ordered = sorted(unique, reverse=True)
    for k, (doc_id, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        r = found[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1)


def test_syncmer_likeness_of_long_texts_is_exact(spark):
    shared = [f"s{i}" for i in range(150)]
    texts = {i: " ".join([f"t{i}w{k}" for k in range(2000)] + shared + [f"t{i}v{k}" for k in range(2000)]) for i in range(3)}
    texts[3] = texts[2] + " and more"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    edited = {}
    for i, text in texts.items():
        cut = len(text) // 3
        edited[i] = text[:len(text) - cut] + texts[(i - 1) % 4][:cut]
    both = spark.createDataFrame([(i, texts[i], edited[i]) for i in texts], "doc_id long, text string, edited string")
    sets = {r.doc_id: ({x.hash for x in r.a}, {x.hash for x in r.b}) for r in both.select(
        "doc_id", syncmers.anchors(F.col("text")).alias("a"), syncmers.anchors(F.col("edited")).alias("b")).collect()}
    got = {r.doc_id: r for r in syncmers.fingerprint_edits(df).collect()}
    for i, (a, b) in sets.items():
        after = sets[(i - 1) % 4][0]
        assert len(a) > 10 * syncmers.SKETCH
        assert got[i].near_edited == pytest.approx(len(a & b) / len(a | b))
        assert got[i].near_next == pytest.approx(len(a & after) / len(a | after)) and got[i].near_next > 0
        low = sorted(x - (1 << 64) if x >> 63 else x for x in a)[:syncmers.SKETCH]
        assert got[i].sketch == "".join(f"{x % (1 << 64):016x}" for x in low)
    assert len({r.fingerprint for r in got.values()}) == 4


def test_syncmers_are_context_free_and_dense(spark):
    words = [f"w{i % 190}" for i in range(200)]
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(["new", "start"] + words))], "doc_id long, text string")
    a, b = (r.a for r in df.select("doc_id", syncmers.anchors(F.col("text")).alias("a")).orderBy("doc_id").collect())
    assert {(x.hash, x.pos + 2) for x in a} <= {(x.hash, x.pos) for x in b}
    at = [x.pos for x in a]
    assert max(y - x for x, y in zip(at, at[1:], strict=False)) <= syncmers.K - syncmers.S + 1
    two = df.agg(F.collect_list(F.struct("doc_id", syncmers.anchors(F.col("text")).alias("a"))).alias("x"))
    pairs = two.select(syncmers.aligned(F.filter("x", lambda r: r["doc_id"] == 0)[0]["a"],
                                        F.filter("x", lambda r: r["doc_id"] == 1)[0]["a"]).alias("p")).first().p
    once = Counter(x.hash for x in a)
    assert pairs and all(p.b_pos == p.a_pos + 2 for p in pairs) and len(pairs) == sum(v == 1 for v in once.values())


def test_empty_tables(spark):
    none = cases.empty(spark)
    assert license_scan.scan(none).count() == 0
    assert quality.quality(none).count() == 0
    assert syncmers.fingerprint_edits(none).count() == 0


def test_let_evaluates_in_nested_lambdas(spark):
    r = spark.range(3).select(F.transform(F.array(F.lit(1), F.lit(2)), lambda x: let(x + F.col("id"), lambda y: y * y)).alias("v"))
    assert [list(x.v) for x in r.orderBy("v").collect()] == [[1, 4], [4, 9], [9, 16]]


def test_three_words_have_an_anchor(spark):
    """Texts whose only k-mer is not closed had no anchors: one fingerprint for all of them, and a division by zero."""
    rows = [(i, " ".join(p)) for i, p in enumerate(itertools.permutations("abcdef", 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert df.where(F.size(syncmers.anchor_set(F.col("text"))) != 1).count() == 0
    assert df.where(F.size(syncmers.anchors(F.col("text"))) != 1).count() == 0
    got = syncmers.fingerprint_edits(df).collect()
    assert len(got) == len(rows) == len({r.fingerprint for r in got})
    assert all(r.near_next == 0.0 and r.near_edited == float(r.fingerprint == r.edited_fingerprint) for r in got)


def test_syncmers_of_string_ids(spark):
    rows = [(f"id {i:03d}", f"the text of number {i} goes on with words {i * 7} and more") for i in range(60)] + [(None, "no id"), ("id 007", "again")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    got = {(r.doc_id, r.n_chars): r for r in syncmers.fingerprint_edits(df).collect()}
    assert len(got) == len(rows)
    order = sorted((r for r in rows if r[0]), key=lambda r: r[0], reverse=True)
    texts = dict(rows)
    for (a, x), (b, y) in zip(order, order[1:], strict=False):
        if a != b and "id 007" not in (a, b):
            cut = len(x) // 3
            assert got[a, len(x)].edited_sha256 == sha256((x[:len(x) - cut] + y[:cut]).encode()).hexdigest()
    assert texts and syncmers.fingerprint_edits(df.limit(0)).count() == 0


def spark_hash(*values):
    """XXH64, each value with the hash of those before as seed; numbers as 8 bytes."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), h % (1 << 64))
        h = h - (1 << 64) if h >> 63 else h
    return h


def slow_anchors(text):
    tokens = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(tokens) < 3:
        return [spark_hash(" ".join(tokens) if tokens else text or "")]
    h = [spark_hash(w) for w in tokens]
    closed = [i for i in range(len(h) - 2) if min(h[i:i + 3]) in (h[i], h[i + 2])]
    return sorted({spark_hash(*h[i:i + 3]) for i in closed})


def test_fingerprints_match_plain_syncmers(spark):
    texts = [r[1] for r in cases.rows() if len(r[1] or "") < 40000] + [" ".join(random.Random(i).choices(["a", "B", "ç", "dd"], k=i)) for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in syncmers.fingerprint_edits(df).collect()}
    for i, text in enumerate(texts):
        after = texts[i - 1] if i else texts[-1]  # the next one in descending order of ids
        text, after = text or "", after or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        own, changed, beside = map(slow_anchors, (text, edited, after))
        assert got[i].fingerprint == sha256(",".join(map(str, own)).encode()).hexdigest()
        assert got[i].edited_fingerprint == sha256(",".join(map(str, changed)).encode()).hexdigest()
        jaccard = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
        assert got[i].near_edited == pytest.approx(jaccard(own, changed)) and got[i].near_next == pytest.approx(jaccard(own, beside))
