"""Keyphrases counted by blocks against brute force: no phrase is shuffled."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from corpusloom.operators import grams
from corpusloom.operators import keyphrases as kp


def _texts(seed, n=90):
    rnd = random.Random(seed)
    words = ["Red", "sea", "ÉTÉ", "x", "the", "of", "hot", "ab", "a", "ſ", "İz", "日本", "7"]
    out = []
    for i in range(n):
        text = "".join(rnd.choice(words) + rnd.choice([" ", ", ", "\n", "-", "_"]) for _ in range(rnd.randint(0, 30)))
        out.append((rnd.choice([i, i, i, 3, None]), text + ("hot dog" if i % 2 else "")))
    return [*out, (n, None), (n + 1, ""), (n + 2, "the of the"), (n + 3, "sea " + "the " * 20000 + "red")]


def _brute(lowered, k, max_words, min_len):
    tf = defaultdict(Counter)
    for i, text in lowered:
        toks = [t for t in re.split(r"[\W_]+", text) if t]
        for n in range(1, max_words + 1):
            for j in range(len(toks) - n + 1):
                if all(t not in kp.STOP_WORDS and len(t) >= min_len for t in toks[j:j + n]):
                    tf[i][" ".join(toks[j:j + n])] += 1
    df, cf = Counter(p for c in tf.values() for p in c), sum(tf.values(), Counter())
    total = len(lowered)
    out = {}
    for i, c in tf.items():
        best = sorted((-n * math.log(total / df[p]), p) for p, n in c.items())[:k]
        out.update({(i, r): (p, pytest.approx(-s), c[p], df[p], cf[p]) for r, (s, p) in enumerate(best, 1)})
    return out


@pytest.mark.parametrize("seed,k,max_words,min_len,chars", [(1, 4, 3, 1, 10**6), (2, 10, 3, 2, 40), (3, 1, 5, 1, 300), (4, 6, 1, 1, 100)])
def test_phrases_match_brute_force(spark, monkeypatch, seed, k, max_words, min_len, chars):
    monkeypatch.setattr(grams, "BLOCK_CHARS", chars)
    docs = spark.createDataFrame(_texts(seed), "id long, text string")
    lowered = [tuple(r) for r in docs.selectExpr("id", "lower(text) t").where("t is not null").collect()]
    got = kp.tfidf_keyphrases(docs, "id", "text", k, max_words, min_len).collect()
    assert len({(r.id, r["rank"]) for r in got}) == len(got)
    assert {(r.id, r["rank"]): (r.phrase, r.score, r.tf, r.df, r.cf) for r in got} == _brute(lowered, k, max_words, min_len)


def test_ids_of_other_types_and_empty_tables(spark):
    rows = [(("a", 1), "red sea"), (("a", 1), "red door"), (("b", None), "sea"), (None, "blue sea")]
    docs = spark.createDataFrame(rows, "id struct<x: string, y: int>, text string")
    got = {(tuple(r.id) if r.id else None, r.phrase): (r.tf, r.df, r.cf) for r in kp.tfidf_keyphrases(docs, "id", "text", 9).collect()}
    assert got == {(("a", 1), "red"): (2, 1, 2), (("a", 1), "sea"): (1, 3, 3), (("a", 1), "door"): (1, 1, 1), (("a", 1), "red sea"): (1, 1, 1),
                   (("a", 1), "red door"): (1, 1, 1), (("b", None), "sea"): (1, 3, 3), (None, "blue"): (1, 1, 1), (None, "sea"): (1, 3, 3),
                   (None, "blue sea"): (1, 1, 1)}
    assert kp.tfidf_keyphrases(docs.limit(0), "id", "text").collect() == []
    assert [(r.phrases, r.keyphrases) for r in kp.extract_keyphrases(docs.where("id is null").selectExpr("1 id", "'the' text"), "id", "text").collect()] == [([], "")]


def test_equal_hashes_of_64_bits_are_told_apart():
    """Two phrases with the same first 64 bits are counted apart by the other 16."""
    import numpy as np
    import pyarrow as pa

    def sent(block, a, b):
        n = len(a)
        first = np.array(a, "uint64")
        return {"_b": block, "bucket": 0, "n": n, "data": grams._pack(np.diff(first, prepend=np.uint64(0)), np.array(b, "uint16"),
                                                                    np.ones(n, "int64"), np.full(n, 2, "int64"))}

    rows = pa.Table.from_pylist([sent(0, [5, 5, 9], [1, 2, 0]), sent(1, [5, 9, 11], [2, 0, 0]), sent(2, [5], [1])])
    got = {r["_b"]: [x.tolist() for x in grams._unpack(r["data"], r["n"], "i8", "i8")] for r in grams._count(rows).to_pylist()}
    assert got == {0: [[1, 1, 1], [2, 2, 2]], 1: [[1, 1, 0], [2, 2, 0]], 2: [[1], [2]]}


def test_no_phrase_is_shuffled(spark):
    docs = spark.createDataFrame([(1, "red sea"), (2, "red door")], "id long, text string")
    plan = kp.tfidf_keyphrases(docs, "id", "text")._jdf.queryExecution().toString()
    assert "hashpartitioning(phrase" not in plan and "hashpartitioning(_b" in plan
    assert plan.count("FlatMapGroupsInArrow") and "Window" not in plan
