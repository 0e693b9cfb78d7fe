"""Counts of candidate phrases: right for repeated and null ids and for frequent phrases, with no table of candidates."""

import math
from collections import Counter, defaultdict

import pytest

from corpusloom.operators import keyphrases as kp


@pytest.mark.parametrize("seen", [10**6, 2, 1])
def test_counts_with_and_without_frequent_phrases(spark, monkeypatch, seen):
    rows = [(1, "red house"), (1, "red house red"), (2, "red door"), (3, "blue sea"), (None, "red sea"), (None, "sea"), (4, None), (5, "")]
    tables, write = [], kp.stage_table
    monkeypatch.setattr(kp, "stage_table", lambda df, label: (tables.append(label), write(df, label))[1])
    monkeypatch.setattr(kp, "HOT_SHARE", 1)
    monkeypatch.setattr(kp, "HOT_SEEN", seen)
    tf = defaultdict(Counter)
    for i, text in rows:
        toks = (text or "").split()
        for n in (1, 2, 3):
            tf[i].update(" ".join(toks[j:j + n]) for j in range(len(toks) - n + 1))
    df, cf = Counter(p for c in tf.values() for p in c), sum(tf.values(), Counter())
    total = sum(text is not None for _, text in rows)
    want = []
    for i, c in tf.items():
        best = sorted((-n * math.log(total / df[p]), p) for p, n in c.items())[:4]
        want += [(i, r, p, pytest.approx(-s), c[p], df[p], cf[p]) for r, (s, p) in enumerate(best, 1)]
    got = kp.tfidf_keyphrases(spark.createDataFrame(rows, "id long, text string"), "id", "text", k=4)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert set(tables) <= {"frequent", "frequent-counts"}  # candidates are not written
