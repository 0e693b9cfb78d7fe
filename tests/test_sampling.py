"""Exact ranks, splits, caps and bootstrap draws; §5 invariants: train classes
equal in size, test ids never suffixed, seeded reruns identical."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import sampling as sm
from corpusloom.operators.ranking import hash_rank, seeded_hash


def _rows(n=300):
    cats = ["big"] * 200 + ["mid"] * 70 + ["one"] * 1 + ["small"] * 29
    return [(f"id{i}", cats[i % len(cats)]) for i in range(n)]


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_hash_rank_equals_window_rank(spark, bits):
    df = spark.createDataFrame(_rows(), "lens_id string, category string")
    got = {(r.lens_id): r.rank for r in
           hash_rank(df, seeded_hash(7, "lens_id"), by=["category"], tiebreak=["lens_id"],
                     bucket_bits=bits).collect()}
    want = {}
    for c in {c for _, c in _rows()}:
        ids = sorted((hashlib.md5(f"7:{i}".encode()).hexdigest(), i) for i, cc in _rows() if cc == c)
        want.update({i: k for k, (_, i) in enumerate(ids)})
    assert got == want


def test_split_sizes_exact_and_deterministic(spark):
    df = spark.createDataFrame(_rows(), "lens_id string, category string")
    a = sm.split_fraction(df, 0.8, 42)
    assert a.filter(~F.col("is_test")).count() == 240
    b = sm.split_fraction(df, 0.8, 42)
    assert sorted(a.collect()) == sorted(b.collect())


def test_balance_train_invariants(spark):
    df = spark.createDataFrame(_rows(), "lens_id string, category string")
    out = sm.balance_train(df, limit=50, seed=42).cache()
    train = out.filter(~F.col("is_test"))
    sizes = {r.category: r["count"] for r in train.groupBy("category").count().collect()}
    assert len(set(sizes.values())) == 1                       # every class drawn to the largest
    assert train.select("lens_id").distinct().count() == train.count()   # ids made unique
    test = out.filter(F.col("is_test"))
    assert test.filter(F.col("lens_id").contains("_")).count() == 0       # test ids untouched
    orig = {i for i, _ in _rows()}
    assert {r.lens_id.rsplit("_", 1)[0] for r in train.collect()} <= orig
    assert sorted(out.collect()) == sorted(sm.balance_train(df, limit=50, seed=42).collect())


def test_oversample_single_member_class(spark):
    df = spark.createDataFrame(_rows(), "lens_id string, category string")
    o = sm.oversample(df, 3, num_partitions=4)
    one = o.filter(F.col("category") == "one")
    assert one.count() == 200 and one.select("lens_id").distinct().count() == 1
    s = sm.suffix_copies(one, "lens_id", 3)
    assert s.select("lens_id").distinct().count() == 200


def test_undersample_stratified_folds_head(spark):
    df = spark.createDataFrame(_rows(), "lens_id string, category string")
    u = sm.undersample_majority(df, "big", ["mid", "small", "one", "absent"])
    # target = floor((70 + 29 + 1 + 0) / 4) = 25
    assert u.filter(F.col("category") == "big").count() == 25
    assert u.filter(F.col("category") != "big").count() == 100
    f = sm.stratified_folds(df, 5)
    per = {(r.category, r.fold): r["count"] for r in f.groupBy("category", "fold").count().collect()}
    assert per[("big", 0)] == 40
    h = sm.head_n(df.withColumn("n", F.regexp_extract("lens_id", r"\d+", 0).cast("int")), 3, "category", ["n"])
    assert h.count() == 3 + 3 + 1 + 3          # the 'one' class has a single row
    assert sm.stratified_split(df, "category", 0.2).filter("is_test").count() == 40 + 14 + 0 + 6


def test_class_weights_and_rollup(spark):
    df = spark.createDataFrame(_rows(), "lens_id string, category string")
    w = {r.category: r.weight for r in sm.class_weights(df).collect()}
    assert w["big"] == pytest.approx(300 / (4 * 200))
    rc = sm.class_counts(df.withColumn("split", F.lit("train")), ("split", "category")).collect()
    assert any(r.split is None and r.n == 300 for r in rc)
