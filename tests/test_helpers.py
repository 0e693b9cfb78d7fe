"""Session / partitioning / scalar helpers and the evaluation workflow."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.ranking import attach_scalars, hash60, ordered_rank, seeded_hash
from corpusloom.plans import workflows as wf
from corpusloom.session import checkpoint_dir, cut_lineage


def test_attach_scalars_is_a_subquery_and_needs_one_row(spark):
    df = spark.range(5)
    out = attach_scalars(df, df.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("mx")))
    assert [(r.id, r.n, r.mx) for r in out.collect()] == [(i, 5, 4) for i in range(5)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Subquery" in plan
    with pytest.raises(Exception):
        attach_scalars(df, df.select("id")).collect()       # more than one row is rejected


def test_ordered_rank_is_the_global_position(spark):
    df = spark.createDataFrame([(v,) for v in ["b", None, "a", "c", "b", "é", "Z"]], "x string")
    got = ordered_rank(df, [F.col("x").asc_nulls_last()]).orderBy("rank").collect()
    assert [r.x for r in got] == ["Z", "a", "b", "b", "c", "é", None] and [r["rank"] for r in got] == list(range(7))


def test_draw_hash_reaches_ranks_beyond_32_bits(spark):
    n = 50 * 2 ** 32
    draws = spark.range(200).select(F.pmod(hash60(seeded_hash(42, "id")), F.lit(n)).alias("r")).collect()
    assert sum(r.r > 2 ** 32 for r in draws) > 150 and all(0 <= r.r < n for r in draws)


def test_cut_lineage_uses_shared_folder(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    c = cut_lineage(df)
    assert checkpoint_dir(spark)
    assert c.agg(F.sum("x")).first()[0] == 90
    assert "FileScan parquet" in c.select("x")._jdf.queryExecution().executedPlan().toString()


def test_evaluate_results_outputs(spark):
    rows = [("1", "t1", "a", "a", 0.9, "b", 0.1), ("2", "t2", "a", "b", 0.6, "a", 0.4),
            ("3", "t3", "b", "ERROR", 0.0, "ERROR", 0.0), ("4", "t4", None, "a", 0.5, None, 0.0)]
    res = spark.createDataFrame(rows, "LensID string, Title string, true_category string, predicted_one string, "
                                      "confidence_one double, predicted_two string, confidence_two double")
    ev = wf.evaluate_results(res)
    n = ev["nulls"].first()
    assert (n.n_rows, n.null_true_category, n.n_after_cleaning) == (4, 1, 2)
    assert ev["accuracy"].first().accuracy == pytest.approx(0.5)
    assert [r.Title for r in ev["top_errors"].collect()] == ["t2"]
    assert ev["confusion"].count() == 4
