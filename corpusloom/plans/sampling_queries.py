"""Sampling, balancing and splitting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import sampling as sm
from corpusloom.plans.registry import query
from corpusloom.plans.sql_fixtures import cte, sql
from corpusloom.sources import fixtures as fx

# Labels of the record fixture; 'en' plays the majority class.
MAJORITY = "en"
OTHERS = ("fr", "de", "es")
CAP = 100


def _rec(spark, sf):
    return fx.records(spark, sf).select("lens_id", "category")


def _rk(part: str, seed: str, extra: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"row_number() OVER ({p}ORDER BY md5('{seed}:' || lens_id), lens_id{extra}) - 1"


cte("split80", ("records",), f"""
SELECT lens_id, category, rk >= floor(n * 0.8) AS is_test FROM (
  SELECT lens_id, category, {_rk('', '42', ', category')} AS rk, count(*) OVER () AS n FROM records)""")


def _oversample_sql(src: str) -> str:
    return f"""
r AS (SELECT *, {_rk('category', '42', ', category')} AS rk FROM {src}),
c AS (SELECT category, count(*) AS n FROM {src} GROUP BY category),
m AS (SELECT max(n) AS mx FROM c),
d AS (SELECT category, n, unnest(range(0, mx)) AS draw FROM c, m),
dr AS (SELECT category, draw, (('0x' || substr(md5('42:' || category || ':' || CAST(draw AS VARCHAR)), 1, 15))::BIGINT) % n AS rk FROM d),
o AS (SELECT r.*, dr.draw FROM dr JOIN r ON r.category = dr.category AND r.rk = dr.rk)"""


_SUFFIX = ("lens_id || '_' || CAST(row_number() OVER (PARTITION BY lens_id ORDER BY "
           "md5('42:' || category || ':' || CAST(draw AS VARCHAR)), category, draw) - 1 AS VARCHAR)")


@query("b1_hash_order", sql=sql(["records"], f"""
SELECT lens_id, md5('42:' || lens_id) AS shuffle_key, {_rk('', '42')} AS position FROM records"""))
def b1(spark, sf):
    return sm.hash_order(fx.records(spark, sf).select("lens_id"), 42)


@query("w3_split_fraction", sql=sql(["split80"], "SELECT lens_id, category, is_test FROM split80"))
def w3(spark, sf):
    return sm.split_fraction(_rec(spark, sf), 0.8, 42, tiebreak=["category"])


@query("w5_cap_per_class", sql=sql(["records"], f"""
SELECT lens_id, category FROM (SELECT lens_id, category, {_rk('category', '42:cap')} AS rk FROM records) WHERE rk < {CAP}"""))
def w5(spark, sf):
    return sm.cap_per_class(_rec(spark, sf), CAP)


@query("b2_oversample", sql=sql(["records"], "," + _oversample_sql("(SELECT lens_id, category FROM records)")
                                 + "\nSELECT category, draw, lens_id FROM o"))
def b2(spark, sf):
    return sm.oversample(_rec(spark, sf), 42, tiebreak=["category"]).select("category", "draw", "lens_id")


@query("w2_suffix_copies", sql=sql(["records"], "," + _oversample_sql("(SELECT lens_id, category FROM records)")
                                   + f"\nSELECT {_SUFFIX} AS lens_id, category, draw FROM o"))
def w2(spark, sf):
    o = sm.oversample(_rec(spark, sf), 42, tiebreak=["category"])
    return sm.suffix_copies(o, "lens_id", 42, ("category", "draw")).select("lens_id", "category", "draw")


@query("b3_balance_train", sql=sql(["split80"], f""",
tr AS (SELECT lens_id, category, is_test FROM (
  SELECT *, {_rk('category', '42:cap', ', category')} AS rk FROM split80 WHERE NOT is_test) WHERE rk < {CAP}),
{_oversample_sql('tr')}
SELECT {_SUFFIX} AS lens_id, category, is_test FROM o
UNION ALL SELECT lens_id, category, is_test FROM split80 WHERE is_test"""))
def b3(spark, sf):
    return sm.balance_train(_rec(spark, sf), limit=CAP, seed=42)


@query("b4_undersample_majority", sql=sql(["records"], f""",
t AS (SELECT floor(count(*) FILTER (WHERE category IN ('fr', 'de', 'es')) / 3) AS target FROM records),
maj AS (SELECT lens_id, category, {_rk('', '42')} AS rk FROM records WHERE category = 'en')
SELECT lens_id, category FROM records WHERE category IS DISTINCT FROM 'en'
UNION ALL SELECT lens_id, category FROM maj, t WHERE rk < target"""))
def b4(spark, sf):
    return sm.undersample_majority(_rec(spark, sf), MAJORITY, OTHERS)


def apportioned_sql(source: str) -> str:
    """Rows and test rows of each label of ``source``, by largest remainder."""
    return f"""
SELECT category, n, n - (n * rest) // total - CASE WHEN row_number() OVER (ORDER BY (n * rest) % total DESC, category NULLS FIRST)
       <= rest - sum((n * rest) // total) OVER () THEN 1 ELSE 0 END AS n_test
FROM (SELECT *, sum(n) OVER () AS total, (sum(n) OVER () - ceil(sum(n) OVER () * 0.2))::BIGINT AS rest
      FROM (SELECT category, count(*) AS n FROM {source} GROUP BY category))"""


cte("apportioned", ("records",), apportioned_sql("records"))


@query("b5_apportioned_sizes", sql=sql(["apportioned"], "SELECT category, n, n_test::BIGINT AS n_test FROM apportioned"))
def b5_sizes(spark, sf):
    """Rows and test rows of each label."""
    return sm.apportion(sm.class_sizes(_rec(spark, sf)), 0.2)


@query("b5_stratified_split", sql=sql(["records", "apportioned"], f"""
SELECT r.lens_id, r.category, rk < n_test AS is_test FROM (SELECT lens_id, category, {_rk('category', '42')} AS rk FROM records) r
JOIN apportioned a ON a.category IS NOT DISTINCT FROM r.category"""))
def b5(spark, sf):
    return sm.stratified_split(_rec(spark, sf), "category", 0.2, 42)


@query("b6_sample_n", sql=sql(["records"], f"""
SELECT lens_id, category FROM (SELECT lens_id, category, {_rk('', '42')} AS rk FROM records) WHERE rk < 100"""))
def b6(spark, sf):
    return sm.sample_n(_rec(spark, sf), 100, 42)


@query("b7_head_n", sql=sql(["labelled"], """
SELECT source_file, lens_id FROM (
  SELECT source_file, lens_id, row_number() OVER (PARTITION BY source_file ORDER BY CAST(lens_id AS BIGINT)) AS rn
  FROM labelled) WHERE rn <= 5"""))
def b7(spark, sf):
    lab = fx.labelled(spark, sf).select("source_file", "lens_id")
    return sm.head_n(lab, 5, "source_file", [F.col("lens_id").cast("long")])


@query("b9_stratified_folds", sql=sql(["records"], f"""
SELECT lens_id, category, CAST(({_rk('category', '42')}) % 5 AS INTEGER) AS fold FROM records"""))
def b9(spark, sf):
    return sm.stratified_folds(_rec(spark, sf), 5)


@query("a1_class_counts", sql=sql(["split80"], """
SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS split, category, count(*) AS n
FROM split80 GROUP BY ROLLUP (CASE WHEN is_test THEN 'test' ELSE 'train' END, category)"""))
def a1(spark, sf):
    s = sm.split_fraction(_rec(spark, sf), 0.8, 42, tiebreak=["category"])
    s = s.withColumn("split", F.when(F.col("is_test"), "test").otherwise("train"))
    return sm.class_counts(s, ("split", "category"))


@query("a2_max_class", sql=sql(["records"], "SELECT max(n) AS max_class FROM (SELECT count(*) AS n FROM records GROUP BY category)"))
def a2(spark, sf):
    return sm.max_class(_rec(spark, sf))


@query("a3_mean_class_size", sql=sql(["records"], """
SELECT CAST(floor(count(*) FILTER (WHERE category IN ('fr', 'de', 'es')) / 3) AS BIGINT) AS mean_size FROM records"""))
def a3(spark, sf):
    return sm.mean_class_size(_rec(spark, sf), OTHERS)


@query("a13_class_weights", sql=sql(["records"], """
SELECT category, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM (SELECT category, count(*) AS n FROM records GROUP BY category)"""))
def a13(spark, sf):
    return sm.class_weights(_rec(spark, sf))
