"""Evaluation queries (P16-P18, J4, A5-A11, A14, A15, T1, T2, T4, W6) over the
prediction table derived from the model responses (FB9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import metrics as mt
from corpusloom.operators import sampling as sm
from corpusloom.operators import scoring as so
from corpusloom.plans.sampling_queries import apportioned_sql  # (and the split80 CTE)
from corpusloom.plans.registry import query
from corpusloom.plans.sql_fixtures import cte, sql
from corpusloom.sources import fixtures as fx

# The class labels of the vector fixture, in order.
VECTOR_LABELS = ("c1", "c2", "c3", "c4", "c5")


def predictions(spark, sf):
    """FB9: result rows of the responses (P12-P15), keyed by ``vec_id``."""
    r = fx.responses(spark, sf).select(F.col("vec_id").cast("string").alias("LensID"),
                                       F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("Title"),
                                       "true_category", "response")
    out = so.to_result_rows(r)
    return out.select(F.col("LensID").cast("long").alias("vec_id"), F.col("Title").alias("title"),
                      "true_category", "predicted_one", "confidence_one", "predicted_two", "confidence_two")


def valid(spark, sf):
    return mt.with_correct(mt.valid_predictions(predictions(spark, sf)))


@query("p16_valid_predictions", sql=sql(["valid_pred"], """
SELECT vec_id, true_category, predicted_one, confidence_one FROM valid_pred"""))
def p16(spark, sf):
    return mt.valid_predictions(predictions(spark, sf)).select("vec_id", "true_category", "predicted_one",
                                                               "confidence_one")


@query("p17_with_correct", sql=sql(["valid_pred"], "SELECT vec_id, is_correct FROM valid_pred"))
def p17(spark, sf):
    return valid(spark, sf).select("vec_id", "is_correct")


@query("p18_class_predicates", sql=sql(["records", "split80"], """
SELECT 'majority' AS predicate, category = 'en' AS value, count(*) AS n FROM records GROUP BY 2
UNION ALL SELECT 'test', is_test, count(*) FROM split80 GROUP BY 2"""))
def p18(spark, sf):
    """Majority vs rest and test vs train row counts (the two predicates)."""
    r = fx.records(spark, sf)
    maj = (r.groupBy((F.col("category") == "en").alias("value")).agg(F.count(F.lit(1)).alias("n"))
           .select(F.lit("majority").alias("predicate"), "value", "n"))
    s = sm.split_fraction(r.select("lens_id", "category"), 0.8, 42, tiebreak=["category"])
    tt = (s.groupBy(F.col("is_test").alias("value")).agg(F.count(F.lit(1)).alias("n"))
          .select(F.lit("test").alias("predicate"), "value", "n"))
    return maj.unionByName(tt)


@query("t3_top_two_from_vector", sql=sql(["scores5"], """,
p AS (SELECT vec_id, i, (s + 1) / (tot + 5) AS prob FROM (
        SELECT vec_id, s1 + s2 + s3 + s4 + s5 AS tot, s1, s2, s3, s4, s5 FROM scores5)
      UNPIVOT (s FOR col IN (s1, s2, s3, s4, s5)) u, LATERAL (SELECT CAST(substr(col, 2) AS INTEGER) AS i)),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, i DESC) AS rk FROM p)
SELECT vec_id, max(CASE WHEN rk = 1 THEN 'c' || i END) AS predicted_one, max(CASE WHEN rk = 1 THEN prob END) AS confidence_one,
       max(CASE WHEN rk = 2 THEN 'c' || i END) AS predicted_two, max(CASE WHEN rk = 2 THEN prob END) AS confidence_two
FROM r GROUP BY vec_id"""))
def t3(spark, sf):
    """Top-2 classes of a probability vector (smoothed score shares); an exact
    tie favours the later class."""
    from corpusloom.functions.scores import top_two_from_vector
    r = fx.responses(spark, sf)
    tot = sum(F.col(f"s{i}") for i in range(1, 6))
    probs = F.array(*[(F.col(f"s{i}") + 1) / (tot + 5) for i in range(1, 6)])
    t = top_two_from_vector(probs, F.array(*[F.lit(c) for c in VECTOR_LABELS]))
    return r.select("vec_id", t["k1"].alias("predicted_one"), t["v1"].alias("confidence_one"),
                    t["k2"].alias("predicted_two"), t["v2"].alias("confidence_two"))


@query("j4_align", sql=sql(["predictions", "vectors"], """
SELECT p.vec_id, v.category AS true_category, p.predicted_one FROM predictions p JOIN vectors v ON v.vec_id = p.vec_id"""))
def j4(spark, sf):
    p = predictions(spark, sf).select("vec_id", "predicted_one")
    t = fx.vectors(spark, sf).select("vec_id", F.col("category").alias("true_category"))
    return mt.align(p, t, "vec_id")


@query("a5_accuracy", sql=sql(["valid_pred"], """
SELECT avg(CAST(is_correct AS DOUBLE)) AS accuracy, count(*) AS n FROM valid_pred"""))
def a5(spark, sf):
    return mt.accuracy(valid(spark, sf))


_REPORT = """,
t AS (SELECT true_category AS label, count(*) AS support, count(*) FILTER (WHERE is_correct) AS tp FROM valid_pred GROUP BY 1),
p AS (SELECT predicted_one AS label, count(*) AS n_pred FROM valid_pred GROUP BY 1),
c AS (SELECT coalesce(t.label, p.label) AS label, coalesce(support, 0) AS support, coalesce(n_pred, 0) AS n_pred,
             coalesce(tp, 0) AS tp FROM t FULL JOIN p ON t.label = p.label),
per AS (SELECT label, support, CASE WHEN n_pred <> 0 THEN tp / n_pred ELSE 0.0 END AS precision,
               CASE WHEN support <> 0 THEN tp / support ELSE 0.0 END AS recall FROM c),
per2 AS (SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM per)
SELECT label, precision, recall, f1, support FROM per2
UNION ALL SELECT 'accuracy', NULL, NULL, (SELECT count(*) FILTER (WHERE is_correct) / count(*) FROM valid_pred),
                 (SELECT count(*) FROM valid_pred)
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per2
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per2"""


@query("a6_classification_report", sql=sql(["valid_pred"], _REPORT))
def a6(spark, sf):
    return mt.classification_report(valid(spark, sf))


@query("a7_confusion_matrix", sql=sql(["valid_pred"], """,
l AS (SELECT DISTINCT true_category AS x FROM valid_pred UNION SELECT DISTINCT predicted_one FROM valid_pred),
n AS (SELECT true_category AS actual, predicted_one AS predicted, count(*) AS n FROM valid_pred GROUP BY 1, 2)
SELECT a.x AS actual, b.x AS predicted, coalesce(n.n, 0) AS n FROM l a, l b
LEFT JOIN n ON n.actual = a.x AND n.predicted = b.x"""))
def a7(spark, sf):
    return mt.confusion_matrix(valid(spark, sf))


@query("a7_confusion_fixed_labels", sql=sql(["valid_pred"], """,
l AS (SELECT unnest(['c1', 'c2', 'c3', 'c4', 'c5']) AS x),
n AS (SELECT true_category AS actual, predicted_one AS predicted, count(*) AS n FROM valid_pred GROUP BY 1, 2)
SELECT a.x AS actual, b.x AS predicted, coalesce(n.n, 0) AS n FROM l a, l b
LEFT JOIN n ON n.actual = a.x AND n.predicted = b.x"""))
def a7_fixed(spark, sf):
    return mt.confusion_matrix(valid(spark, sf), labels=VECTOR_LABELS)


@query("a8_confidence_by_correct", sql=sql(["valid_pred"], """
SELECT is_correct, avg(confidence_one) AS mean_confidence FROM valid_pred GROUP BY 1"""))
def a8(spark, sf):
    return mt.confidence_by_correct(valid(spark, sf))


@query("a9_confidence_histogram", sql=sql(["valid_pred"], """
SELECT is_correct, bin, n, n / sum(n) OVER (PARTITION BY is_correct) AS density FROM (
  SELECT is_correct, CAST(least(floor(confidence_one * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM valid_pred GROUP BY 1, 2)"""))
def a9(spark, sf):
    return mt.confidence_histogram(valid(spark, sf), bins=20)


cte("auto_bins", ("valid_pred",), """
SELECT lo, hi - lo AS spread, CASE WHEN hi > lo THEN ceil((hi - lo) / CASE WHEN iqr > 0 THEN least(2 * iqr / n ** (1.0 / 3), (hi - lo) / (log2(n) + 1))
       ELSE (hi - lo) / (log2(n) + 1) END) ELSE 1 END::BIGINT AS n_bins
FROM (SELECT count(*) AS n, min(confidence_one)::DOUBLE AS lo, max(confidence_one)::DOUBLE AS hi,
             (quantile_cont(confidence_one::DOUBLE, 0.75) - quantile_cont(confidence_one::DOUBLE, 0.25)) AS iqr FROM valid_pred)""")


@query("a9_automatic_bins", sql=sql(["auto_bins"], "SELECT lo, spread / n_bins AS width, n_bins FROM auto_bins"))
def a9_bins(spark, sf):
    """Bins of the confidences from the data."""
    return mt.automatic_bins(valid(spark, sf), "confidence_one")


@query("a9_automatic_histogram", sql=sql(["valid_pred", "auto_bins"], """
SELECT is_correct, bin, lo + bin * (spread / n_bins) AS left, n, n / sum(n) OVER (PARTITION BY is_correct) / (spread / n_bins) AS density
FROM (SELECT is_correct, least(floor((confidence_one - lo) / (spread / n_bins)), n_bins - 1)::BIGINT AS bin, count(*) AS n FROM valid_pred, auto_bins GROUP BY 1, 2), auto_bins"""))
def a9_auto(spark, sf):
    """Histogram of right and wrong confidences over these bins."""
    return mt.automatic_histogram(valid(spark, sf), "confidence_one", "is_correct")


@query("a9_density_curve", sql=sql(["valid_pred"], """,
g AS (SELECT is_correct, count(*) AS n, stddev_samp(confidence_one) * count(*) ** -0.2 AS h FROM valid_pred GROUP BY 1),
r AS (SELECT min(confidence_one) AS lo, max(confidence_one) AS hi FROM valid_pred),
p AS (SELECT point::INTEGER AS point, lo + point * (hi - lo) / 199 AS x FROM r, range(200) t(point))
SELECT g.is_correct, p.point, p.x, sum(exp(-0.5 * ((p.x - v.confidence_one) / g.h) * ((p.x - v.confidence_one) / g.h))) / (any_value(g.n) * any_value(g.h) * sqrt(2 * pi())) AS density
FROM g JOIN valid_pred v ON v.is_correct = g.is_correct, p WHERE g.h > 0 GROUP BY g.is_correct, p.point, p.x"""))
def a9_density(spark, sf):
    """Density curves of right and wrong confidences."""
    return mt.density_curve(valid(spark, sf), "confidence_one", "is_correct")


@query("a10_null_profile", sql=sql(["predictions", "valid_pred"], """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE true_category IS NULL) AS null_true_category,
       count(*) FILTER (WHERE predicted_one IS NULL) AS null_predicted_one,
       (SELECT count(*) FROM valid_pred) AS n_after_cleaning FROM predictions"""))
def a10(spark, sf):
    from corpusloom.operators.ranking import attach_scalars
    p = predictions(spark, sf)
    before = mt.null_profile(p, ["true_category", "predicted_one"])
    return attach_scalars(before, mt.valid_predictions(p).agg(F.count(F.lit(1)).alias("n_after_cleaning")))


cte("emb_sets", ("vectors",), f"""
SELECT vec_id, v.category AS label, CASE WHEN rk < n_test THEN 'test_embeddings' ELSE 'train_embeddings' END AS set_name
FROM (SELECT vec_id, category, row_number() OVER (PARTITION BY category ORDER BY md5('42:' || vec_id), vec_id) - 1 AS rk FROM vectors) v
JOIN ({apportioned_sql("vectors")}) a ON a.category IS NOT DISTINCT FROM v.category""")


def _emb_sets(spark, sf):
    v = fx.vectors(spark, sf).select("vec_id", "category")
    s = sm.stratified_split(v, "category", 0.2, 42, id_col="vec_id")
    return s.select("vec_id", F.col("category").alias("label"),
                    F.when(F.col("is_test"), "test_embeddings").otherwise("train_embeddings").alias("set_name"))


_DIST = """
SELECT set_name, label, n, total, n / total AS share,
       CAST(row_number() OVER (PARTITION BY set_name ORDER BY n DESC, label) AS INTEGER) AS rank
FROM (SELECT set_name, label, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY set_name) AS BIGINT) AS total
      FROM emb_sets GROUP BY 1, 2)"""


@query("a11_label_distribution", sql=sql(["emb_sets"], _DIST))
def a11(spark, sf):
    return mt.label_distribution(_emb_sets(spark, sf), "set_name", "label")


@query("w6_share_of_total", sql=sql(["emb_sets"], "SELECT set_name, label, share FROM (" + _DIST + ")"))
def w6(spark, sf):
    return mt.label_distribution(_emb_sets(spark, sf), "set_name", "label").select("set_name", "label", "share")


@query("t2_labels_by_frequency", sql=sql(["records"], """
SELECT category AS label, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, category) AS INTEGER) AS rank
FROM records GROUP BY category"""))
def t2(spark, sf):
    r = fx.records(spark, sf).select(F.lit("all").alias("set_name"), F.col("category").alias("label"))
    return mt.label_distribution(r, "set_name", "label").select("label", "n", "rank")


@query("t4_sorted_labels", sql=sql(["valid_pred"], """
SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS pos, label FROM (SELECT DISTINCT true_category AS label FROM valid_pred)"""))
def t4(spark, sf):
    return mt.sorted_labels(valid(spark, sf), "true_category")


@query("t1_top_errors", sql=sql(["valid_pred"], """
SELECT title, true_category, predicted_one, confidence_one FROM valid_pred WHERE NOT is_correct
ORDER BY confidence_one DESC, vec_id LIMIT 10"""))
def t1(spark, sf):
    return mt.top_errors(valid(spark, sf), 10)


@query("a14_cv_summary", sql=sql(["valid_pred"], """
SELECT avg(acc) AS mean_score, 2 * stddev_pop(acc) AS two_sigma, count(*) AS folds FROM (
  SELECT fold, avg(CAST(is_correct AS DOUBLE)) AS acc FROM (
    SELECT *, CAST((row_number() OVER (PARTITION BY true_category ORDER BY md5('42:' || vec_id), vec_id) - 1) % 5 AS INTEGER) AS fold
    FROM valid_pred) GROUP BY fold)"""))
def a14(spark, sf):
    f = sm.stratified_folds(valid(spark, sf), 5, "true_category", 42, id_col="vec_id")
    per = f.groupBy("fold").agg(F.avg(F.col("is_correct").cast("double")).alias("score"))
    return mt.cv_summary(per)


@query("a15_log_loss", sql=sql(["scores5"], """,
x AS (SELECT vec_id, CAST(substr(true_category, 2) AS INTEGER) - 1 AS y,
             [s1 / 1000.0, s2 / 1000.0, s3 / 1000.0, s4 / 1000.0, s5 / 1000.0] AS z FROM scores5),
r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1 AS rk, count(*) OVER () AS n FROM x)
SELECT avg(list_max(z) + ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) - z[y + 1]) AS log_loss,
       count(*) AS n
FROM r WHERE rk < floor(n * 0.8)"""))
def a15(spark, sf):
    r = fx.responses(spark, sf).select(
        "vec_id", (F.substring("true_category", 2, 10).cast("int") - 1).alias("y"),
        F.array(*[(F.col(f"s{i}") / 1000.0) for i in range(1, 6)]).alias("z"))
    s = sm.split_fraction(r, 0.8, 42, id_col="vec_id").withColumn("train", ~F.col("is_test"))
    return mt.log_loss(s, "z", "y", "train")
