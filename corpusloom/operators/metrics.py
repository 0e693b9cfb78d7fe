"""Classifier evaluation.

Every metric is a small aggregate over the prediction table: one scan with
partial aggregation, then arithmetic on a table with one row per label (or pair of
labels), for any number of labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.scores import ERROR_LABEL
from corpusloom.operators.ranking import attach_scalars, ordered_rank
from corpusloom.session import stage_table


def _div(num: Column, den: Column) -> Column:
    """num / den, 0.0 when the denominator is 0 (sklearn ``zero_division=0``)."""
    return F.when(den != 0, num.cast("double") / den).otherwise(F.lit(0.0))


# ---------------------------------------------------------------------------- P16-P18, J4

def valid_predictions(df: DataFrame, truth: str = "true_category", pred: str = "predicted_one") -> DataFrame:
    """Drop error rows and rows with a null truth or prediction."""
    return df.filter((F.col(pred) != ERROR_LABEL) & F.col(truth).isNotNull() & F.col(pred).isNotNull())


def with_correct(df: DataFrame, truth: str = "true_category", pred: str = "predicted_one",
                 out: str = "is_correct") -> DataFrame:
    """Correctness flag."""
    return df.withColumn(out, F.col(truth) == F.col(pred))


def align(pred: DataFrame, truth: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Predictions aligned with the truth by id (an inner join, not position)."""
    return pred.join(truth, on)


# ---------------------------------------------------------------------------- A5-A7

def accuracy(df: DataFrame, truth: str = "true_category", pred: str = "predicted_one") -> DataFrame:
    """A5: one row ``(accuracy, n)``."""
    return df.agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def pair_counts(df: DataFrame, truth: str = "true_category", pred: str = "predicted_one") -> DataFrame:
    """``(truth, pred, n)``: all that A5-A7 need of the predictions, as a stage table, so
    whatever made the predictions runs once."""
    return stage_table(df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred"))
                       .agg(F.count(F.lit(1)).alias("n")), "pair-counts")


def per_label_counts(counts: DataFrame) -> DataFrame:
    """``(label, support, n_pred, tp)`` over the union of actual and predicted labels,
    from ``pair_counts``: each pair adds to the row of its truth and of its prediction."""
    n, zero = F.col("n"), F.lit(0).cast("long")
    sides = F.array(F.struct(F.col("truth").alias("label"), n.alias("support"), zero.alias("n_pred"),
                             F.when(F.col("truth") == F.col("pred"), n).otherwise(zero).alias("tp")),
                    F.struct(F.col("pred").alias("label"), zero.alias("support"), n.alias("n_pred"), zero.alias("tp")))
    return (counts.select(F.inline(sides)).groupBy("label")
            .agg(F.sum("support").alias("support"), F.sum("n_pred").alias("n_pred"), F.sum("tp").alias("tp")))


def classification_report(df: DataFrame, truth: str = "true_category", pred: str = "predicted_one",
                          labels: Sequence[str] | None = None) -> DataFrame:
    """Per-label precision / recall / F1 / support, then the accuracy row
    (in the f1 column, support = n), the macro and the support-weighted
    averages; undefined ratios are 0."""
    counts = pair_counts(df, truth, pred)
    c = per_label_counts(counts)
    if labels is not None:
        c = c.filter(F.col("label").isin(list(labels)))
    p = _div(F.col("tp"), F.col("n_pred"))
    r = _div(F.col("tp"), F.col("support"))
    per = (c.withColumn("precision", p).withColumn("recall", r)
           .withColumn("f1", _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    tot = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_n"), F.coalesce(F.sum(hit), F.lit(0)).alias("_tp"))
    body = per.select("label", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))
    acc = tot.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), _div(F.col("_tp"), F.col("_n")).alias("f1"),
                     F.col("_n").cast("long").alias("support"))
    sup = F.sum("support")
    avgs = per.agg(F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                   _div(F.sum(F.col("precision") * F.col("support")), sup).alias("wp"),
                   _div(F.sum(F.col("recall") * F.col("support")), sup).alias("wr"),
                   _div(F.sum(F.col("f1") * F.col("support")), sup).alias("wf"), sup.alias("s"))
    macro = avgs.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                        F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("s").cast("long").alias("support"))
    weighted = avgs.select(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"),
                           F.col("wr").alias("recall"), F.col("wf").alias("f1"),
                           F.col("s").cast("long").alias("support"))
    return body.unionByName(acc).unionByName(macro).unionByName(weighted)


def _positions(labels: DataFrame) -> DataFrame:
    """``(pos, label)`` of a frame of distinct labels, in label order."""
    return ordered_rank(labels.filter(F.col("label").isNotNull()), [F.col("label")], "pos").select(
        F.col("pos").cast("int").alias("pos"), "label")


def sorted_labels(df: DataFrame, col: str) -> DataFrame:
    """T4: sorted distinct labels of one column as ``(pos, label)`` rows, any number."""
    return _positions(df.select(F.col(col).alias("label")).distinct())


def confusion_matrix(df: DataFrame, truth: str = "true_category", pred: str = "predicted_one",
                     labels: Sequence[str] | None = None) -> DataFrame:
    """``(actual, predicted, n)`` for every cell of the label grid, zero
    cells included.  ``labels`` fixes the order/selection (embedding pipeline);
    by default the sorted union of actual and predicted labels (always the
    union, so a label only ever predicted keeps its column).

    The grid has the square of the number of labels as rows, by its definition; the row of
    labels that it is laid out from is far smaller."""
    counts = pair_counts(df, truth, pred)
    if labels is None:
        both = counts.select(F.explode(F.array("truth", "pred")).alias("label")).where(F.col("label").isNotNull())
        row = both.agg(F.array_sort(F.collect_set("label")).alias("labels"))
    else:
        row = df.sparkSession.range(1).select(F.array(*[F.lit(x) for x in labels]).cast("array<string>").alias("labels"))
    cells = row.select("labels", F.explode("labels").alias("actual")).select("actual", F.explode("labels").alias("predicted"))
    found = counts.select(F.col("truth").alias("actual"), F.col("pred").alias("predicted"), "n")
    return (cells.join(found, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


# ---------------------------------------------------------------------------- A8-A11

def confidence_by_correct(df: DataFrame, conf: str = "confidence_one", correct: str = "is_correct") -> DataFrame:
    """Mean confidence of correct vs incorrect predictions."""
    return df.groupBy(correct).agg(F.avg(conf).alias("mean_confidence"))


def confidence_histogram(df: DataFrame, conf: str = "confidence_one", correct: str = "is_correct",
                         bins: int = 20) -> DataFrame:
    """Fixed-width histogram of confidences in [0, 1] split by correctness,
    with counts normalised independently per group (``density``)."""
    b = F.least(F.floor(F.col(conf) * bins), F.lit(bins - 1)).cast("int")
    h = df.groupBy(correct, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy(correct)))


def exact_quantiles(df: DataFrame, col: str, shares: Sequence[float]) -> DataFrame:
    """One row ``q0, q1, ...``: exact quantiles (linear between neighbours) of the non-null values.
    Values are ranked in ranges; only the rows on both sides of each quantile are added up."""
    v = df.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ranked = ordered_rank(v, [F.col("_v")], "_k")
    x = attach_scalars(ranked, v.agg(F.count(F.lit(1)).alias("_n")))

    def part(share: float) -> Column:
        at = (F.col("_n") - 1) * share
        return F.sum(F.when(F.col("_k") == F.floor(at), F.col("_v") * (1 - (at - F.floor(at))))
                     .when(F.col("_k") == F.floor(at) + 1, F.col("_v") * (at - F.floor(at))))

    return x.agg(*[part(s).alias(f"q{i}") for i, s in enumerate(shares)])


def automatic_bins(df: DataFrame, col: str) -> DataFrame:
    """One row ``lo, width, n_bins`` for a histogram of ``col``: the narrower of the Freedman-Diaconis
    width ``2 * IQR / n^(1/3)`` and the Sturges width ``range / (log2 n + 1)`` (Sturges where the
    quartiles agree), so many whole bins over the range; one bin if all values agree."""
    v = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    s = v.agg(F.count(F.lit(1)).alias("n"), F.min(F.col(col).cast("double")).alias("lo"), F.max(F.col(col).cast("double")).alias("hi"))
    s = attach_scalars(s, exact_quantiles(df, col, (0.25, 0.75)))
    spread = F.col("hi") - F.col("lo")
    diaconis = 2 * (F.col("q1") - F.col("q0")) / F.pow(F.col("n").cast("double"), 1 / 3)
    sturges = spread / (F.log2("n") + 1)
    width = F.when(diaconis > 0, F.least(diaconis, sturges)).otherwise(sturges)
    bins = F.when(spread > 0, F.ceil(spread / width)).otherwise(1).cast("long")
    return s.where(F.col("n") > 0).select("lo", (spread / bins).alias("width"), bins.alias("n_bins"))


def automatic_histogram(df: DataFrame, col: str, by: str) -> DataFrame:
    """``(by, bin, left, n, density)`` with bins from the data, common to all groups; ``density`` is
    normalised within each group.  The last bin holds the largest value."""
    x = attach_scalars(df.where(F.col(col).isNotNull()), automatic_bins(df, col))
    at = F.when(F.col("width") > 0, F.floor((F.col(col) - F.col("lo")) / F.col("width"))).otherwise(0)
    h = (x.withColumn("bin", F.least(at, F.col("n_bins") - 1).cast("long"))
         .groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("_lo"), F.first("width").alias("_w")))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(by))
    return h.select(by, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left"), "n",
                    F.when(F.col("_w") > 0, share / F.col("_w")).alias("density"))


#: A fine bin is 1/16 of a bandwidth; kernels end at 9 bandwidths.
FINE, REACH, TERMS = 16, 9, 8


def density_curve(df: DataFrame, col: str, by: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density of each group, ``(by, point, x, density)`` at ``points`` places from the
    smallest to the largest value of all groups.  The bandwidth is the group's standard deviation
    (n - 1) times ``n^(-1/5)``; a group whose values all agree has no curve.

    Values are not compared with all places: they are counted in fine bins (with the moments about
    the bin's middle, so a bin acts as its values do), and the curve is the convolution of the bins
    with the kernel.  A bin reaches the places within ``REACH`` bandwidths."""
    v = df.select(F.col(by).alias("_by"), F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    g = v.groupBy("_by").agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_v").alias("_sd"))
    g = g.where(F.col("_sd") > 0).select(F.col("_by").alias("_g"), "_n", (F.col("_sd") * F.pow(F.col("_n").cast("double"), -0.2)).alias("_h"))
    x = attach_scalars(v, v.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    # one row a group: a join with few rows
    x = x.join(g, F.col("_by").eqNullSafe(F.col("_g"))).withColumn("_bin", F.floor((F.col("_v") - F.col("_lo")) / F.col("_h") * FINE))
    middle = F.col("_lo") + (F.col("_bin") + 0.5) * F.col("_h") / FINE
    off = (F.col("_v") - middle) / F.col("_h")
    bins = x.groupBy("_by", "_bin", "_n", "_h", "_lo", "_hi").agg(*[F.sum(F.pow(off, k)).alias(f"_m{k}") for k in range(TERMS)])
    step = (F.col("_hi") - F.col("_lo")) / (points - 1)
    low = F.greatest(F.lit(0), F.ceil((middle - REACH * F.col("_h") - F.col("_lo")) / step)).cast("int")
    high = F.least(F.lit(points - 1), F.floor((middle + REACH * F.col("_h") - F.col("_lo")) / step)).cast("int")
    at = bins.withColumn("_mid", middle).withColumn("point", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
    at = at.withColumn("_u", (F.col("_lo") + F.col("point") * step - F.col("_mid")) / F.col("_h"))
    # Taylor terms of the kernel: its k-th derivative is a Hermite polynomial times itself
    terms, before, now = F.col("_m0"), F.lit(1.0), F.col("_u")
    fact = 1.0
    for k in range(1, TERMS):
        fact *= k
        terms = terms + F.col(f"_m{k}") * now / fact
        before, now = now, F.col("_u") * now - k * before
    kernel = F.exp(-F.col("_u") * F.col("_u") / 2) / ((2 * 3.141592653589793) ** 0.5)
    reached = at.select(F.col("_by").alias(by), "point", (terms * kernel / (F.col("_n") * F.col("_h"))).alias("density"))
    every = g.select(F.col("_g").alias(by), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), F.lit(0.0).alias("density"))
    curve = reached.unionByName(every).groupBy(by, "point").agg(F.sum("density").alias("density"))
    curve = attach_scalars(curve, v.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    return curve.select(by, "point", (F.col("_lo") + F.col("point") * (F.col("_hi") - F.col("_lo")) / (points - 1)).alias("x"), "density")


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A10: one row: row count and null count per column."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols])


def label_distribution(df: DataFrame, by: str = "set_name", label: str = "label") -> DataFrame:
    """A11 + W6 + T2: per set, total, count per label, share of the set's total,
    and rank by count desc (ties by label).  A set without labels reports a
    single null-label row rather than failing."""
    c = df.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by)
    return (c.withColumn("total", F.sum("n").over(w))
            .withColumn("share", F.col("n") / F.col("total"))
            .withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), F.asc(label)))))


# ---------------------------------------------------------------------------- A14, A15, T1

def cv_summary(scores: DataFrame, score_col: str = "score") -> DataFrame:
    """Mean and +/- 2 population sigma of per-fold scores."""
    return scores.agg(F.avg(score_col).alias("mean_score"),
                      (2 * F.stddev_pop(score_col)).alias("two_sigma"), F.count(F.lit(1)).alias("folds"))


def cross_entropy(logits: Column, y: Column) -> Column:
    """Per-row cross entropy of integer class ``y`` under softmax(logits)."""
    # max bound once per row (finish lambda), then one pass for the log-sum-exp
    lse = F.aggregate(logits, F.lit(float("-inf")), lambda m, x: F.greatest(m, x),
                      lambda m: m + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))))
    return lse - F.element_at(logits, y + 1)


def log_loss(df: DataFrame, logits: str, y: str, mask: str | None = None) -> DataFrame:
    """Mean cross-entropy over the rows of ``mask`` (training rows)."""
    x = df.filter(F.col(mask)) if mask else df
    return x.agg(F.avg(cross_entropy(F.col(logits), F.col(y))).alias("log_loss"), F.count(F.lit(1)).alias("n"))


def top_errors(df: DataFrame, k: int = 10, truth: str = "true_category", pred: str = "predicted_one",
               conf: str = "confidence_one", title: str = "title", id_col: str = "vec_id") -> DataFrame:
    """The ``k`` most confident wrong predictions (top-k is the feature;
    planned as TakeOrderedAndProject, the id breaks ties)."""
    wrong = df.filter(F.col(truth) != F.col(pred))
    return (wrong.orderBy(F.desc(conf), F.asc(id_col)).limit(k)
            .select(title, truth, pred, conf))
