"""Seeded shuffles, splits, caps, over/undersampling and class statistics
(W2, W3, W5, B1-B9, A1-A3, A13).

Randomness is a seeded md5 order (identical in Spark and DuckDB), so every
operator is reproducible and checkable.  Ranks come from the skew-safe
``hash_rank`` (no window ever holds a whole class); class sizes are small
aggregates attached by broadcast; bootstrap draws are generated in chunks
spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ranking import attach_scalars, copy_rank, hash60, hash_rank, row_hash, seeded_hash
from corpusloom.session import stage_table

DRAW_CHUNK = 4096


def hash_order(df: DataFrame, seed=42, id_col: str = "lens_id", tiebreak: Sequence[str] = (),
               position_col: str | None = "position") -> DataFrame:
    """B1: seeded full shuffle.  Adds the sort key (md5 of ``seed:id``) and,
    if asked, the exact 0-based position in that order; a physical sort is left
    to the caller (``orderBy('shuffle_key')``) because nothing downstream needs one."""
    out = df.withColumn("shuffle_key", seeded_hash(seed, id_col))
    if position_col:
        out = hash_rank(out, F.col("shuffle_key"), tiebreak=[id_col, *tiebreak, row_hash(df)], rank_col=position_col)
    return out


def split_fraction(df: DataFrame, frac: float = 0.8, seed=42, id_col: str = "lens_id",
                   tiebreak: Sequence[str] = (), test_col: str = "is_test") -> DataFrame:
    """Positional split of the shuffled frame — the first ``floor(frac*n)``
    rows train, the rest test.  Exact sizes (no Bernoulli sampling)."""
    r = hash_rank(df, seeded_hash(seed, id_col), tiebreak=[id_col, *tiebreak, row_hash(df)], rank_col="_r", size_col="_n")
    return r.withColumn(test_col, F.col("_r") >= F.floor(F.col("_n") * frac)).drop("_r", "_n")


def cap_per_class(df: DataFrame, limit: int, seed="42:cap", label: str = "category",
                  id_col: str = "lens_id", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Keep ``min(n, limit)`` rows of each class (seeded)."""
    r = hash_rank(df, seeded_hash(seed, id_col), by=[label], tiebreak=[id_col, *tiebreak, row_hash(df)], rank_col="_r")
    return r.filter(F.col("_r") < limit).drop("_r")


def class_sizes(df: DataFrame, label: str = "category") -> DataFrame:
    """A1 (one level): rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def oversample(df: DataFrame, seed=42, label: str = "category", id_col: str = "lens_id",
               tiebreak: Sequence[str] = (), draw_col: str = "draw",
               num_partitions: int | None = None) -> DataFrame:
    """B2: bootstrap — every class, the largest included, is redrawn with
    replacement to the largest class size.  Draw ``k`` of class ``c`` picks the
    row of rank ``h(seed:c:k) mod n_c``, h of 60 bits.

    Draw numbers are generated in chunks of ``DRAW_CHUNK`` spread over
    ``num_partitions`` tasks, then equi-joined to the ranked rows on
    ``(class, rank)`` — no task generates a whole class."""
    spark = df.sparkSession
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = hash_rank(df, seeded_hash(seed, id_col), by=[label], tiebreak=[id_col, *tiebreak, row_hash(df)], rank_col="_r")
    sizes = class_sizes(df, label)
    classes = attach_scalars(sizes, sizes.agg(F.max("n").alias("_mx")))
    chunks = classes.select(label, "n", "_mx", F.explode(F.sequence(
        F.lit(0), (F.ceil(F.col("_mx") / DRAW_CHUNK) - 1).cast("long"))).alias("_chunk"))
    chunks = chunks.repartition(parts, label, "_chunk")
    draws = chunks.select(label, "n", F.explode(F.sequence(
        F.col("_chunk") * DRAW_CHUNK,
        F.least((F.col("_chunk") + 1) * DRAW_CHUNK, F.col("_mx")) - 1)).alias(draw_col))
    draws = draws.withColumn("_r", F.pmod(hash60(seeded_hash(seed, label, draw_col)), F.col("n"))).drop("n")
    return draws.join(ranked, [label, "_r"]).drop("_r")


def suffix_copies(df: DataFrame, id_col: str = "lens_id", seed=42, order_cols: Sequence[str] = ("category", "draw"),
                  out_col: str | None = None) -> DataFrame:
    """Append ``_k`` (0-based copy number per id) to make ids unique.  The
    copy order is the seeded hash of the draw (the reference follows row
    order); ranks are skew-safe, so one record drawn many times is fine."""
    r = copy_rank(df, seeded_hash(seed, *order_cols), id_col, list(order_cols), "_k")
    return r.withColumn(out_col or id_col, F.concat(F.col(id_col), F.lit("_"), F.col("_k").cast("string"))).drop("_k")


def balance_train(df: DataFrame, limit: int | None = None, seed=42, frac: float = 0.8,
                  label: str = "category", id_col: str = "lens_id", test_col: str = "is_test") -> DataFrame:
    """Split -> (cap) -> oversample the train part only -> suffix ids ->
    append the untouched test rows (ids not suffixed).  ``limit`` is a feature: with it,
    every class keeps at most so many train rows, and no others reach what is built
    from the result; by default none are left out.  The split, the capped train rows
    and the draws are stage tables: both parts of the split come from one evaluation."""
    s = stage_table(split_fraction(df, frac, seed, id_col, tiebreak=[label], test_col=test_col), "split")
    train = s.filter(~F.col(test_col))
    test = s.filter(F.col(test_col))
    if limit is not None:
        train = stage_table(cap_per_class(train, limit, f"{seed}:cap", label, id_col, tiebreak=[label]), "capped")
    over = stage_table(oversample(train, seed, label, id_col, tiebreak=[label]), "draws")
    over = suffix_copies(over, id_col, seed, (label, "draw")).drop("draw")
    return over.unionByName(test)


def mean_class_size(df: DataFrame, categories: Sequence[str], label: str = "category") -> DataFrame:
    """A3: truncated mean class size over a fixed category list (absent
    categories count 0) — one row ``mean_size``."""
    k = len(categories)
    return df.agg(F.floor(F.count_if(F.col(label).isin(list(categories))) / F.lit(k)).cast("long").alias("mean_size"))


def undersample_majority(df: DataFrame, majority: str, others: Sequence[str], target: int | None = None,
                         seed=42, label: str = "category", id_col: str = "lens_id") -> DataFrame:
    """Keep every non-majority row, those without a label too; keep
    ``min(target, n_majority)`` seeded rows of the majority class, target defaulting to A3 over
    ``others``."""
    maj = df.filter(F.col(label) == majority)
    rest = df.filter(~F.col(label).eqNullSafe(F.lit(majority)))
    r = hash_rank(maj, seeded_hash(seed, id_col), tiebreak=[id_col, row_hash(df)], rank_col="_r")
    if target is None:
        r = attach_scalars(r, mean_class_size(df, others, label))
        keep = F.col("_r") < F.col("mean_size")
        return rest.unionByName(r.filter(keep).drop("_r", "mean_size"))
    return rest.unionByName(r.filter(F.col("_r") < target).drop("_r"))


def apportion(sizes: DataFrame, share: float, label: str = "category", out_col: str = "n_test") -> DataFrame:
    """Shares whole rows out to labels: of ``sizes(label, n)``, one row a label, ``ceil(share * total)`` rows
    are taken in all.  The others are dealt by largest remainder (each label gets the whole part
    of its proportional number, the labels with the largest remainders one more; ties in
    label order, null first), and ``out_col`` is what is left of each label."""
    whole = sizes.agg(F.sum("n").cast("decimal(38,0)").alias("_all"))
    x = attach_scalars(sizes, whole.withColumn("_rest", F.col("_all") - F.ceil(F.col("_all").cast("double") * share).cast("decimal(38,0)")))
    product = F.col("n").cast("decimal(18,0)") * F.col("_rest").cast("decimal(18,0)")
    x = x.withColumn("_left", product % F.col("_all")).withColumn("_floor", ((product - F.col("_left")) / F.col("_all")).cast("long"))
    missing = x.agg((F.first("_rest") - F.sum("_floor")).cast("long").alias("_more"))
    x = attach_scalars(x, missing)
    nth = F.row_number().over(Window.orderBy(F.desc("_left"), F.col(label).asc_nulls_first()))  # one row a label
    kept = F.col("_floor") + F.when(nth <= F.col("_more"), 1).otherwise(0)
    return x.select(label, "n", (F.col("n") - kept).cast("long").alias(out_col))


def stratified_split(df: DataFrame, label: str = "category", test_size: float = 0.2, seed=42,
                     id_col: str = "lens_id", test_col: str = "is_test") -> DataFrame:
    """Exactly ``ceil(test_size * n)`` test rows, shared out to the labels by largest remainder; of
    each label the first of the seeded order are test."""
    test = apportion(class_sizes(df, label), test_size, label, "_t").drop("n")
    r = hash_rank(df, seeded_hash(seed, id_col), by=[label], tiebreak=[id_col, row_hash(df)], rank_col="_r", values=test)
    return r.withColumn(test_col, F.col("_r") < F.col("_t")).drop("_r", "_t")


def sample_n(df: DataFrame, n: int, seed=42, id_col: str = "lens_id") -> DataFrame:
    """Seeded uniform subsample of exactly ``min(n, rows)`` rows (the
    sample size is the feature)."""
    r = hash_rank(df, seeded_hash(seed, id_col), tiebreak=[id_col, row_hash(df)], rank_col="_r")
    return r.filter(F.col("_r") < n).drop("_r")


def head_n(df: DataFrame, n: int, by: str, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows per file in the given order.  ``row_number <= n``
    is planned as a window group limit: each task keeps at most ``n`` rows per
    file before the shuffle, so a huge file costs nothing extra."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def stratified_folds(df: DataFrame, k: int = 5, label: str = "category", seed=42,
                     id_col: str = "lens_id", fold_col: str = "fold") -> DataFrame:
    """Stratified, shuffled k-fold ids: rank inside the label mod ``k``."""
    r = hash_rank(df, seeded_hash(seed, id_col), by=[label], tiebreak=[id_col, row_hash(df)], rank_col="_r")
    return r.withColumn(fold_col, (F.col("_r") % k).cast("int")).drop("_r")


def class_counts(df: DataFrame, by: Sequence[str] = ("split", "category")) -> DataFrame:
    """A1: counts per class for all rows, per split and per (split, class) at
    once with a rollup."""
    return df.rollup(*by).agg(F.count(F.lit(1)).alias("n"))


def max_class(df: DataFrame, label: str = "category") -> DataFrame:
    """A2: size of the largest class (one row)."""
    return class_sizes(df, label).agg(F.max("n").alias("max_class"))


def class_weights(df: DataFrame, label: str = "category") -> DataFrame:
    """Balanced class weights ``n / (k * n_c)`` per class."""
    s = class_sizes(df, label)
    tot = s.agg(F.sum("n").alias("_tot"), F.count(F.lit(1)).alias("_k"))
    return attach_scalars(s, tot).select(label, (F.col("_tot") / (F.col("_k") * F.col("n"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str = "category", weight_col: str = "weight") -> DataFrame:
    """A13 as a ``weightCol`` for MLlib (one small join)."""
    return df.join(class_weights(df, label).withColumnRenamed("weight", weight_col), label)
