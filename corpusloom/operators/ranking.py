"""Exact, skew-safe ranks by a seeded hash order.

A plain ``row_number().over(Window.partitionBy(category).orderBy(h))`` sends a
whole class to one task; with five labels and one of them holding a third of
all rows that is one task sorting a third of the data.  Because every order we
rank by starts with a uniform hash (md5 hex), the first 32 bits of the hash are
a *monotone* sub-bucket key:

    rank(row) = #rows of its group in lower sub-buckets      (prefix sum of
                                                              a small count table)
              + row_number within (group, sub-bucket)         (bounded window)

With 2^16 sub-buckets per group a class holding a third of 10^12 rows is
ranked in windows of ~5 million rows, in parallel, and the result equals
``row_number() over (partition by group order by hash, tiebreak) - 1`` exactly
(so DuckDB can check it).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import stage_table


def seeded_hash(seed, *parts) -> Column:
    """md5 hex of ``seed:part1:part2...`` (identical in DuckDB via ``md5(... || ':' || ...)``)."""
    cols = [F.lit(str(seed))]
    for p in parts:
        cols += [F.lit(":"), (F.col(p) if isinstance(p, str) else p).cast("string")]
    return F.md5(F.concat(*cols))


def hash32(hex_col: Column) -> Column:
    """First 32 bits of an md5 hex string as a non-negative long."""
    return F.conv(F.substring(hex_col, 1, 8), 16, 10).cast("long")


def hash60(hex_col: Column) -> Column:
    """First 60 bits of an md5 hex string as a non-negative long: reduced modulo n it
    reaches every rank of a class of up to 10^12 rows, with a bias below 10^-6."""
    return F.conv(F.substring(hex_col, 1, 15), 16, 10).cast("long")


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, to order rows that tie in everything else the same way
    in every evaluation (maps cannot be hashed and are left out)."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, T.MapType)])


def ordered_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "rank") -> DataFrame:
    """Add ``rank_col`` = 0-based position in a global order that is no hash, without a
    window over all rows: rows are range-partitioned (a stage table keeps the partition
    number), numbered inside their range, and shifted by the counts of earlier ranges.
    ``df`` should hold sort keys and ids only."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage_table(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ordered")
    # one row for each range: at most as many as there are shuffle partitions
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_c")).select(
        "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    numbered = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    return (numbered.join(F.broadcast(starts), "_range")
            .withColumn(rank_col, (F.col("_i") + F.col("_off")).cast("long")).drop("_range", "_i", "_off"))


def hash_rank(df: DataFrame, order_hash: Column, by: Sequence[str] = (),
              tiebreak: Sequence[str] = (), rank_col: str = "rank",
              size_col: str | None = None,
              bucket_bits: int | None = None, values: DataFrame | None = None) -> DataFrame:
    """Add ``rank_col`` = 0-based position of each row inside its ``by`` group
    when ordered by ``(order_hash, *tiebreak)``; optionally ``size_col`` = group
    size.  ``order_hash`` must be a lower-case hex md5 string.  Rows whose group is null are
    a group like any other.  ``values`` holds the ``by`` columns, once each, and columns to add to
    every row of the group; it meets the table of sub-buckets, not the rows.

    ``bucket_bits`` sub-buckets per group (default 2^16 grouped, 2^20 global):
    a group of n rows is ranked in windows of ~n / 2^bits rows each."""
    by = list(by)
    tb = list(tiebreak)
    bits = bucket_bits if bucket_bits is not None else (16 if by else 20)
    x = df.withColumn("_h", order_hash)
    # Sub-bucket = leading ``bits`` bits of the hash: monotone in the order.
    x = x.withColumn("_s", F.shiftright(hash32(F.col("_h")), 32 - bits))
    group = ["_g"] if by else []
    if by:  # as a struct: a null inside it is equal to a null
        x = x.withColumn("_g", F.struct(*[F.col(c) for c in by]))
    # Small count table: at most 2^bits rows per group (only non-empty ones).
    sub = x.groupBy(*group, "_s").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group).orderBy("_s") if by else Window.orderBy("_s")
    sub = sub.withColumn("_off", F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                            F.lit(0)).cast("long"))
    if size_col:
        sub = sub.withColumn(size_col, F.sum("_c").over(Window.partitionBy(*group)).cast("long"))
    if values is not None:
        sub = sub.join(values.withColumn("_g", F.struct(*[F.col(c) for c in by])).drop(*by), "_g", "left")
    # The join on (group, sub-bucket) and the final window share one
    # partitioning, so the big side is shuffled once.
    x = x.join(sub.drop("_c"), [*group, "_s"])
    w2 = Window.partitionBy(*group, "_s").orderBy("_h", *tb)
    x = x.withColumn(rank_col, (F.col("_off") + F.row_number().over(w2) - 1).cast("long"))
    return x.drop("_h", "_s", "_off", "_g")


GROUP_ROWS = 4096


def copy_rank(df: DataFrame, order_hash: Column, by: str, tiebreak: Sequence[str] = (), rank_col: str = "rank",
              group_rows: int = GROUP_ROWS) -> DataFrame:
    """``hash_rank`` for many groups that are small but for a few: only groups of more than
    ``group_rows`` rows get sub-buckets (of about ``group_rows`` rows) and entries in the table of
    offsets, so that table is a small share of the data, and empty if no group is large."""
    x = df.withColumn("_h", order_hash)
    large = (df.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group_rows)
             .select("_by", F.least(F.lit(31), F.ceil(F.log2(F.col("_n") / group_rows))).cast("int").alias("_bits")))
    large = stage_table(large, "large-groups")
    x = x.join(large, F.col(by).eqNullSafe(F.col("_by")), "left")
    x = x.withColumn("_s", F.when(F.col("_bits").isNull(), F.lit(0)).otherwise(
        F.floor(hash32(F.col("_h")) / F.pow(F.lit(2), 32 - F.col("_bits")))).cast("long"))
    sub = x.where(F.col("_bits").isNotNull()).groupBy("_by", "_s").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("_by").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage_table(sub.select("_by", F.col("_s").alias("_os"), F.sum("_c").over(before).alias("_off")), "offsets")
    x = x.drop("_by").join(offsets, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_s") == F.col("_os")), "left")
    rank = F.row_number().over(Window.partitionBy(by, "_s").orderBy("_h", *tiebreak)) - 1
    return (x.withColumn(rank_col, (F.coalesce("_off", F.lit(0)) + rank).cast("long"))
            .drop("_h", "_s", "_bits", "_by", "_os", "_off"))


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a single-row aggregate (``df.agg(...)`` with no
    grouping: exactly one row, checked by Spark at run time) to every row of
    ``df`` as an uncorrelated scalar subquery: computed once, inlined as a
    value — no join (not even a one-row one) and no shuffle of ``df``."""
    s = one_row.select(F.struct(*one_row.columns).alias("_one")).scalar()
    return df.withColumn("_one", s).select(*df.columns, *[F.col("_one")[c].alias(c) for c in one_row.columns])
