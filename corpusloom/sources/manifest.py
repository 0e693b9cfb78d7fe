"""Manifests of named embedding sets (J5): whether stored vectors of a set still belong to its texts.

A set's digest is a Merkle root over its texts in order: hashes of ``BLOCK`` texts that follow each
other are hashed together, then hashes of ``BLOCK`` such blocks, and so on.  No task holds more
than a block, and any change of a text, of the order or of the size changes the root.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.ranking import ordered_rank
from corpusloom.session import stage_table
from corpusloom.sources import io

BLOCK = 1024
#: Levels that every digest has; 2^30 texts take no more.
LEVELS = 3
MANIFEST_SCHEMA = "set_name string, embedder string, n long, digest string, has_labels boolean, has_ids boolean, made timestamp"


def set_digest(texts: DataFrame, order: Sequence[Column], text_col: str = "text") -> DataFrame:
    """One row ``n, digest`` of the texts in order (a null text is an empty one; ties must agree in
    the text or be told apart by ``order``).  A set without texts has the digest of nothing."""
    hashed = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    keyed = texts.select(*[c.alias(f"_o{i}") for i, c in enumerate(order)], hashed.alias("h"))
    leaves = stage_table(ordered_rank(keyed, [F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))] + [F.col("h")], "k")
                         .select("k", "h"), "digest")
    n, level, left = leaves.count(), 0, None
    left = n
    while level < LEVELS or left > 1:
        block = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]))
        leaves = (leaves.groupBy(F.floor(F.col("k") / BLOCK).alias("b")).agg(F.sha2(block, 256).alias("h"))
                  .select(F.col("b").alias("k"), "h"))
        level, left = level + 1, -(-left // BLOCK)
    return leaves.agg(F.lit(n).cast("long").alias("n"), F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("digest"))


def write_manifest(texts: DataFrame, order: Sequence[Column], set_name: str, embedder: str, path: str, text_col: str = "text",
                   has_labels: bool = False, has_ids: bool = False) -> None:
    """Records what the stored vectors of a set were made from; the newest record of a set holds."""
    row = set_digest(texts, order, text_col).select(
        F.lit(set_name).alias("set_name"), F.lit(embedder).alias("embedder"), "n", "digest", F.lit(has_labels).alias("has_labels"),
        F.lit(has_ids).alias("has_ids"), F.current_timestamp().alias("made"))
    row.write.mode("append").parquet(os.path.join(path, "manifests"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    at = os.path.join(path, "manifests")
    if not io.path_exists(spark, at):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    found = spark.read.schema(MANIFEST_SCHEMA).parquet(at)
    newest = found.groupBy("set_name", "embedder").agg(F.max_by(F.struct(*found.columns), "made").alias("m"))
    return newest.select("m.*")


def check_set(texts: DataFrame, order: Sequence[Column], set_name: str, embedder: str, path: str, text_col: str = "text",
              need_metadata: bool = False, force: bool = False) -> DataFrame:
    """One row ``set_name, n, digest, stored_n, status, warned``.  ``status`` is ``absent`` (no manifest),
    ``forced`` (the stored vectors are used whatever they were made from; ``warned`` if their number
    differs), ``hit``, ``no metadata`` (the texts agree, but labels and ids are asked for and
    were not stored) or ``miss``.  Only ``hit`` and ``forced`` use what is stored."""
    spark = texts.sparkSession
    now = set_digest(texts, order, text_col)
    stored = read_manifests(spark, path).where((F.col("set_name") == set_name) & (F.col("embedder") == embedder)).agg(
        F.max("n").alias("stored_n"), F.max("digest").alias("_d"), F.max(F.col("has_labels") & F.col("has_ids")).alias("_m"))
    pair = now.crossJoin(F.broadcast(stored))  # one row each
    same = (F.col("digest") == F.col("_d")) & (F.col("n") == F.col("stored_n"))
    status = (F.when(F.col("_d").isNull(), "absent").when(F.lit(force), "forced").when(~same, "miss")
              .when(F.lit(need_metadata) & ~F.col("_m"), "no metadata").otherwise("hit"))
    warned = F.lit(force) & F.col("_d").isNotNull() & (F.col("n") != F.coalesce("stored_n", F.lit(-1)))
    return pair.select(F.lit(set_name).alias("set_name"), "n", "digest", "stored_n", status.alias("status"), warned.alias("warned"))
