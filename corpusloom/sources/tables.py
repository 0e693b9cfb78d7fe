"""Lazy access to the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a lazy parquet scan (pruning / pushdown by Catalyst)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work that is heavy on each row: a scan with fewer splits than
    there are shuffle partitions (a small table in few row groups) is dealt out anew.  The
    number of splits of a bare scan is known when it is planned, so no job runs here; a
    large table has many more and is read as it is."""
    scan = table(spark, sf_dir, name).select(*columns)
    target = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return scan.repartition(target) if scan.rdd.getNumPartitions() < target else scan
