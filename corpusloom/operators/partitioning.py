"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def default_parallelism(df: DataFrame) -> int:
    spark = df.sparkSession
    try:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # noqa: BLE001
        return spark.sparkContext.defaultParallelism
