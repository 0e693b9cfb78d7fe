"""Session construction and lineage helpers.

The library never hard-codes a machine-local scratch folder: lineage is cut
with ``DataFrame.checkpoint()`` into the shared folder the cluster names in
``spark.checkpoint.dir``.  Only test / local sessions create their own folder,
and only when the setting is unset.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale; all are plain public Spark SQL confs.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # stage tables cut with checkpoint() are removed once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "corpusloom", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g"))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the session, if any."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    return spark.conf.get("spark.checkpoint.dir", None) or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the session's ``spark.checkpoint.dir``.  Only a ``local`` master (one
    machine: tests, bench) may do without: it gets a fresh scratch folder.  On a
    cluster an unset folder is an error, since executors do not share ``/tmp``."""
    d = checkpoint_dir(spark)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="corpusloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not spark.sparkContext.getCheckpointDir():
        # (Spark adds a unique sub-folder under the given one.)
        spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage/{label}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and
    read it back: cuts lineage, survives lost executors, and (unlike a row
    checkpoint) is compressed and column-pruned by later scans."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def met(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the data: by a shuffle of both, whatever the size of their files.  A
    stage table is compressed so well that millions of rows can look small enough to be sent to the driver
    and to every task."""
    return a.join(b.hint("merge"), on, how)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut the plan at a stage boundary: a stage table, so later branches read only
    the columns they need.  Never a local checkpoint: executors can be lost at any time."""
    return stage_table(df, "cut")
