"""Bucketed embedding store.

Vectors lie in Parquet files bucketed and sorted by ``content_key``, so joins with the store
shuffle only the other side: lookups move texts and keys, never stored vectors.  A store is a folder
of generations; the newest one that was completed is read.  Appends go to it; ``compact`` writes
the next one, bucket by bucket, with one row for each key.

A key can only come twice if two writers added it at once.  That is looked for in the key column
alone, within buckets, after an append; only then the store is compacted, so readers never compare
vectors.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "content_key string, embedding array<double>"


def embedders(spark: SparkSession, path: str) -> list[str]:
    """The embedders that have a store with a completed generation under the path."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root)]
    found = [n.removeprefix("embedder=") for n in names if n.startswith("embedder=")]
    return sorted(e for e in found if EmbeddingStore(spark, path, e).generations())


@dataclass(frozen=True)
class EmbeddingStore:
    """The store of one embedder under ``path``.  ``buckets`` holds for a store's whole life; as a rule at
    least as many as the jobs' shuffle partitions, or Spark rather shuffles both sides."""

    spark: SparkSession
    path: str
    embedder: str
    buckets: int | None = None

    def _root(self) -> str:
        return f"{self.path.rstrip('/')}/embedder={self.embedder}"

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self._root())
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def generations(self) -> list[tuple[int, int]]:
        """``(generation, buckets)`` of the completed generations, oldest first."""
        _, root, files = self._files()
        if not files.exists(root):
            return []
        names = [s.getPath().getName() for s in files.listStatus(root) if files.exists(s.getPath().suffix("/_SUCCESS"))]
        return sorted(tuple(int(x) for x in n.removeprefix("gen=").split("x")) for n in names if n.startswith("gen="))

    def _table(self, generation: int, buckets: int) -> str:
        """The name of a generation in the session's catalog, declared if it is not there yet: files of a
        bucketed table carry their bucket in their names, so any session can read them as such."""
        at = f"{self._root()}/gen={generation:06d}x{buckets}"
        name = "embeddings_" + hashlib.sha256(at.encode()).hexdigest()[:24]
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({COLUMNS}) USING parquet CLUSTERED BY (content_key) SORTED BY (content_key) "
                           f"INTO {buckets} BUCKETS LOCATION '{at}'")
        return name

    def _write(self, rows: DataFrame, generation: int, buckets: int) -> None:
        name = self._table(generation, buckets)
        # dealt by the bucket's own hash: each task writes the files of its buckets, one for each
        dealt = rows.select("content_key", "embedding").repartition(buckets, "content_key")
        dealt.write.mode("append").format("parquet").bucketBy(buckets, "content_key").sortBy("content_key").saveAsTable(name)

    def read(self) -> DataFrame | None:
        """``(content_key, embedding)``, or None before the first append."""
        found = self.generations()
        if not found:
            return None
        name = self._table(*found[-1])
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def append(self, rows: DataFrame) -> None:
        """Adds ``rows(content_key, embedding)``, whose keys the store does not hold."""
        found = self.generations()
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._write(rows, *(found[-1] if found else (0, self.buckets or n)))
        if found and self._repeated():
            self.compact()

    def _repeated(self) -> bool:
        keys = self.read().select("content_key").groupBy("content_key").agg(F.count(F.lit(1)).alias("n"))
        return not keys.where(F.col("n") > 1).isEmpty()

    def compact(self) -> None:
        """Writes the next generation: one file a bucket, one row a key."""
        found = self.generations()
        if found:
            generation, buckets = found[-1]
            one = self.read().groupBy("content_key").agg(F.min("embedding").alias("embedding"))
            self._write(one, generation + 1, buckets)

    def vacuum(self) -> None:
        """Removes the generations before the newest; not while others may still read them."""
        jvm, _, files = self._files()
        for generation, buckets in self.generations()[:-1]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(generation, buckets)}")
            files.delete(jvm.org.apache.hadoop.fs.Path(f"{self._root()}/gen={generation:06d}x{buckets}"), True)
