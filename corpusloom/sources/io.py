"""Scans, sources and sinks.

Explicit schemas everywhere (no inference), union by name, Parquet partitioned
by label instead of one table per label, and every writer goes to a path the
caller names (on a cluster: shared storage; in tests: a scratch folder).
"""

from __future__ import annotations

import os
import uuid
import warnings
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import ensure_checkpoint_dir

# Column names of the reference's raw record files.
RAW_RECORD_COLUMNS = ("Lens ID", "Title", "Abstract", "CPC Classifications", "IPCR Classifications")
# Header of the results file, in order.
RESULT_COLUMNS = ("LensID", "Title", "true_category", "predicted_one", "confidence_one",
                  "predicted_two", "confidence_two")

RECORD_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in
                              ("lens_id", "title", "abstract", "cpc", "ipcr")])
RESULT_SCHEMA = T.StructType([
    T.StructField("LensID", T.StringType()), T.StructField("Title", T.StringType()),
    T.StructField("true_category", T.StringType()), T.StructField("predicted_one", T.StringType()),
    T.StructField("confidence_one", T.DoubleType()), T.StructField("predicted_two", T.StringType()),
    T.StructField("confidence_two", T.DoubleType())])
PROMPT_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("prompt_template", T.StringType())])

# Nothing is trimmed; a null is an empty field, an empty text a quoted empty one.  (For
# reading, the name of null must differ from the empty text; no text has this one.)
_CSV = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_CSV_READ = {**_CSV, "nullValue": "\u0001null\u0001", "emptyValue": ""}
_CSV_WRITE = {**_CSV, "nullValue": "", "emptyValue": '""'}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "corpusloom-scratch", f"{name}-{uuid.uuid4().hex[:12]}")


# S1 ------------------------------------------------------------------------------
def _by_name(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` by the header's names: its own, or for the record
    columns those of the raw export.  Other columns, and their order, do not matter."""
    export = dict(zip(RECORD_SCHEMA.names, RAW_RECORD_COLUMNS, strict=True))
    picked = []
    for f in schema.fields:
        name = next((n for n in (f.name, export.get(f.name)) if n in raw.columns), None)
        if name is None:
            raise ValueError(f"the header has no column {f.name!r}; it has {raw.columns}")
        picked.append(F.col(f"`{name}`").cast(f.dataType).alias(f.name))
    return raw.select(*picked)


def read_records(spark: SparkSession, path: str | Sequence[str],
                 schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """Header CSV with quoted multi-line text; columns by header name, as strings.
    Each path has a header of its own."""
    paths = [path] if isinstance(path, str) else list(path)
    return reduce(DataFrame.unionByName, [_by_name(spark.read.options(**_CSV_READ).csv(p), schema) for p in paths])


def read_records_with_path(spark: SparkSession, paths: Sequence[str], schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """S1 with ``path``, the decoded path of the file (or Spark-written folder) of each row."""
    out = []
    for p in paths:
        raw = spark.read.options(**_CSV_READ).csv(p)
        out.append(_by_name(raw, schema).withColumn("path", source_path(F.input_file_name())))
    return reduce(DataFrame.unionByName, out)


def local_form(path: str) -> str:
    """A path in the form that ``source_path`` gives it."""
    return "/" + path[len("file:"):].lstrip("/") if path.startswith("file:") else path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**_CSV_WRITE).csv(path)


# S2 / S3 -------------------------------------------------------------------------
def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_labelled(spark: SparkSession, files: Mapping[str, str | None],
                  schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """Every file adds constant ``category`` and ``source_file``; missing
    files are skipped with a warning; the rest are concatenated by name.  Label and
    name belong to the path, so files of one name in two folders keep their own."""
    frames = []
    for path, label in files.items():
        if path_exists(spark, path):
            frames.append(read_records(spark, path, schema)
                          .withColumn("category", F.lit(label).cast("string"))
                          .withColumn("source_file", F.lit(os.path.basename(path.rstrip("/")))))
        else:
            warnings.warn(f"no such file, skipped: {path}", stacklevel=2)
    if not frames:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("category", T.StringType()),
                                                       T.StructField("source_file", T.StringType())]))
    return build_combined(frames)


def source_path(path: Column) -> Column:
    """Decoded path of a scanned file (``input_file_name`` is a URI); for a folder
    written by Spark, the folder."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.regexp_replace(plain, r"^file:/+", "/"), r"/part-[^/]*$", "")


def label_for_file(path: Column, mapping: Mapping[str, str]) -> Column:
    """S3: label of a file by its whole (decoded) path, falling back to the stem of its
    name.  The mapping is a plan constant (a handful of files), so it is a literal map."""
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    if not mapping:
        return stem
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, path), stem)


# S4 / S5 / S6 / S7 ---------------------------------------------------------------
def write_table(df: DataFrame, path: str, mode: str = "errorifexists",
                partition_by: Sequence[str] = ("category",)) -> None:
    """CTAS equivalent — Parquet partitioned by label; fails if it exists."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def build_combined(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of the per-label tables by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def category_dim(df: DataFrame, id_col: str = "lens_id", label_col: str = "category") -> DataFrame:
    """(id, category) projection, duplicates kept."""
    return df.select(id_col, label_col)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Full table scan; Catalyst prunes columns / partitions at the scan."""
    return spark.read.parquet(path)


# S8 ------------------------------------------------------------------------------
def latest_prompt(prompts: DataFrame) -> DataFrame:
    """The current prompt = the row with the largest id (one row)."""
    return prompts.agg(F.max_by("prompt_template", "id").alias("prompt_template"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    return _by_name(spark.read.options(**_CSV_READ).csv(path), PROMPT_SCHEMA)


# S9 ------------------------------------------------------------------------------
def write_results(df: DataFrame, path: str) -> None:
    """Fixed 7-column header, overwritten on each run, row order undefined."""
    write_csv(df.select(*RESULT_COLUMNS), path, mode="overwrite")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return _by_name(spark.read.options(**_CSV_READ).csv(path), RESULT_SCHEMA)


# S10 -----------------------------------------------------------------------------
def write_embeddings(df: DataFrame, path: str, embedder: str) -> None:
    """Appends ``(content_key, embedding)`` to the bucketed store of an embedder."""
    from corpusloom.sources.store import EmbeddingStore
    EmbeddingStore(df.sparkSession, path, embedder).append(df)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame | None:
    """``(content_key, embedding, embedder)`` of all embedders' stores under the path, or None
    before the first write."""
    from corpusloom.sources.store import EmbeddingStore, embedders
    frames = [EmbeddingStore(spark, path, e).read().withColumn("embedder", F.lit(e)) for e in embedders(spark, path)]
    return reduce(DataFrame.unionByName, frames) if frames else None


SET_SCHEMA = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("label", T.StringType()),
                           T.StructField("content_key", T.StringType()), T.StructField("set_name", T.StringType())])


def write_embedding_set(items: DataFrame, set_name: str, path: str) -> None:
    """One named set beside the vectors — ``item_id, label, content_key`` of its
    items (a set may have no labels: null); a set of that name is replaced."""
    (items.select(F.col("item_id").cast("string").alias("item_id"), F.col("label").cast("string").alias("label"), "content_key")
     .write.mode("overwrite").parquet(os.path.join(path, "sets", f"set_name={set_name}")))


def read_embedding_sets(spark: SparkSession, path: str) -> DataFrame:
    """All sets of a store: ``item_id, label, content_key, set_name``."""
    return spark.read.schema(SET_SCHEMA).parquet(os.path.join(path, "sets"))


# S11 -----------------------------------------------------------------------------
def write_graph(nodes: DataFrame, edges: DataFrame, path: str, features: DataFrame | None = None,
                masks: DataFrame | None = None) -> None:
    """Graph store — ``nodes/``, ``edges/`` (partitioned by edge type) and, so that
    a reloaded graph can be trained, ``features/`` and ``masks/``; replaced on each write."""
    edges.write.mode("overwrite").partitionBy("edge_type").parquet(os.path.join(path, "edges"))
    for name, part in (("nodes", nodes), ("features", features), ("masks", masks)):
        if part is not None:
            part.write.mode("overwrite").parquet(os.path.join(path, name))


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The stored parts of a graph by name."""
    parts = {name: os.path.join(path, name) for name in ("nodes", "edges", "features", "masks")}
    return {name: spark.read.parquet(p) for name, p in parts.items() if path_exists(spark, p)}
