"""Incremental embedding store fed by Structured Streaming.

The reference has no streaming operator; its embedding cache (J5/L2) is what
makes an incremental feed possible: each micro-batch embeds only the texts
whose content key the store does not hold yet and appends them.  Re-running a
micro-batch after a failure is harmless — the anti-join against the store
skips keys a committed earlier attempt already wrote, so the store stays
duplicate-free.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.scoring import new_embeddings
from corpusloom.sources.store import EmbeddingStore


def embed_batch(batch: DataFrame, embed_fn: Callable, store_path: str, text_col: str, embedder: str) -> None:
    """One micro-batch: embed the store misses and append them."""
    spark = batch.sparkSession
    store = EmbeddingStore(spark, store_path, embedder)
    store.append(new_embeddings(batch, embed_fn, store.read(), text_col, embedder))


def start_embedding_feed(spark: SparkSession, source_path: str, schema: T.StructType, text_col: str,
                         embed_fn: Callable, store_path: str, embedder: str, checkpoint_location: str,
                         available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Watch a folder of Parquet text files and keep the store up to date.
    ``available_now`` processes what is there and stops (batch-style
    back-fill); otherwise it keeps running.  ``checkpoint_location`` must be
    on shared storage (e.g. under ``spark.checkpoint.dir``)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_path)
    w = (stream.writeStream
         .foreachBatch(lambda df, _epoch: embed_batch(df, embed_fn, store_path, text_col, embedder))
         .option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
