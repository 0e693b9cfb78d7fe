"""Ledger of model calls (L9, S9): answers are kept as they arrive, and a run that was stopped
goes on where it ended.

The ledger is a folder of Parquet files ``(call_key, response, ok)``.  Calls are made in waves of
``max_parallel`` tasks; the files of a task are moved into the ledger when the task ends (the file
committer's second algorithm), not when the job does.  So what a job had finished before it was
stopped stays.  A run asks only for prompts without an answer that could be parsed.

Each distinct prompt is one call, named by the sha-256 of its text.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.scoring import call_model, parse_responses, to_result_rows
from corpusloom.session import stage_table
from corpusloom.sources import io

LEDGER_SCHEMA = "call_key string, response string, ok boolean"
ROWS_PER_TASK = 64


def call_key(prompt: str = "prompt"):
    return F.sha2(F.coalesce(F.col(prompt), F.lit("")), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row a key: an answer that could be parsed if there is one, else any other."""
    if not io.path_exists(spark, path):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    found = spark.read.schema(LEDGER_SCHEMA).parquet(path)
    return found.groupBy("call_key").agg(F.max(F.struct("ok", "response")).alias("r")).select("call_key", "r.response", "r.ok")


def pending(prompts: DataFrame, path: str, prompt_col: str = "prompt") -> DataFrame:
    """``(call_key, prompt)`` of the distinct prompts that the ledger has no good answer for."""
    keyed = (prompts.select(call_key(prompt_col).alias("call_key"), F.col(prompt_col).alias("prompt"))
             .groupBy("call_key").agg(F.min("prompt").alias("prompt")))
    done = read_ledger(prompts.sparkSession, path).where("ok").select("call_key")
    return keyed.join(done, "call_key", "left_anti")


def run_calls(prompts: DataFrame, call_fn: Callable, path: str, prompt_col: str = "prompt", max_parallel: int = 10,
              rows_per_task: int = ROWS_PER_TASK, batch_size: int = 64, profile=None, **call_options) -> int:
    """Asks the model for all pending prompts and returns how many there were.

    At most ``max_parallel`` calls run at once: a wave has as many tasks.  With a resource
    ``profile`` the bound is the profile's, and one wave of small tasks does it."""
    spark = prompts.sparkSession
    todo = stage_table(pending(prompts, path, prompt_col), "pending-calls")
    n = todo.count()
    waves = 1 if profile is not None else max(1, math.ceil(n / (max_parallel * rows_per_task)))
    place = F.conv(F.substring("call_key", 1, 12), 16, 10).cast("long")
    tasks = math.ceil(n / rows_per_task) if profile is not None else max_parallel
    if n:
        dealt = todo.withColumn("wave", (place % waves).cast("int"))
        if waves > 1:  # a folder for each wave, so that each reads only its own
            dealt = stage_table(dealt.repartition(max(1, min(waves, 200)), "wave"), "call-waves", ["wave"])
        for wave in range(waves):
            part = dealt.where(F.col("wave") == wave).select("call_key", "prompt").repartition(max(1, tasks))
            answered = call_model(part, call_fn, "prompt", "response", T.StringType(), batch_size=batch_size, per_row_errors=True,
                                  profile=profile, **call_options)
            parsed = parse_responses(answered, "response", "_p")
            rows = parsed.select("call_key", "response", F.coalesce(F.col("_p.ok"), F.lit(False)).alias("ok"))
            rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    return n


def ledger_results(records: DataFrame, path: str, prompt_col: str = "prompt") -> DataFrame:
    """Result rows (P12-P15) of ``records(LensID, Title, true_category, prompt)``; a record without a good
    answer is an error row."""
    answers = read_ledger(records.sparkSession, path).select("call_key", "response")
    keyed = records.withColumn("call_key", call_key(prompt_col))
    return to_result_rows(keyed.join(answers, "call_key", "left"))
