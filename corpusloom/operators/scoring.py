"""Prompt rendering, response parsing, content-keyed embedding store and batch
model scoring (P11, P15, J5, J6, J8, L2, L3, L9, L10).

User models are plain Python callables run inside ``mapInPandas`` on Arrow
batches: ``embed_fn(list[str]) -> list[list[float]]`` and
``call_fn(list[str]) -> list[str]``.  Everything around the call (dedupe,
cache hits, parsing, top-2, error rows) is DataFrame work.
"""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.scores import (clean_response, parse_inputs, result_columns, scores_struct, store_key,
                                         top_two)
from corpusloom.operators.ranking import attach_scalars
from corpusloom.session import stage_path, stage_table

# Sentinels used while unescaping a format template (never valid
# in the template text itself).
_LBRACE, _RBRACE, _CATS, _TEXT = "\u0001", "\u0002", "\u0003", "\u0004"


# ----------------------------------------------------------------------------- P11 / J6

def template_segments(template: Column, categories: Sequence[str]) -> Column:
    """Split a ``str.format`` template with fields ``{categories}`` and
    ``{text}`` into literal segments around ``{text}``; doubled braces are
    unescaped and ``{categories}`` filled with the ', '-joined list."""
    t = F.replace(template, F.lit("{{"), F.lit(_LBRACE))
    t = F.replace(t, F.lit("{categories}"), F.lit(_CATS))
    t = F.replace(t, F.lit("{text}"), F.lit(_TEXT))
    t = F.replace(t, F.lit("}}"), F.lit(_RBRACE))
    t = F.replace(F.replace(t, F.lit(_LBRACE), F.lit("{")), F.lit(_RBRACE), F.lit("}"))
    t = F.replace(t, F.lit(_CATS), F.lit(", ".join(categories)))
    return F.split(t, _TEXT, -1)


def render_prompt(df: DataFrame, prompt: DataFrame, categories: Sequence[str], text_col: str,
                  out_col: str = "prompt") -> DataFrame:
    """P11 + J6: render the current prompt (a one-row frame, see S8) for every
    row.  The template is split once, in its own one-row frame, then attached by
    a broadcast join; row text is only ever *inserted*, never scanned for
    placeholders."""
    segs = prompt.select(template_segments(F.col("prompt_template"), categories).alias("_segs"))
    x = attach_scalars(df, segs)
    rendered = F.array_join(F.transform(F.col("_segs"), lambda s, i: F.when(i == 0, s).otherwise(
        F.concat(F.col(text_col), s))), "")
    return x.withColumn(out_col, rendered).drop("_segs")


# ----------------------------------------------------------------------------- P12-P15

def parse_responses(df: DataFrame, response_col: str = "response", out_col: str = "_p") -> DataFrame:
    """P12 + P13 as an operator: adds ``out_col`` = ``struct<ok, empty, scores>``.

    The two parses run once per row: they are produced by a ``Generate``
    (``inline`` of a one-element array), which Catalyst neither inlines into
    later projections nor pushes filters through — otherwise every column and
    filter that reads the parse would re-parse the text."""
    x = df.select("*", F.inline(F.array(F.struct(parse_inputs(clean_response(response_col)).alias("_pi")))))
    return x.withColumn(out_col, scores_struct(F.col("_pi.v"), F.col("_pi.m"))).drop("_pi")


def to_result_rows(df: DataFrame, response_col: str = "response", id_col: str = "LensID",
                   title_col: str = "Title", truth_col: str = "true_category") -> DataFrame:
    """Clean, parse, top-2 and shape result rows; any failure gives an
    'ERROR' row that keeps id, title and truth."""
    x = parse_responses(df, response_col)
    x = x.withColumn("_t", top_two(F.col("_p.scores")))
    return x.select(F.col(id_col).alias("LensID"), F.col(title_col).alias("Title"),
                    F.col(truth_col).alias("true_category"), *result_columns("_p", "_t"))


# ----------------------------------------------------------------------------- J8

def with_keyphrases(df: DataFrame, phrases: DataFrame, id_col: str = "lens_id",
                    col: str = "keyphrases") -> DataFrame:
    """Keyed write-back — every row of an id gets that id's keyphrases
    (a left join instead of one UPDATE per row)."""
    return (df.drop(col).join(phrases.select(id_col, col), id_col, "left")
            .select(*df.columns))


# ----------------------------------------------------------------------------- L10 / model calls

def _with_retries(fn: Callable, attempts: int, wait: tuple[float, float]):
    def call(batch):
        for k in range(attempts):
            try:
                out = list(fn(batch))
                if len(out) != len(batch):
                    raise ValueError(f"the model gave {len(out)} answers for {len(batch)} texts")
                return out
            except Exception:  # noqa: BLE001 - any model failure is retried, then surfaced
                if k == attempts - 1:
                    raise
                time.sleep(random.uniform(*wait))
    return call


#: rows, and bytes of ``in_col``, that a task of a wave should not exceed
TASK_ROWS = 1 << 16
TASK_BYTES = 1 << 26


def call_model(df: DataFrame, fn: Callable[[list[str]], list], in_col: str, out_col: str,
               out_type: T.DataType, max_parallel: int | None = None, batch_size: int = 64,
               attempts: int = 3, wait: tuple[float, float] = (1.0, 2.0),
               per_row_errors: bool = False, profile=None) -> DataFrame:
    """Run a user callable over ``in_col`` in Arrow batches of
    ``batch_size``.  At most ``max_parallel`` calls run at once: there are so many partitions.  Rows that
    would make these partitions large are asked now, in waves of ``max_parallel`` bounded tasks, and kept as
    a stage table; few rows are a lazy plan.
    On a cluster a ``profile`` (a Spark ResourceProfile whose tasks ask for a share of a custom
    ``model`` resource) bounds them by the resources of the task instead, so work stays in many
    small partitions and a retried task repeats only its own; a ``local`` master has no profiles.
    (``ledger.run_calls`` keeps both: waves of ``max_parallel`` small tasks.)  An answer of the
    wrong length counts as a failure.  With ``per_row_errors`` a batch that still
    fails after the retries is retried row by row and failing rows get null
    (the caller turns them into error rows)."""
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, out_type, True)])
    guarded = _with_retries(fn, attempts, wait)

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size].copy()
                texts = part[in_col].fillna("").tolist()
                try:
                    out = guarded(texts)
                except Exception:  # noqa: BLE001
                    if not per_row_errors:
                        raise
                    out = []
                    for t in texts:
                        try:
                            out.append(guarded([t])[0])
                        except Exception:  # noqa: BLE001
                            out.append(None)
                part[out_col] = pd.Series(out, index=part.index, dtype=object)
                yield part

    if not max_parallel or profile is not None:
        return df.mapInPandas(run, schema, profile=profile)
    rows = stage_table(df, "calls")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(in_col)), F.lit(0)).alias("bytes")).first()
    waves = max(1, math.ceil(size.n / (max_parallel * TASK_ROWS)), math.ceil(size.bytes / (max_parallel * TASK_BYTES)))
    if waves == 1:
        return rows.repartition(max_parallel).mapInPandas(run, schema)
    # every wave gets its share of every file, whatever the rows hold, and is written by several tasks
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_wave", (F.col("_at") % waves).cast("int"))
    dealt = dealt.withColumn("_at", F.floor(F.col("_at") / waves) % 8).repartition(8 * waves, "_wave", "_at").drop("_at")
    dealt = stage_table(dealt, "call-waves", ["_wave"])
    answers = stage_path(df.sparkSession, "answers")
    for wave in range(waves):
        part = dealt.where(F.col("_wave") == wave).drop("_wave").repartition(max_parallel)
        part.mapInPandas(run, schema).write.mode("append").parquet(answers)
    return df.sparkSession.read.schema(schema).parquet(answers)


# ----------------------------------------------------------------------------- L9

def zero_shot(df: DataFrame, prompt: DataFrame, categories: Sequence[str], call_fn: Callable,
              text_col: str = "text", id_col: str = "lens_id", title_col: str = "title",
              truth_col: str = "category", max_parallel: int | None = 10, profile=None) -> DataFrame:
    """Render -> call the model (3 attempts, 1-2 s jittered wait) -> clean,
    parse, top-2 -> result rows; a failing call becomes an 'ERROR' row.

    The result is a lazy plan: write it once (``io.write_results``, as the
    zero-shot workflow does) and read the file back before using it several
    times, so every record is sent to the model once."""
    r = result_prompts(df, prompt, categories, text_col, id_col, title_col, truth_col)
    answered = call_model(r, call_fn, "prompt", "response", T.StringType(),
                          max_parallel=max_parallel, per_row_errors=True, profile=profile)
    return to_result_rows(answered)


def result_prompts(df: DataFrame, prompt: DataFrame, categories: Sequence[str], text_col: str = "text",
                   id_col: str = "lens_id", title_col: str = "title", truth_col: str = "category") -> DataFrame:
    """``(LensID, Title, true_category, prompt)`` of every record."""
    r = df.select(F.col(id_col).alias("LensID"), F.col(title_col).alias("Title"),
                  F.col(truth_col).alias("true_category"), F.col(text_col).alias("_text"))
    return render_prompt(r, prompt, categories, "_text").drop("_text")


# ----------------------------------------------------------------------------- J5 / L2

def store_keys(texts: DataFrame, text_col: str, embedder: str) -> DataFrame:
    return texts.withColumn("content_key", store_key(text_col, embedder))


def missing_embeddings(texts: DataFrame, store: DataFrame | None, text_col: str,
                       embedder: str) -> DataFrame:
    """Distinct texts (by the whole hash) that the store does not hold yet; null
    texts count as one empty text."""
    k = store_keys(texts, text_col, embedder).select("content_key", F.coalesce(text_col, F.lit("")).alias("text")) \
        .dropDuplicates(["content_key"])
    if store is None:
        return k
    return k.join(store.select("content_key"), "content_key", "left_anti")


def new_embeddings(texts: DataFrame, embed_fn: Callable, store: DataFrame | None, text_col: str,
                   embedder: str, max_parallel: int | None = None, batch_size: int = 64, profile=None) -> DataFrame:
    """Rows ``(content_key, embedder, embedding)`` for the store misses only
    (a lazy plan: the model runs when it is written)."""
    miss = missing_embeddings(texts, store, text_col, embedder)
    return (call_model(miss, embed_fn, "text", "embedding", T.ArrayType(T.DoubleType()),
                       max_parallel=max_parallel, batch_size=batch_size, profile=profile)
            .select("content_key", F.lit(embedder).alias("embedder"), "embedding"))


def embed_texts(texts: DataFrame, embed_fn: Callable, store_path: str, text_col: str, embedder: str,
                max_parallel: int | None = None, batch_size: int = 64, profile=None) -> DataFrame:
    """L2: embed only the store misses, append them to the bucketed store, and return
    the input rows with their embedding (hits and misses alike) read back from
    the store.  The model runs exactly once per missing text — inside the
    append job, whose output commits atomically — and never again downstream
    (a retried task re-calls only its own batch; nothing is stored twice).  Stored vectors
    are never shuffled: keys and texts go to their buckets."""
    from corpusloom.sources.store import EmbeddingStore
    store = EmbeddingStore(texts.sparkSession, store_path, embedder)
    store.append(new_embeddings(texts, embed_fn, store.read(), text_col, embedder, max_parallel, batch_size, profile))
    return store_keys(texts, text_col, embedder).join(store.read(), "content_key", "left")


# ----------------------------------------------------------------------------- L3

def mean_pool(tokens: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """L3: masked mean of token vectors, divisor clamped at 1e-9; long form in
    ``(id, pos, dim, value, mask)`` and out ``(id, dim, value)``."""
    return (tokens.groupBy(id_col, "dim")
            .agg((F.sum(F.col("value") * F.col("mask")) / F.greatest(F.sum("mask").cast("double"), F.lit(1e-9)))
                 .alias("value")))
