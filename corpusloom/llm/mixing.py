"""Mixing sources to target weights.

Sizes (words) are summed per source; each source gets a target by weight, no
target above ``max_repeats`` times its source's size, the excess shared anew by
weight.  The repetition rate of a source is target / size, and each document is
emitted floor(rate) times plus one Bernoulli copy, seeded by a hash of its id,
with probability equal to the fraction.

Defined cases: a null source is a source of its own and ranks last; null, empty
and blank texts have size 0; a source without words has target 0 and rate 0 (its
documents are emitted 0 times); rows that repeat an id are separate documents
with the same draw; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import n_words, own_columns, packed, unit_hash
from corpusloom.operators.ranking import ordered_rank
from corpusloom.session import stage_table

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)
MAX_REPEATS = 2
SEED = "mix"
#: A table of rates is broadcast up to so many sources; beyond, it is joined by salted keys.
BROADCAST_SOURCES = 100_000
SALTS = 64


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_size, target, rate)`` from rows ``(source, size)``.

    Sources in code point order take ``weights`` in turn.  Together the targets
    are ``share`` (a fraction) of all sizes.  The water level is found by rounds of
    clipping; only sums come to the driver, and the sums are exact integers."""
    totals = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = ordered_rank(totals, [F.col("source").asc_nulls_last()], "rank")
    pick = F.array(*[F.lit(int(w)) for w in weights])
    table = stage_table(ranked.select("source", "source_size",
                                      F.get(pick, (F.col("rank") % len(weights)).cast("int")).cast("long")
                                      .alias("weight")), "sources")
    num, den = share
    whole = int(table.agg(F.sum("source_size")).first()[0] or 0)
    capped, level, seen = F.lit(False), (0, 1), -1
    while True:
        row = table.agg(F.sum(F.when(capped, F.col("source_size"))).alias("full"),
                        F.sum(F.when(~capped, F.col("weight"))).alias("open"),
                        F.count(F.when(capped, 1)).alias("n")).first()
        if row.n == seen or not row.open:
            break
        seen = row.n
        # what is left for the open sources, per unit of weight
        level = (num * whole - den * max_repeats * int(row.full or 0), den * int(row.open))
        capped = F.col("source_size") * float(max_repeats) <= F.col("weight") * (level[0] / level[1])
    target = F.when(capped, F.col("source_size") * float(max_repeats)).otherwise(
        (F.col("weight") * F.lit(level[0])).cast("double") / F.lit(float(level[1])))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return table.select("source", "source_size", target.alias("target")).withColumn("rate", rate)


def _copies(rate: Column, doc_id: Column, seed: str) -> Column:
    extra = unit_hash(seed, doc_id) < rate - F.floor(rate)
    return (F.floor(rate) + extra.cast("long")).cast("long")


def _with_rates(rows: DataFrame, source: Column, salt_by: Column, rates: DataFrame) -> DataFrame:
    """Attach each row's source columns (``_source, _source_size, _target, _rate``).  Rates
    are one row per source: broadcast when a count shows that they are few, else
    joined on (source, salt) so that no source is one task's work."""
    rates = rates.select(*[F.col(c).alias("_" + c) for c in rates.columns])
    if rates.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(rates), source.eqNullSafe(rates["_source"]), "left")
    salted = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    row_salt = F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")
    return rows.join(salted, source.eqNullSafe(salted["_source"]) & (row_salt == salted["_salt"]), "left")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             seed: str = SEED, **targets) -> DataFrame:
    """``doc_id, size, source_size, target, copies`` of every document."""
    sized = stage_table(own_columns(docs, id_col, text_col, source_col).toDF("doc_id", "text", "source")
                        .select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    rates = source_targets(sized, **targets)
    return (_with_rates(sized, sized["source"], sized["doc_id"], rates)
            .select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
                    _copies(F.col("_rate"), F.col("doc_id"), seed).alias("copies")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: str = SEED, **targets) -> DataFrame:
    """The mix itself: every row of ``docs`` repeated as often as the mix takes it,
    with all its columns."""
    sized = own_columns(docs, text_col, source_col).toDF("text", "source").select(
        "source", n_words(F.col("text")).alias("size"))
    rates = source_targets(sized, **targets)
    rows = packed(docs)
    doc_id, source = rows["row"][id_col], rows["row"][source_col]
    copies = _copies(F.col("_rate"), doc_id, seed)
    return (_with_rates(rows, source, doc_id, rates)
            .select("row", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("_copy")).select("row.*"))
