"""Merging of token tags into spans (L1).

A token classifier gives each token of a text a tag and a score.  Tokens that follow each
other with one tag are a span; a tag that begins with ``B-`` begins a new one, ``I-`` goes on
with the last (a span may begin with ``I-``).  Spans of the tag ``O`` are no result.

Per text this is a gaps-and-islands problem: a running count of span beginnings numbers the
spans, and one aggregate by (text, span) puts them together.  A window holds the tokens of
one text, never more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUTSIDE = "O"
#: Fixed value: how byte-level vocabularies mark a token that follows a blank.
BLANK_MARK = "Ġ"


def merge_spans(tagged: DataFrame, id_col: str = "id", blank_mark: str = BLANK_MARK) -> DataFrame:
    """``(id, first, last, tag, phrase, n_tokens, score)`` from ``(id, pos, token, tag, score)``:
    ``first`` and ``last`` are positions, ``score`` is the mean of the tokens'.  A null tag is
    ``O``; tokens at one position follow each other in their own order."""
    begins = F.col("tag").startswith("B-")
    kind = F.when(F.col("tag").rlike("^[BI]-"), F.substring("tag", 3, 1 << 30)).otherwise(F.col("tag"))
    x = (tagged.select(F.col(id_col).alias("_id"), "pos", "token", F.coalesce("tag", F.lit(OUTSIDE)).alias("tag"), "score")
         .withColumn("_begins", begins).withColumn("_kind", kind))
    order = Window.partitionBy("_id").orderBy("pos", "token")
    new = F.col("_begins") | ~F.col("_kind").eqNullSafe(F.lag("_kind").over(order))
    x = x.withColumn("_new", new.cast("int"))
    x = x.withColumn("_span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = x.where(F.col("_kind") != OUTSIDE).groupBy("_id", "_span").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("_kind").alias("tag"),
        F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("_tokens"), F.avg("score").alias("score"))
    text = F.replace(F.concat_ws("", F.col("_tokens.token")), F.lit(blank_mark), F.lit(" "))
    return spans.select(F.col("_id").alias(id_col), "first", "last", "tag", F.trim(text).alias("phrase"),
                        F.size("_tokens").alias("n_tokens"), "score")
