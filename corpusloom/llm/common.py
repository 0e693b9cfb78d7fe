"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stage_table

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row (a lambda variable
    bound by a one-element ``transform``), however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; null text: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK, -1), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``, equals ``remainder``
    (a null id hashes as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == remainder


def unit_hash(seed: str, *parts: Column) -> Column:
    """A uniform number in [0, 1) from the first 52 bits of an md5, the same in
    every engine that has md5."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no other column of the input can clash
    with a name that an operator uses inside."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that columns put beside it cannot clash;
    ``select("row.*")`` gives them back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` (undirected; ids of any
    orderable type): root is the smallest node that can be reached.

    Each round takes ``near``, the smallest label's label among a node's neighbours, to
    lower the node's own label and that of the root it pointed to, so whole trees are
    hooked on each other and trees get flat as they grow, in whatever order the ids lie
    (chains of 1,000 and 100,000 nodes in random order settle in 11 and 18 rounds).
    Labels only ever fall, so the rounds end by themselves: when no label changes, a
    node and its neighbours have the same one.  Every round is a stage table; only
    whether a label changed comes to the driver."""
    both = stage_table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = stage_table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        tops = labels.join(above, "root").select("node", "root", "top")
        near = (both.join(tops.select(F.col("node").alias("b"), "top"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("top").alias("near")))
        step = stage_table(tops.join(near, "node"), "steps")
        hooks = step.groupBy(F.col("root").alias("node")).agg(F.min("near").alias("hook"))
        nxt = stage_table(step.join(hooks, "node", "left")
                          .select("node", F.least("top", "near", "hook").alias("root"), F.col("root").alias("old")), "labels")
        labels = nxt.drop("old")
        if nxt.where(F.col("root") != F.col("old")).isEmpty():
            return labels
