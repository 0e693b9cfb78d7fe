"""Rows with nulls, empty and long texts, ties, repeats and clashing column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG_LINE = "This line is long enough to count as a passage that documents share"
NAMES = ["size", "copies", "fp", "key", "keys", "n", "common", "classes", "held", "block", "range", "tie", "features", "_id"]


def rows() -> list[tuple]:
    prose = "the cat sat on the mat and then the dog came in from the rain to sleep by the fire all day"
    out = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, 6), (4, "one", "en", "b", 3),
           (5, prose, "en", "b", len(prose)), (5, prose, "en", "b", len(prose)), (6, prose.upper(), "en", None, 1),
           (None, "no id here at all", "de", "c", 4), (None, None, None, None, None),
           (7, "word " * 30000, "en", "a", 150000), (8, "a" * 50000, "fr", "a", 50000), (9, "1234 !!! ###", "fr", "c", 12),
           (10, "<|endoftext|> ünï­cödé 日本語 \r\n\x85", "de", "c", 9)]
    return out + [(20 + i, f"{LONG_LINE}\nand line {i} of its own\n  {LONG_LINE.upper()} ", "en", "d", 1) for i in range(6)]


def awkward(spark: SparkSession) -> DataFrame:
    """The rows, with extra columns whose names operators use inside."""
    df = spark.createDataFrame(rows(), SCHEMA)
    for name in NAMES:
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
