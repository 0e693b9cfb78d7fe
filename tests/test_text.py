"""Table-driven edge cases."""

from pyspark.sql import functions as F

from corpusloom.functions import text as tx


def test_combined_text_null_title_is_null(spark):
    df = spark.createDataFrame([("t", "a"), (None, "a"), ("t", None)], "title string, abstract string")
    got = [r[0] for r in df.select(tx.combined_text("title", "abstract")).collect()]
    assert got == ["t a", None, "t "]


def test_merge_codes_both_empty(spark):
    df = spark.createDataFrame([(None, None), ("A", None), (None, "B"), ("A", "B")], "c string, i string")
    got = [r[0] for r in df.select(tx.merge_codes("c", "i")).collect()]
    assert got == [";;", "A;;", ";;B", "A;;B"]


def test_explode_keys_keeps_empty_and_repeats(spark):
    df = spark.createDataFrame([("1", "a|a||b"), ("2", "")], "id string, k string")
    got = sorted((r.id, r.key) for r in tx.explode_keys(df, "k").collect())
    assert got == [("1", ""), ("1", "a"), ("1", "a"), ("1", "b"), ("2", "")]
    got = sorted((r.id, r.key) for r in tx.explode_keys(df, "k", drop_empty=True, distinct=True).collect())
    assert got == [("1", "a"), ("1", "b")]


def test_code_levels_edge_cases(spark):
    rows = [("",), ("H04L9/0891",), ("H04L",), ("H04L/1/2",), ("/5",), ("H/",)]
    df = spark.createDataFrame(rows, "c string")
    got = [r[0] for r in df.select(tx.code_levels("c")).collect()]
    # live level: main/sub only when sub is non-empty; a second '/' is cut
    assert got == [[], ["H04L9/0891"], [], ["H04L/1"], ["/5"], []]
    allv = [r[0] for r in df.select(tx.code_levels("c", tx.LEVELS)).collect()]
    assert allv[1] == ["H", "H04", "H04L", "H04L9/0891"]
    assert allv[0] == []


def test_same_code_in_both_columns_repeats_key(spark):
    df = spark.createDataFrame([("1", "A/1", "A/1")], "id string, c string, i string")
    k = tx.explode_keys(df.select("id", tx.normalise_codes(tx.merge_codes("c", "i")).alias("k")), "k")
    assert sorted(r.key for r in k.collect()) == ["A/1", "A/1"]


def test_pack_keyphrases_modes(spark):
    df = spark.createDataFrame([(["Cotton Fiber", "yarn"],), ([],)], "p array<string>")
    ref = [r[0] for r in df.select(tx.pack_keyphrases("p", split_words=True, casefold=False)).collect()]
    assert ref == ["Cotton|Fiber|yarn", ""]
    whole = [r[0] for r in df.select(tx.pack_keyphrases("p")).collect()]
    assert whole == ["cotton fiber|yarn", ""]


def test_distinct_phrases_trim_sort(spark):
    df = spark.createDataFrame([([" b", "a ", "b", "\ta"],)], "p array<string>")
    assert df.select(tx.distinct_phrases("p")).first()[0] == ["a", "b"]


def test_document_text_nulls(spark):
    df = spark.createDataFrame([(None, None)], "t string, a string")
    assert df.select(tx.document_text("t", "a")).first()[0] == "Title: \nAbstract: "


def test_split_keys_literal_separator(spark):
    df = spark.createDataFrame([("a.b|c",)], "k string")
    assert df.select(tx.split_keys(F.col("k"), ".")).first()[0] == ["a", "b|c"]
