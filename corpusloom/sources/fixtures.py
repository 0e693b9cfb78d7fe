"""Inputs equivalent to the reference's record files, derived from the driver's
tables with plain DataFrame work (see FIXTURES.md part B).  Every fixture is a
lazy plan over the given tables, so its size grows with them.

The DuckDB twins of these definitions live in ``corpusloom.plans.sql_fixtures``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import table

# Class labels of the vector/response fixtures are 'c1'..'c5'.
N_VECTOR_CLASSES = 5


def _code(part_type: Column, size: Column, partkey: Column) -> Column:
    """Class-code stand-in: first letter of the part type, size padded to 2,
    'L', partkey mod 7, '/', partkey mod 9."""
    return F.concat(F.substring(part_type, 1, 1), F.lpad(size.cast("string"), 2, "0"),
                    F.lit("L"), (partkey % 7).cast("string"), F.lit("/"),
                    (partkey % 9).cast("string"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FB1 ``records(lens_id, title, abstract, cpc, ipcr, category)``.

    One row per document; codes come from the order whose key equals the
    document id (odd line numbers -> cpc, even -> ipcr), sorted, distinct and
    joined by ';;'; null when the order has no such lines.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    # lines of orders that are no document meet no part and are not grouped
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("l_orderkey"))
    codes = (li.join(ids, "l_orderkey", "left_semi").join(part, F.col("l_partkey") == part.p_partkey)
             .select(F.col("l_orderkey").cast("string").alias("lens_id"),
                     (F.col("l_linenumber") % 2 == 1).alias("odd"),
                     _code(F.col("p_type"), F.col("p_size"), F.col("p_partkey")).alias("code")))
    # collect_set per order is bounded by the lines of one order.
    per_doc = (codes.groupBy("lens_id")
               .agg(F.array_sort(F.collect_set(F.when(F.col("odd"), F.col("code")))).alias("c"),
                    F.array_sort(F.collect_set(F.when(~F.col("odd"), F.col("code")))).alias("i"))
               .select("lens_id",
                       F.when(F.size("c") > 0, F.array_join("c", ";;")).alias("cpc"),
                       F.when(F.size("i") > 0, F.array_join("i", ";;")).alias("ipcr")))
    # joined by the id that later joins use, too, so that texts are shuffled once
    return (_documents(spark, sf_dir).join(per_doc, "lens_id", "left")
            .select("lens_id", "title", "abstract", "cpc", "ipcr", "category"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without their codes."""
    nl = F.instr(F.col("text"), "\n")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("lens_id"),
        F.substring_index(F.col("text"), "\n", 1).alias("title"),
        F.when(nl > 0, F.expr("substring(text, instr(text, '\\n') + 1)")).alias("abstract"),
        F.col("lang").alias("category"))


def labels(records_: DataFrame, col: str = "category") -> list[str | None]:
    """The distinct labels of the data (a handful of files' worth), a null one included."""
    return sorted((r[0] for r in records_.select(col).distinct().collect()), key=lambda x: (x is None, x))


def vector_category(label: Column) -> Column:
    return F.concat(F.lit("c"), (label % N_VECTOR_CLASSES + 1).cast("string"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FB5 ``vectors(vec_id, embedding array<double>, category)``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id",
                    F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
                    vector_category(F.col("label")).alias("category"))


def _score(i: int) -> Column:
    v = F.element_at(F.col("embedding"), i).cast("double")
    return F.floor(F.least(F.abs(v), F.lit(0.999)) * 1000).cast("int")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FB3 ``responses(vec_id, true_category, s1..s5, response)``.

    ``response`` plays a model answer; its shape is chosen by ``vec_id % 20``:
    0 malformed word, 1 JSON list, 2 empty object, 3 valid + trailing text,
    4 fenced, 5 ``scores`` null, 6 and 7 a score that is a string, otherwise valid.
    """
    e = table(spark, sf_dir, "embeddings")
    base = e.select("vec_id", vector_category(F.col("label")).alias("true_category"),
                    *[_score(i).alias(f"s{i}") for i in range(1, 6)])
    txt = [F.concat(F.lit("0."), F.lpad(F.col(f"s{i}").cast("string"), 3, "0")) for i in range(1, 6)]
    scores = F.concat(F.lit('{"c1": '), txt[0], F.lit(', "c2": '), txt[1], F.lit(', "c3": '),
                      txt[2], F.lit(', "c4": '), txt[3], F.lit(', "c5": '), txt[4], F.lit("}"))
    valid = F.concat(F.lit('{"predicted_label": "c1", "confidence": '), txt[0],
                     F.lit(', "scores": '), scores, F.lit("}"))
    case = F.col("vec_id") % 20
    resp = (F.when(case == 0, F.lit("unparseable"))
            .when(case == 1, F.concat(F.lit("["), scores, F.lit("]")))
            .when(case == 2, F.lit("{}"))
            .when(case == 3, F.concat(valid, F.lit(" thanks")))
            .when(case == 4, F.concat(F.lit("```json\n"), valid, F.lit("\n```")))
            .when(case == 5, F.lit('{"predicted_label": null, "scores": null}'))
            .when(case == 6, F.lit('{"scores": {"c1": "NaN", "c2": 0.3}}'))
            .when(case == 7, F.lit('{"scores": {"c1": 0.3, "c2": "Infinity"}}'))
            .otherwise(valid))
    return base.withColumn("response", resp)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FB4 ``tokens(vec_id, pos, dim, value, mask)``: the 64 floats of one
    embedding read as 8 tokens x 8 dims; mask 1 for the first vec_id % 8 + 1
    tokens."""
    e = table(spark, sf_dir, "embeddings")
    x = e.select("vec_id", F.posexplode("embedding").alias("i", "v"))
    pos = F.floor(F.col("i") / 8).cast("int")
    return x.select("vec_id", pos.alias("pos"), (F.col("i") % 8).cast("int").alias("dim"),
                    F.col("v").cast("double").alias("value"),
                    F.when(pos < F.col("vec_id") % 8 + 1, 1).otherwise(0).alias("mask"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FB8 ``baskets(id, key)``: parts linked by a common order."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").cast("string").alias("id"),
                     F.col("l_orderkey").cast("string").alias("key")).distinct()


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FB2 with provenance: records plus ``source_file`` (the document source),
    standing in for the per-file origin of each record."""
    src = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("lens_id"),
                                                   F.col("source").alias("source_file"))
    return records(spark, sf_dir).join(src, "lens_id")


def with_keyphrases(spark: SparkSession, sf_dir: str, codes: bool = True) -> DataFrame:
    """Records with ``phrases`` (the L1 keyphrases of title and abstract, sorted) and
    ``keyphrases`` (packed whole, P10); the same rows without ``codes`` read no other table than documents."""
    from corpusloom.operators.keyphrases import extract_keyphrases
    # title and abstract are the document's text cut at a line break, so its tokens are theirs
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = extract_keyphrases(docs, "doc_id", "text").withColumn("lens_id", F.col("doc_id").cast("string")).drop("doc_id")
    return (records if codes else _documents)(spark, sf_dir).join(k, "lens_id")


# The instruction block appended to every prompt template.
PROMPT_TAIL = ("\nCategories: {categories}\nText: {text}\n"
               'Reply with JSON {{"scores": {{"<category>": <score>}}}}')


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FB6 ``prompts(id, prompt_template)``: every system turn of the
    conversations table with our instruction block (both placeholders and
    doubled braces) appended; id = conv_id * 1000 + turn."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "system")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
                    F.concat(F.col("text"), F.lit(PROMPT_TAIL)).alias("prompt_template"))
