"""Quality rules by distribution divergence.

Each language gets two reference histograms from all its documents: character
classes, and its most common words (with one bin for all other words).  A
document's own histograms are compared with those of its language by the
Jensen-Shannon distance (base 2, so 0 to 1).  A document that is long enough for a
histogram to mean something fails if a distance is above its limit.  The limit of the
common words follows from the language's own reference: it is a share of the distance that
a text without any of its common words has.

Besides, the plain rules: ``base_failed`` if there are fewer than ``MIN_WORDS``
words, or more than ``MAX_REPEAT_PERCENT`` percent of the words lie in 5-word
windows that the text has twice or more.

All of it is DataFrame expressions.

Defined cases: a null or empty text has no words and fails the base rules; a null
language is a language of its own; rows that repeat an id are documents of their
own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import let, own_columns, words
from corpusloom.session import stage_table

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
COMMON_WORDS = 50
SYMBOLS = "#*$%&|<>"
#: Tables with a row for each language are broadcast up to so many, by a count.
FEW_LANGUAGES = 1000
#: A histogram is judged from so many characters or words on; greater distances fail.
MIN_CLASS_CHARS = 300
MAX_CLASS_DISTANCE = 0.28
MIN_COMMON_WORDS = 80
#: Share of the distance of a text without any common word.
MAX_COMMON_SHARE = 0.955


def n_repeat_words(tokens: Column) -> Column:
    """Words in windows of WINDOW words that the array has twice or more.  Windows are
    told apart by 64-bit hashes; only texts with two equal ones sort them."""
    last = F.size(tokens) - WINDOW

    def hashed(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)]))

    def covered(pairs: Column) -> Column:
        """pairs: (window, position) in order; counts the words under repeated windows."""
        ws, no = F.transform(pairs, lambda x: x["w"]), F.array(F.lit(False))
        same = let(ws, lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1),
                                            lambda x, y: x == y))
        again = let(same, lambda eq: F.zip_with(F.concat(no, eq), F.concat(eq, no), lambda x, y: x | y))
        at = F.sort_array(F.filter(F.zip_with(again, pairs, lambda yes, x: F.when(yes, x["p"])), lambda p: p.isNotNull()))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
        return F.aggregate(at, start, lambda acc, p: F.struct(
            (p + WINDOW).alias("end"), (acc["sum"] + p + WINDOW - F.greatest(p, acc["end"])).alias("sum")),
            lambda acc: acc["sum"])

    def counted(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hs)) < F.size(hs), let(pairs, covered)).otherwise(F.lit(0))

    return F.when(last < 1, F.lit(0)).otherwise(
        let(let(F.transform(tokens, lambda w: F.xxhash64(w)), hashed), counted)).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long")


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def char_counts(text: Column) -> Column:
    """Struct of ``word_chars``, ``n_symbols`` and ``classes``: the number of a-z, A-Z, other
    letters, digits, punctuation, symbols, white space and other characters.

    a-z and spaces, most of a text, are taken out first; the other classes are counted
    in what is left."""
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))

    def counted(c: Column) -> Column:
        rest = c["rest"]
        blanks = c["spaces"] + _without(rest, r"[\x09-\x0D]+")
        symbols = F.length(rest) - F.length(F.translate(rest, SYMBOLS, ""))
        named = F.array(*[x.cast("long") for x in (
            c["n"] - F.length(rest) - c["spaces"], _without(rest, "[A-Z]+"), _without(rest, r"[\p{L}&&[^A-Z]]+"),
            _without(rest, "[0-9]+"), _without(rest, r"[.,;:!?()'\"-]+"), symbols, blanks)])
        return let(named, lambda a: F.struct(
            (c["n"] - a[6]).alias("word_chars"), a[5].alias("n_symbols"),
            F.concat(a, F.array(c["n"] - F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x))).alias("classes")))

    return let(F.struct(F.regexp_replace(text, "[a-z ]+", "").alias("rest"), spaces.alias("spaces"),
                        F.length(text).cast("long").alias("n")), counted)


def _common_words(docs: DataFrame, k: int) -> DataFrame:
    """``(lang, common)``: the k most frequent words of each language over all its
    documents (ties by the word), in code point order."""
    tokens = docs.select("lang", F.explode(words(F.col("text"))).alias("word"))
    counts = tokens.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return (counts.withColumn("k", F.row_number().over(top)).where(F.col("k") <= k)
            .groupBy("lang").agg(F.sort_array(F.collect_list("word")).alias("common")))


def _common_counts(tokens: Column, common: Column, n_words: Column) -> Column:
    """How often ``tokens`` has each word of ``common``, and last, how many of all
    ``n_words`` words are none of them."""
    spaced = F.concat(F.lit(" "), F.concat_ws("  ", tokens), F.lit(" "))

    def each(s: Column) -> Column:
        return F.transform(common, lambda w: ((F.length(s) - F.length(F.replace(s, F.concat(F.lit(" "), w, F.lit(" ")),
                                                                                 F.lit(""))))
                                              / (F.length(w) + 2)).cast("long"))

    return let(let(spaced, each), lambda a: F.concat(a, F.array(
        n_words - F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of one length; null if one is all zero."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def side(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def divergence(ab: Column) -> Column:
        parts = F.zip_with(ab["a"], ab["b"], lambda x, y: side(x / ab["n"], (x / ab["n"] + y / ab["m"]) / 2)
                           + side(y / ab["m"], (x / ab["n"] + y / ab["m"]) / 2))
        return F.when((ab["n"] > 0) & (ab["m"] > 0),
                      F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2)))

    return let(F.struct(p.alias("a"), q.alias("b"), total(p).alias("n"), total(q).alias("m")), divergence)


def _sum_arrays(df: DataFrame, by: str, name: str) -> DataFrame:
    """The sum of the arrays ``name`` in each group, entry by entry."""
    entries = df.select(by, F.posexplode(name).alias("i", "x")).groupBy(by, "i").agg(F.sum("x").alias("x"))
    return entries.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("_e")).select(
        by, F.transform("_e", lambda e: e["x"]).alias(name))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             common_words: int = COMMON_WORDS) -> DataFrame:
    """A stage table with the counts and the two histograms of every document."""
    rows = own_columns(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang").withColumn(
        "text", F.coalesce("text", F.lit("")))
    common = stage_table(_common_words(rows, common_words), "common-words")
    few = common.count() <= FEW_LANGUAGES
    # the common words of any language, which leaves little of a text to count in
    known = sorted({w for (ws,) in common.select("common").collect() for w in ws}) if few else []
    text = F.col("text")
    counted = rows.select("doc_id", "lang", "text", words(text).alias("tokens"))
    frequent = F.filter("tokens", lambda w: w.isin(known)) if known else F.col("tokens")
    counted = counted.select(
        "doc_id", "lang", F.size("tokens").cast("long").alias("n_words"), char_counts(text).alias("chars"),
        n_dup_lines(text).alias("n_dup_lines"), n_repeat_words(F.col("tokens")).alias("n_repeat_words"),
        frequent.alias("frequent"))
    common = common.select(F.col("lang").alias("_lang"), "common")
    found = counted.join(F.broadcast(common) if few else common, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    own = _common_counts(F.col("frequent"), F.coalesce("common", F.array().cast("array<string>")), F.col("n_words"))
    return stage_table(found.select("doc_id", "lang", "n_words", "chars.word_chars", "chars.n_symbols", "n_dup_lines",
                                    "n_repeat_words", "chars.classes", own.alias("common")), "quality")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            common_words: int = COMMON_WORDS, max_class_distance: float = MAX_CLASS_DISTANCE,
            max_common_share: float = MAX_COMMON_SHARE) -> DataFrame:
    """Counts, distances and verdict of every document."""
    rows = features(docs, id_col, text_col, lang_col, common_words)
    refs = _sum_arrays(rows, "lang", "classes").toDF("_lang", "_classes")
    both = stage_table(refs.join(_sum_arrays(rows, "lang", "common").toDF("_lang2", "_common"),
                                 F.col("_lang").eqNullSafe(F.col("_lang2"))).drop("_lang2"), "references")
    # a text without any common word has all its words in the last bin
    none = F.transform("_common", lambda x, i: F.when(i == F.size("_common") - 1, 1.0).otherwise(0.0))
    both = both.withColumn("_limit", F.coalesce(js_distance(none, F.col("_common").cast("array<double>")), F.lit(0.0)) * max_common_share)
    few = both.count() <= FEW_LANGUAGES
    compared = rows.join(F.broadcast(both) if few else both, F.col("lang").eqNullSafe(F.col("_lang")), "left")

    def doubles(name: str) -> Column:
        return F.col(name).cast("array<double>")

    return _verdict(compared.withColumn("class_distance", js_distance(doubles("classes"), doubles("_classes")))
                    .withColumn("common_distance", js_distance(doubles("common"), doubles("_common"))),
                    max_class_distance)


def _verdict(df: DataFrame, max_class: float) -> DataFrame:
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    odd: Callable[[str, Column, int, Column], Column] = lambda name, size, least, most: (
        (size >= least) & (F.coalesce(F.col(name), F.lit(0.0)) > most))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                     base.alias("base_failed"),
                     (~base & ~odd("class_distance", F.col("word_chars"), MIN_CLASS_CHARS, F.lit(max_class))
                      & ~odd("common_distance", n, MIN_COMMON_WORDS, F.col("_limit"))).alias("kept"),
                     "class_distance", "common_distance", F.col("_limit").alias("common_limit"), "lang")
