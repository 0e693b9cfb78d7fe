"""Keyphrase extraction as a corpus job (L1).

The reference runs a token-classification model per text.  Here the default is
a TF-IDF extractor over whole texts: tokenise, build 1..3-word candidates that contain
no stop word, count term frequency per document and document frequency per phrase
(``operators/grams``: blocks of documents send hashes of their phrases and get the
counts back, no candidate is shuffled as text), score ``tf * ln(N / df)`` and keep the
top ``k`` per document.  A user model can be plugged in instead (``method=callable``,
run with ``mapInPandas``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import distinct_phrases, pack_keyphrases
from corpusloom.operators.grams import best_grams
from corpusloom.operators.spans import BLANK_MARK, merge_spans
from corpusloom.session import stage_table

# Token pattern and the stop words (English, French, German,
# Spanish) that split candidate phrases.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "its", "of",
    "on", "or", "that", "the", "this", "to", "was", "were", "which", "with",
    "au", "aux", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les",
    "ou", "par", "pas", "pour", "qui", "que", "sur", "un", "une",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ist", "im", "mit", "nicht",
    "sich", "und", "von", "zu",
    "al", "con", "del", "el", "es", "las", "lo", "los", "para", "por", "se", "su", "una", "y",
)


def tokens(text: Column) -> Column:
    """Lower-cased word tokens of the whole text (empty pieces dropped)."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT, -1), lambda t: t != "")


def token_ok(toks: Column, stop_words: Sequence[str] = STOP_WORDS, min_len: int = 1) -> Column:
    """Per token: long enough and not a stop word."""
    # ``isin`` over many literals is planned as a hash-set lookup.
    return F.transform(toks, lambda t: (F.length(t) >= min_len) & ~t.isin(list(stop_words)))


def candidates(toks: Column, ok: Column, max_words: int = 3) -> Column:
    """All 1..``max_words``-grams of consecutive tokens whose tokens are all
    ``ok``.  Linear in the text: the n-gram array is the token array zipped
    with its own shifted copies (``zip_with`` pads the tail with nulls, which
    drop out)."""
    grams = []
    for n in range(1, max_words + 1):
        gram, flag = toks, ok
        for j in range(1, n):
            gram = F.zip_with(gram, F.slice(toks, j + 1, F.size(toks)), lambda a, b: F.concat(a, F.lit(" "), b))
            flag = F.zip_with(flag, F.slice(ok, j + 1, F.size(ok)), lambda a, b: a & b)
        g = F.filter(F.zip_with(gram, flag, lambda s, f: F.when(f, s)), lambda s: s.isNotNull())
        grams.append(F.when(F.size(toks) >= n, g).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*grams))


def tfidf_keyphrases(docs: DataFrame, id_col: str, text_col: str, k: int = 10, max_words: int = 3,
                     min_len: int = 1) -> DataFrame:
    """L1 (tfidf): ``(id, rank, phrase, score, tf, df)`` — top ``k`` per document
    by ``tf * ln(N / df)``, ties by phrase.  Tokens shorter than ``min_len`` end a phrase
    like a stop word (by default none are)."""
    top = _top_phrases(docs, id_col, text_col, k, max_words, min_len)
    x = top.select(id_col, F.posexplode("top").alias("_i", "_p"))
    return x.select(id_col, (F.col("_i") + 1).alias("rank"), "_p.phrase", (-F.col("_p.less")).alias("score"), "_p.tf", "_p.df", "_p.cf")


def _one_of(words: Sequence[str]) -> str:
    """A pattern of the words, branching letter by letter: few branches are tried for each."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    branches = [re.escape(c) + _one_of(rest) for c, rest in heads.items() if c]
    return f"(?:{'|'.join(branches)})" + "?" * ("" in heads) if branches else ""


def _top_phrases(docs: DataFrame, id_col: str, text_col: str, k: int, max_words: int, min_len: int) -> DataFrame:
    """``(id, top)`` for each id with phrases: ``top`` holds ``(less, phrase, tf, df, cf)`` of the best ``k`` in order,
    ``less`` being the score with its sign changed."""
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter(F.col("_t").isNotNull())
    size = d.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("_t")), F.lit(0)).alias("chars")).first()
    # no phrase has a stop word or goes on beyond it: two spaces stand for a run of these
    words = F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace(F.lower("_t"), TOKEN_SPLIT, " "), F.lit(" ")),
                             f" (?:{_one_of(STOP_WORDS)} )++", "  ")
    found = best_grams(d.select("_id", words.alias("_t")), k, max_words, min_len, STOP_WORDS, size.n, size.chars)
    # scores and their order are the engine's; only the best of each document get here
    less = F.transform("top", lambda p: F.struct((-(p.tf * F.log(F.lit(size.n) / p.df))).alias("less"), p.phrase.alias("phrase"),
                                                 p.tf.alias("tf"), p.df.alias("df"), p.cf.alias("cf")))
    return found.select(F.col("_id").alias(id_col), F.slice(F.array_sort(less), 1, k).alias("top"))


#: A phrase of whatever frequency is one entry of each block of documents, so none is counted apart any more.
HOT_SHARE = 64
HOT_SEEN = 512


def extract_keyphrases(docs: DataFrame, id_col: str, text_col: str, k: int = 10,
                       method: str | Callable[[list[str]], list[list[str]]] = "tfidf",
                       split_words: bool = False, casefold: bool = True) -> DataFrame:
    """L1: ``(id, phrases array, keyphrases packed)`` per document.

    ``method='tfidf'`` uses the corpus job above; a callable receives a batch
    of texts and returns one phrase list per text (a user model, run in Arrow
    batches with ``mapInPandas``).  Phrases are trimmed, de-duplicated and
    sorted (U3) and packed with '|' (P10)."""
    if method == "tfidf":
        per = _top_phrases(docs, id_col, text_col, k, 3, 1).select(id_col, F.col("top.phrase").alias("phrases"))
        per = docs.select(id_col).join(per, id_col, "left").withColumn(
            "phrases", F.coalesce("phrases", F.array().cast("array<string>")))
    else:
        fn = method
        schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                               T.StructField("phrases", T.ArrayType(T.StringType()))])

        def run(batches):
            for pdf in batches:
                out = fn(pdf[text_col].fillna("").tolist())
                yield pd.DataFrame({id_col: pdf[id_col], "phrases": [list(p) for p in out]})
        per = docs.select(id_col, text_col).mapInPandas(run, schema)
    per = per.withColumn("phrases", distinct_phrases("phrases"))
    return per.withColumn("keyphrases", pack_keyphrases("phrases", split_words, casefold))


def tagged_keyphrases(docs: DataFrame, id_col: str, text_col: str, tagger: Callable[[list[str]], list[list[tuple]]],
                      blank_mark: str = BLANK_MARK, split_words: bool = False, casefold: bool = True) -> DataFrame:
    """L1 with a token classifier: ``tagger`` gives for each text of a batch its tokens as ``(token, tag,
    score)``; tokens are merged to spans (``spans.merge_spans``), whose phrases are trimmed, distinct
    and sorted (U3) and packed (P10).  Returns ``(id, phrases, keyphrases)``; ids are unique."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(
        "_tokens", T.ArrayType(T.StructType.fromDDL("token string, tag string, score double")))])

    def run(batches):
        for pdf in batches:
            out = tagger(pdf[text_col].fillna("").tolist())
            yield pd.DataFrame({id_col: pdf[id_col], "_tokens": [[{"token": t, "tag": g, "score": float(s)} for t, g, s in o] for o in out]})

    # written once: the classifier is not asked again by a later read
    tokens_of = stage_table(docs.select(id_col, text_col).mapInPandas(run, schema), "tagged")
    flat = tokens_of.select(id_col, F.posexplode("_tokens").alias("pos", "_t")).select(id_col, "pos", "_t.token", "_t.tag", "_t.score")
    per = merge_spans(flat, id_col, blank_mark).where(F.col("phrase") != "").groupBy(id_col).agg(F.collect_set("phrase").alias("phrases"))
    per = tokens_of.select(id_col).join(per, id_col, "left").withColumn(
        "phrases", distinct_phrases(F.coalesce("phrases", F.array().cast("array<string>"))))
    return per.withColumn("keyphrases", pack_keyphrases("phrases", split_words, casefold))
