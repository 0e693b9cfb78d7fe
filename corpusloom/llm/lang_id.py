"""Language identification by hierarchical discrimination.

A linear model predicts the language family; within a family, one linear support
vector machine for each pair of its languages votes for one of the two.  Features
are hashed character bigrams and trigrams of the lower-cased text with everything
but letters blanked, as square roots of relative frequencies.

The models are fitted by MLlib on a bounded sample of labelled rows
(``sample_per_language`` for each language, chosen by a hash of the id), so their
size depends on the number of languages only; they are broadcast, and every whole
text is scored in one pass without a shuffle.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows
with a null label are not learned from; with one learned language every text with a
letter is that language, with none every text is ``und``; a language that the family table does not
know is a family of its own; rows that repeat an id are documents of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import own_columns, unit_hash
from corpusloom.session import stage_table

#: ISO 639-1, 639-2 and 639-3 codes of closely related languages.
FAMILIES = {
    "germanic": "af afr da dan de deu ger en eng fy fry is isl ice lb ltz nb nob nl nld dut nn nno no nor sv swe yi yid",
    "romance": "ca cat es spa fr fra fre gl glg it ita la lat oc oci pt por ro ron rum",
    "slavic": "be bel bg bul bs bos cs ces cze hr hrv mk mkd mac pl pol ru rus sk slk slo sl slv sr srp uk ukr",
    "baltic": "lt lit lv lav",
    "celtic": "br bre cy cym wel ga gle gd gla",
    "uralic": "et est fi fin hu hun",
    "turkic": "az aze kk kaz ky kir tr tur tt tat ug uig uz uzb",
    "indo_aryan": "bn ben gu guj hi hin mr mar ne nep pa pan si sin ur urd",
    "iranian": "fa fas per ku kur ps pus tg tgk",
    "dravidian": "kn kan ml mal ta tam te tel",
    "semitic": "am amh ar ara he heb mt mlt",
    "austronesian": "ceb fil hil id ind jv jav mg mlg ms msa may tl tgl",
}
UNDETERMINED = "und"
SAMPLE_PER_LANGUAGE = 1000
HASH_BITS = 12
#: The sample is small and each optimiser step is a job.
FIT_PARTITIONS = 3


def family_of(lang: str) -> str:
    """The family of a language code; what follows a hyphen or underscore (script, region) does not count."""
    code = re.split("[-_]", lang.lower())[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), lang)


def features(text: str, bits: int = HASH_BITS) -> np.ndarray | None:
    """Unit vector of ``2 ** bits`` numbers; None for a text without a letter."""
    if not any(map(str.isalpha, text)):
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).copy()
    code[(code < 128) & ((code < 97) | (code > 122))] = 32
    code = np.concatenate([[32], code, [32]]).astype(np.uint32)
    two = code[:-1] * np.uint32(0x9E3779B1) ^ code[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) ^ code[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - bits)
    counts = (np.bincount((two * np.uint32(0x165667B1)) >> shift, minlength=1 << bits)
              + np.bincount((three * np.uint32(0x165667B1)) >> shift, minlength=1 << bits))
    return np.sqrt(counts / counts.sum())


class LanguageModel:
    """Weights of the family model and of the pairwise machines (last column: intercept)."""

    def __init__(self, families: dict[str, list[str]], family_weights: np.ndarray, pairs: list[tuple[str, str]],
                 pair_weights: np.ndarray):
        self.families, self.names = families, sorted(families)
        self.family_weights, self.pairs, self.pair_weights = family_weights, pairs, pair_weights

    def predict(self, text: str | None) -> tuple[str, str, float]:
        """Language, family and score of one text."""
        x = features(text) if text and self.names else None
        if x is None:
            return UNDETERMINED, UNDETERMINED, 0.0
        x = np.append(x, 1.0)
        share = np.ones(1)
        if len(self.names) > 1:
            margin = self.family_weights @ x
            share = np.exp(margin - margin.max())
            share /= share.sum()
        family = self.names[int(share.argmax())]
        langs = self.families[family]
        if len(langs) == 1:
            return langs[0], family, float(share.max())
        votes, sure = defaultdict(int), defaultdict(float)
        for k, (a, b) in enumerate(self.pairs):
            if a in langs:
                p = 1 / (1 + np.exp(-np.clip(self.pair_weights[k] @ x, -50, 50)))
                votes[a if p >= 0.5 else b] += 1
                sure[a] += p
                sure[b] += 1 - p
        best = max(langs, key=lambda lang: (votes[lang], sure[lang], lang))
        return best, family, float(share.max() * sure[best] / (len(langs) - 1))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """A model from rows with a language; only ``sample_per_language`` rows of each
    language, about, are read as texts."""
    rows = own_columns(labelled, id_col, text_col, lang_col).toDF("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return LanguageModel({}, np.zeros((0, 0)), [], np.zeros((0, 0)))
    families = defaultdict(list)
    for lang in sorted(n):
        families[family_of(lang)].append(lang)
    share = F.create_map(*[F.lit(v) for lang, k in n.items() for v in (lang, min(1.0, sample_per_language / k))])
    chosen = rows.where(unit_hash("language", F.col("doc_id")) < share[F.col("lang")])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                x = features(text.as_py())
                if x is not None:
                    yield pa.RecordBatch.from_pydict({"lang": [lang.as_py()], "x": [x]})

    sample = stage_table(chosen.mapInArrow(vectors, "lang string, x array<double>").repartition(FIT_PARTITIONS),
                         "language-sample")
    data = sample.select("lang", array_to_vector("x").alias("features"))
    names = sorted(families)
    found = {r.lang for r in sample.select("lang").distinct().collect()}

    def label(of: dict[str, int]) -> Column:
        return F.create_map(*[F.lit(v) for lang, k in of.items() for v in (lang, float(k))])[F.col("lang")]

    family_weights = np.zeros((len(names), (1 << HASH_BITS) + 1))
    seen = [f for f in names if found & set(families[f])]
    if len(seen) > 1:
        number = {lang: seen.index(f) for f in seen for lang in families[f]}
        lr = LogisticRegression(maxIter=40, regParam=1e-4, family="multinomial", standardization=False)
        m = lr.fit(data.withColumn("label", label(number)))
        family_weights[[names.index(f) for f in seen]] = np.column_stack(
            [m.coefficientMatrix.toArray(), m.interceptVector.toArray()])
    family_weights[[k for k, f in enumerate(names) if f not in seen], -1] = -1e3  # no text with a letter
    pairs = [p for f in names for p in combinations(families[f], 2)]
    pair_weights = np.zeros((len(pairs), (1 << HASH_BITS) + 1))
    for k, (a, b) in enumerate(pairs):
        if {a, b} <= found:
            svm = LinearSVC(maxIter=40, regParam=1e-4, standardization=False)
            m = svm.fit(data.where(F.col("lang").isin(a, b)).withColumn("label", label({a: 1, b: 0})))
            pair_weights[k] = np.append(m.coefficients.toArray(), m.intercept)
        else:
            pair_weights[k, -1] = (a in found) - (b in found)
    return LanguageModel(dict(families), family_weights, pairs, pair_weights)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, family_pred, score`` of every document."""
    rows = own_columns(docs, id_col, text_col).toDF("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column("text")]
            lang, family, score = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(family, pa.string()),
                 pa.array(score, pa.float64())], ["doc_id", "lang_pred", "family_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, family_pred string, score double")
