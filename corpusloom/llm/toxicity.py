"""Toxicity by a classifier chain.

Categories are predicted in order.  Each has a linear (logistic) model whose inputs
are the text's features and the probabilities of all earlier categories.  Training
feeds later models out-of-fold probabilities: those of a row come from models that
have not seen its fold.  Scoring feeds the probabilities of the final models.

Features are the distinct lower-cased words of the whole text and the first 4, 5 and
6 letters of longer words (so inflected forms count), reduced to the
``n_features`` that differ most between rows with and without the last category.  They are
chosen anew, from its training rows alone, for the models of each fold.

The models learn from a bounded sample of labelled rows (``sample_per_class`` with and as
many without the last category, chosen by a hash of the id, one row an id).  Each level of the
chain is one job: a group for each fold's model and one for the final model, each fitted
whole in its task (the feature places of at most about ``2 * sample_per_class`` rows).
Feature lists and weights (``n_features`` each) are broadcast; every whole text is scored
in one pass without a shuffle.

Defined cases: a null or empty text has no features; labels that are null or
belong to no document are not learned from; an id that is labelled more than once has its
largest label; a feature of fewer than ``MIN_ROWS`` training rows is not chosen; an earlier
category with one value only in its training rows is constant at it; if the last one has one value
only, or there is no feature, it is constant at the rate of all labels, and the chain rejects
nothing; without any label all probabilities are 0; rows that repeat an id are
documents of their own when scored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import own_columns, unit_hash
from corpusloom.operators.crossfit import minimise
from corpusloom.session import stage_table

SAMPLE_PER_CLASS = 4000
N_FEATURES = 2048
MIN_ROWS = 2
FOLDS = 3
STEPS = 100
RIDGE = 1e-5
THRESHOLD = 0.5
PREFIXES = (4, 5, 6)
#: Terms are the features by which graded categories are derived from one label.
MIN_TERM_PRECISION = 0.9
REPEATED_TERMS = 3
GRADED = ("has_terms", "repeats_terms")
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Distinct words, and prefixes (marked by a hyphen) of longer words."""
    found = set(_WORD.findall((text or "").lower()))
    return found | {w[:k] + "-" for k in PREFIXES for w in found if len(w) > k}


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


class Chain:
    """Vocabulary and, for each category, the weights of features, earlier
    probabilities, and an intercept; ``informed`` tells whether the last category was
    learned from features."""

    def __init__(self, categories: Sequence[str], vocabulary: Sequence[str], weights: Sequence[np.ndarray], informed: bool = True):
        self.categories, self.index = list(categories), {w: i for i, w in enumerate(vocabulary)}
        self.weights, self.informed = list(weights), informed

    def rejects(self, probability: Column, threshold: float = THRESHOLD) -> Column:
        """Whether a document with this probability of the last category is rejected."""
        return (probability >= threshold) & F.lit(self.informed)

    def predict(self, text: str | None) -> list[float]:
        get, n = self.index.get, len(self.index)
        at = [i for i in map(get, features(text)) if i is not None]
        probabilities: list[float] = []
        for w in self.weights:
            margin = w[at].sum() + float(w[n:-1] @ np.array(probabilities)) + w[-1]
            probabilities.append(float(1 / (1 + np.exp(-np.clip(margin, -500, 500)))))
        return probabilities


def _chosen_features(sample: DataFrame, last: str, folds: int, n_features: int) -> dict[int, list[tuple[str, float]]]:
    """For each fold (-1: none) the features that differ most between the rows outside it with
    and without ``last`` (by the G statistic), each with the share of its rows that has it."""
    sets = [*range(folds), -1]
    sizes = sample.groupBy("fold", last).count().collect()  # two rows a fold
    pos = {k: float(sum(r["count"] for r in sizes if r.fold != k and r[last] == 1)) for k in sets}
    neg = {k: float(sum(r["count"] for r in sizes if r.fold != k and r[last] != 1)) for k in sets}
    inside = lambda k: F.col("fold") != k
    counts = sample.select("fold", last, F.explode("features").alias("f")).groupBy("f").agg(*[
        e for k in sets for e in (F.sum(F.when(inside(k), F.col(last)).otherwise(0)).cast("double").alias(f"a{k}"),
                                  F.count_if(inside(k)).cast("double").alias(f"n{k}"))])

    def gain(k: int) -> Column:
        def part(x: Column, of: float) -> Column:
            expected = F.col(f"n{k}") * of / max(1.0, pos[k] + neg[k])
            return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

        return part(F.col(f"a{k}"), pos[k]) + part(F.col(f"n{k}") - F.col(f"a{k}"), neg[k])

    one = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"a{k}").alias("a"), F.col(f"n{k}").alias("n"), gain(k).alias("g"))
                             for k in sets if pos[k] and neg[k]] or [F.struct(F.lit(-1).alias("k"), F.lit(0.0).alias("a"), F.lit(0.0).alias("n"), F.lit(0.0).alias("g"))]))
    best = Window.partitionBy("k").orderBy(F.desc("g"), "f")
    top = (counts.select("f", one).where(F.col("n") >= MIN_ROWS).withColumn("at", F.row_number().over(best))
           .where(F.col("at") <= n_features).orderBy("k", "at").collect())  # n_features rows a fold
    out: dict[int, list[tuple[str, float]]] = {k: [] for k in sets}
    for r in top:
        out[r.k].append((r.f, r.a / r.n))
    return out


class Rows:
    """Binary features of rows as the places of their ones, and dense columns beside them."""

    def __init__(self, ones: list[np.ndarray], width: int, dense: np.ndarray):
        self.width, self.dense, self.n = width, dense, len(ones)
        self.row = np.repeat(np.arange(len(ones)), [len(x) for x in ones])
        self.place = np.concatenate([np.zeros(0, np.int64), *ones]).astype(np.int64)

    def margins(self, w: np.ndarray) -> np.ndarray:
        """Of weights for the features, the dense columns and an intercept."""
        return np.bincount(self.row, w[self.place], self.n) + self.dense @ w[self.width:-1] + w[-1]

    def sums(self, v: np.ndarray) -> np.ndarray:
        """The sum of ``v`` (a number a row) over the rows of each feature, by dense columns, and in all."""
        return np.concatenate([np.bincount(self.place, v[self.row], self.width), v @ self.dense, [v.sum()]])


def logistic(x: Rows, y: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Weights and intercept that minimise the mean logistic loss plus ``ridge / 2 * |w|^2``."""
    n = max(1, len(y))

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        margin, held = x.margins(w), np.append(w[:-1], 0.0)
        loss = float(np.logaddexp(0.0, margin).sum() - y @ margin) / n + ridge / 2 * float(held @ held)
        return loss, x.sums((_sigmoid(margin) - y) / n) + ridge * held

    return minimise(value, x.width + x.dense.shape[1] + 1, steps, 1e-5)


def _fit_level(data: DataFrame, level: int, width: dict[int, int], rates: Sequence[float], ridge: float,
               steps: int) -> tuple[DataFrame, np.ndarray]:
    """Fits the models of one level, one group a fold and one for all rows (``k`` = -1).
    ``data`` holds ``k, id, fold, y, x`` (places of the features of a fold's models), and ``p``, the
    out-of-fold probabilities of earlier levels.  Returns ``(id, q)`` of every row, by the model
    that has not seen its fold, and the weights of the final model."""
    rate, last = float(rates[-1]), level == len(rates) - 1

    def fit_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        k, n = int(key[0]), width[int(key[0])]
        train = (rows["fold"] != k).to_numpy()
        earlier = np.array([p[:level] for p in rows["p"]], float).reshape(len(rows), level)

        def some(which: np.ndarray) -> Rows:
            return Rows([np.asarray(x, np.int64) for x in rows["x"][which]], n, earlier[which])

        y = np.array([v[level] for v in rows["y"]], float)[train]
        if not n or len(set(y)) < 2:
            w = np.append(np.zeros(n + level), _logit(rate if last or not len(y) else float(y.mean())))
        else:
            w = logistic(some(train), y, ridge, steps)
        if k < 0:
            return pd.DataFrame({"id": [None], "q": [None], "w": [w.tolist()]})
        return pd.DataFrame({"id": rows["id"][~train], "q": _sigmoid(some(~train).margins(w)), "w": None})

    dealt = data.repartition(2 * len(width), "k")  # a number of its own, so that groups are not put into one task
    found = stage_table(dealt.groupBy("k").applyInPandas(fit_group, "id string, q double, w array<double>"), "toxicity-level")
    final = found.where(F.col("w").isNotNull()).select("w").first()
    weights = np.array(final.w) if final else np.append(np.zeros(width[-1] + level), _logit(rate))
    return found.where(F.col("id").isNotNull()).select("id", "q"), weights


def fit(labelled: DataFrame, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text",
        sample_per_class: int = SAMPLE_PER_CLASS, n_features: int = N_FEATURES, folds: int = FOLDS,
        graded: bool = False, rates: Sequence[float] | None = None, ridge: float = RIDGE, steps: int = STEPS) -> Chain:
    """A chain over the 0/1 columns ``categories`` of ``labelled``; ``rates`` are the categories'
    shares among all labels (those of ``labelled`` by default).

    With ``graded``, the only category given is preceded by two that are derived from
    it: the label and at least one term, and the label and at least
    ``REPEATED_TERMS`` terms, where terms are features of which at least
    ``MIN_TERM_PRECISION`` of the training rows have the label."""
    last, names = categories[-1], [*(GRADED if graded else ()), *categories]
    rows = own_columns(labelled, id_col, text_col, *categories).toDF("doc_id", "text", *categories).dropna(
        subset=list(categories))
    if rates is None:
        mean = rows.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in categories]).first()
        rates = [mean[c] or 0.0 for c in categories]
    rates = [rates[0]] * (len(names) - len(categories)) + list(rates)
    one = F.min(F.struct("text", *[F.col(c).cast("int").alias(c) for c in categories])).alias("row")
    chosen = rows.where(_class_share(rows, last, sample_per_class)).groupBy("doc_id").agg(one).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.floor(unit_hash("fold", F.col("doc_id")) * folds).cast("int").alias("fold"), "row.*")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sorted(features(t.as_py())) for t in batch.column("text")], pa.list_(pa.string()))
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [found], [*rest, "features"])

    schema = ", ".join(["id string", "fold int", *[f"`{c}` int" for c in categories], "features array<string>"])
    sample = stage_table(chosen.mapInArrow(extract, schema), "toxicity-sample")
    best = _chosen_features(sample, last, folds, n_features)
    vocabulary = [f for f, _ in best[-1]]
    places = {k: {f: i for i, (f, _) in enumerate(found)} for k, found in best.items()}
    terms = {k: {f for f, share in found if share >= MIN_TERM_PRECISION} for k, found in best.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row once for each fold's models, with their features and categories."""
        for batch in batches:
            labels = list(zip(*(batch.column(c).to_pylist() for c in categories), strict=True))
            for k, index in places.items():
                x, y = [], []
                for found, own in zip(batch.column("features").to_pylist(), labels, strict=True):
                    x.append([index[f] for f in found if f in index])
                    n_terms = len(terms[k].intersection(found))
                    y.append([*((own[-1] * (n_terms >= 1), own[-1] * (n_terms >= REPEATED_TERMS)) if graded else ()), *own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(x), pa.int32()), batch.column("id"), batch.column("fold"), pa.array(y, pa.list_(pa.int32())),
                     pa.array(x, pa.list_(pa.int32())), pa.array([[]] * len(x), pa.list_(pa.float64()))], ["k", "id", "fold", "y", "x", "p"])

    data = stage_table(sample.mapInArrow(place, "k int, id string, fold int, y array<int>, x array<int>, p array<double>"), "toxicity-folds")
    weights = []
    for level in range(len(names)):
        held, w = _fit_level(data, level, {k: len(v) for k, v in places.items()}, rates, ridge, steps)
        weights.append(w)
        if level < len(names) - 1:
            data = stage_table(data.join(held, "id").select("k", "id", "fold", "y", "x", F.concat("p", F.array("q")).alias("p")), "toxicity-folds")
    return Chain(names, vocabulary, weights, informed=bool(vocabulary))


def _class_share(rows: DataFrame, label: str, sample_per_class: int) -> Column:
    """Whether a row is in the sample: by a hash of its id, about ``sample_per_class``
    rows with and as many without the label."""
    n = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("int")).count().collect()}
    share = F.when(F.col(label) == 1, min(1.0, sample_per_class / max(1, n.get(1, 0)))).otherwise(
        min(1.0, sample_per_class / max(1, n.get(0, 0))))
    return unit_hash("toxicity", F.col("doc_id")) < share


def fit_labels(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> Chain:
    """A chain from a table ``labels(doc_id, toxic)``.  It has one toxicity label;
    graded categories derived from it come first in the chain.  The sample is drawn
    from the labels, so only its ids (about ``2 * sample_per_class``, each once) are broadcast to
    the documents and only the sample's texts are shuffled."""
    labels = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rate = labels.agg(F.avg("toxic")).first()[0] or 0.0
    chosen = labels.where(_class_share(labels, "toxic", sample_per_class))
    return fit(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), ["toxic"], graded=True,
               sample_per_class=sample_per_class, rates=[rate])


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``p_<category>`` for each category, of every document."""
    rows = own_columns(docs, id_col, text_col).toDF("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([shared.value.predict(t.as_py()) for t in batch.column("text")]).reshape(
                len(batch), len(shared.value.categories))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(found[:, k]) for k in range(found.shape[1])]],
                ["doc_id", *[f"p_{c}" for c in shared.value.categories]])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predict, ", ".join([f"doc_id {kind}", *[f"`p_{c}` double" for c in chain.categories]]))


def drop_toxic(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the chain does not reject: all whose last category has a
    probability below ``threshold``, or all if the chain has learned nothing."""
    if not chain.informed:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf("double")
    def last(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.predict(t)[-1] for t in texts], dtype=float)

    return docs.where(last(F.col(f"`{text_col}`")) < threshold)
