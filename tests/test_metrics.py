"""Literal predictions incl. a label only ever predicted."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import metrics as mt

ROWS = [  # (id, truth, pred, conf)
    (1, "a", "a", 0.9), (2, "a", "b", 0.8), (3, "b", "b", 0.7), (4, "b", "a", 0.6),
    (5, "c", "c", 0.5), (6, "c", "z", 0.95), (7, "a", "a", 0.4), (8, None, "a", 0.3), (9, "a", "ERROR", 0.0),
]


@pytest.fixture()
def preds(spark):
    df = spark.createDataFrame(ROWS, "vec_id long, true_category string, predicted_one string, confidence_one double")
    return df.withColumn("title", df.vec_id.cast("string"))


def _sk_report(pairs):
    labels = sorted({t for t, _ in pairs} | {p for _, p in pairs})
    out = {}
    for lab in labels:
        tp = sum(1 for t, p in pairs if t == lab and p == lab)
        npred = sum(1 for _, p in pairs if p == lab)
        sup = sum(1 for t, _ in pairs if t == lab)
        pr = tp / npred if npred else 0.0
        rc = tp / sup if sup else 0.0
        f1 = 2 * pr * rc / (pr + rc) if pr + rc else 0.0
        out[lab] = (pr, rc, f1, sup)
    return out


def test_valid_predictions_and_report(preds):
    v = mt.with_correct(mt.valid_predictions(preds))
    assert v.count() == 7
    pairs = [(r.true_category, r.predicted_one) for r in v.collect()]
    rep = {r.label: r for r in mt.classification_report(v).collect()}
    for lab, (p, r, f, s) in _sk_report(pairs).items():
        assert (rep[lab].precision, rep[lab].recall, rep[lab].f1, rep[lab].support) == pytest.approx((p, r, f, s))
    assert rep["z"].support == 0 and rep["z"].precision == 0.0          # only ever predicted
    assert rep["accuracy"].f1 == pytest.approx(4 / 7)
    assert rep["macro avg"].support == 7
    assert mt.accuracy(v).first().accuracy == pytest.approx(4 / 7)


def test_confusion_union_labels_zero_cells(preds):
    v = mt.valid_predictions(preds)
    cm = {(r.actual, r.predicted): r.n for r in mt.confusion_matrix(v).collect()}
    assert len(cm) == 16 and cm[("z", "z")] == 0 and cm[("c", "z")] == 1 and cm[("a", "a")] == 2
    fixed = mt.confusion_matrix(v, labels=["a", "b"]).collect()
    assert len(fixed) == 4


def test_any_number_of_labels(spark):
    many = spark.range(10_001).select(F.format_string("l%05d", "id").alias("x"))
    got = mt.sorted_labels(many, "x")
    assert got.count() == 10_001 and got.filter("pos = 10000").first().label == "l10000"
    few = spark.createDataFrame([], "true_category string, predicted_one string")
    assert mt.confusion_matrix(few).count() == 0


def test_confidence_nulls_top_errors_labels(preds):
    v = mt.with_correct(mt.valid_predictions(preds))
    m = {r.is_correct: r.mean_confidence for r in mt.confidence_by_correct(v).collect()}
    assert m[True] == pytest.approx((0.9 + 0.7 + 0.5 + 0.4) / 4)
    h = mt.confidence_histogram(v, bins=10).collect()
    assert sum(r.n for r in h) == 7
    assert all(abs(sum(r.density for r in h if r.is_correct == c) - 1) < 1e-12 for c in (True, False))
    np_ = mt.null_profile(preds, ["true_category", "predicted_one"]).first()
    assert (np_.n_rows, np_.null_true_category, np_.null_predicted_one) == (9, 1, 0)
    top = mt.top_errors(v, 2).collect()
    assert [r.confidence_one for r in top] == [0.95, 0.8]
    assert [r.label for r in mt.sorted_labels(v, "true_category").orderBy("pos").collect()] == ["a", "b", "c"]


def test_label_distribution_log_loss_cv(spark):
    df = spark.createDataFrame([("s1", "x"), ("s1", "x"), ("s1", "y"), ("s2", None)], "set_name string, label string")
    d = {(r.set_name, r.label): (r.n, r.share, r.rank) for r in mt.label_distribution(df).collect()}
    assert d[("s1", "x")] == (2, pytest.approx(2 / 3), 1) and d[("s2", None)][0] == 1
    ll = spark.createDataFrame([([0.0, 0.0], 0, True), ([5.0, 0.0], 1, False)], "z array<double>, y int, m boolean")
    assert mt.log_loss(ll, "z", "y", "m").first().log_loss == pytest.approx(0.6931471805599453)
    cv = spark.createDataFrame([(0.5,), (0.7,)], "score double")
    r = mt.cv_summary(cv).first()
    assert (r.mean_score, r.two_sigma) == pytest.approx((0.6, 0.2))
