"""The cross-fit engine and the RBF classifier against plain numpy."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import crossfit as cf
from corpusloom.operators import ml


def newton_svm(z, sign, cost):
    """Minimiser of |w|^2 / 2 + sum cost * max(0, 1 - sign * margin)^2, the intercept free."""
    w, reg = np.zeros(z.shape[1]), np.eye(z.shape[1])
    reg[-1, -1] = 1e-9
    for _ in range(200):
        slack = np.maximum(0.0, 1 - sign * (z @ w))
        held = w.copy()
        held[-1] = 0.0
        grad = held - 2 * ((cost * slack * sign) @ z)
        if np.linalg.norm(grad) < 1e-9:
            break
        act = slack > 0
        step = np.linalg.solve(reg + 2 * (z[act] * cost[act][:, None]).T @ z[act], grad)
        t, now = 1.0, 0.5 * held @ held + cost @ slack ** 2
        while True:
            v = w - t * step
            loss = 0.5 * v[:-1] @ v[:-1] + cost @ np.maximum(0.0, 1 - sign * (z @ v)) ** 2
            if loss <= now + 1e-12 * abs(now) or t < 1e-8:
                break
            t /= 2
        w = v
    return w


def newton_sigmoid(f, positive):
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    p = np.array([0.0, np.log((n0 + 1) / (n1 + 1))])
    x = np.column_stack([f, np.ones(len(f))])
    for _ in range(500):
        q = 1 / (1 + np.exp(x @ p))
        grad = x.T @ (target - q)
        hess = (x * (q * (1 - q))[:, None]).T @ x + 1e-10 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        p = p - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-12:
            break
    return p


def blobs(n=360, seed=3, spread=1.3):
    rng = random.Random(seed)
    centres = {"a": (0, 0, 0), "b": (2, 0, 1), "c": (0, 2.5, -1), "d": (2, 2, 0)}
    rows = []
    for i in range(n):
        c = rng.choices("abcd", (5, 3, 2, 1))[0]
        rows.append((i, [m + rng.gauss(0, spread) for m in centres[c]] + [7.0], c))
    return rows


@pytest.fixture(scope="module")
def vecs(spark):
    return spark.createDataFrame(blobs(), "vec_id long, embedding array<double>, category string").repartition(5)


def test_search_matches_numpy(spark, vecs):
    settings = [("scale", 0.1), ("scale", 1.0), (0.5, 1.0)]
    found = ml.search_rbf(vecs, settings, folds=3, n_features=20, seed=1, id_col="vec_id", max_iter=400)
    rows = {r.vec_id: r for r in ml.stratified_folds(vecs, 3, "category", 1, "vec_id").collect()}
    ids = sorted(rows)
    x, classes = np.array([rows[i].embedding for i in ids]), ["a", "b", "c", "d"]
    y, fold = np.array([classes.index(rows[i].category) for i in ids]), np.array([rows[i].fold for i in ids])
    rng = np.random.default_rng(1)
    w0, b0 = rng.normal(0.0, 1.0, size=(4, 20)), rng.uniform(0.0, 2 * np.pi, size=20)
    pairs = list(combinations(range(4), 2))

    def machines(train, gamma, cost):
        mu, sd = x[train].mean(0), x[train].std(0)
        sd = np.where(sd > 1e-12, sd, 0.0)
        g = 1 / (4 * (sd > 0).mean()) if gamma == "scale" else gamma
        z = np.sqrt(2 / 20) * np.cos(((x - mu) / np.where(sd > 0, sd, 1)) @ (w0 * np.sqrt(2 * g)) + b0)
        z = np.hstack([z, np.ones((len(z), 1))])
        out = []
        for i, j in pairs:
            own = train & ((y == i) | (y == j))
            weight = np.array([cost * train.sum() / (4 * (train & (y == k)).sum()) for k in y[own]])
            out.append(newton_svm(z[own], np.where(y[own] == i, 1.0, -1.0), weight))
        return z, np.array(out)

    f1 = np.zeros((len(settings), 3))
    for s, (gamma, cost) in enumerate(settings):
        margins = np.zeros((len(x), len(pairs)))
        for k in range(3):
            z, w = machines(fold != k, gamma, cost)
            margins[fold == k] = (z @ w.T)[fold == k]
            truth, voted = y[fold == k], cf.votes(margins[fold == k], pairs, 4)
            assert (found.confusion[s, k] == [[((truth == a) & (voted == b)).sum() for b in range(4)] for a in range(4)]).sum() >= 14
            for c in range(4):
                tp = ((truth == c) & (voted == c)).sum()
                f1[s, k] += (truth == c).mean() * (2 * tp / max(1, (truth == c).sum() + (voted == c).sum()))
        if s == found.best:
            platt = np.array([newton_sigmoid(margins[(y == i) | (y == j), p], y[(y == i) | (y == j)] == i) for p, (i, j) in enumerate(pairs)])
            assert np.allclose(found.model.sigmoids.a, platt[:, 0], rtol=2e-2, atol=2e-2)
            assert np.allclose(found.model.sigmoids.b, platt[:, 1], rtol=2e-2, atol=2e-2)
            z, w = machines(np.ones(len(x), bool), gamma, cost)
            assert np.allclose(found.model.weights, w, rtol=2e-2, atol=5e-3)
    assert np.allclose(found.f1(), f1, atol=0.02)
    assert found.f1().mean(axis=1).argmax() == found.best


def test_jobs_do_not_grow_with_the_grid(spark, vecs):
    one = ml.search_rbf(vecs, [("scale", 1.0)], folds=2, n_features=16, id_col="vec_id")
    many = ml.search_rbf(vecs, [(g, c) for g in ml.GRID_GAMMA for c in (0.5, 1.0)], folds=4, n_features=16, id_col="vec_id")
    assert many.jobs < 3 * one.jobs
    again = ml.search_rbf(vecs, [("scale", 1.0)], folds=2, n_features=16, id_col="vec_id")
    assert (one.confusion == again.confusion).all()


def test_coupling_minimises_its_objective():
    rng = np.random.default_rng(5)
    pairs = list(combinations(range(4), 2))
    r = rng.uniform(0.05, 0.95, size=(30, len(pairs)))
    p = cf.couple(r, pairs, 4)
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()

    def objective(row, q):
        return sum(((1 - row[k]) * q[a] - row[k] * q[b]) ** 2 for k, (a, b) in enumerate(pairs))

    for row, q in zip(r, p, strict=True):
        for _ in range(60):
            other = np.abs(q + rng.normal(0, 0.02, 4))
            assert objective(row, q) <= objective(row, other / other.sum()) + 1e-12
    # consistent pairs give the probabilities they come from
    true = rng.dirichlet(np.ones(4), 20)
    exact = np.array([[t[a] / (t[a] + t[b]) for a, b in pairs] for t in true])
    assert np.allclose(cf.couple(exact, pairs, 4), true, atol=1e-6)
    assert (cf.couple(np.zeros((3, 0)), [], 1) == 1).all()


def test_probabilities_are_calibrated_and_ordered(spark):
    rows = blobs(3000, 7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, category string")
    train, held = df.where("vec_id % 3 <> 0"), df.where("vec_id % 3 = 0")
    model = ml.fit_rbf_classifier(train, n_features=96, seed=2)
    got = ml.predict(model, held).collect()
    p = np.array([r.probabilities for r in got])
    assert np.allclose(p.sum(axis=1), 1) and model.classes == ["a", "b", "c", "d"]
    assert all(r.predicted == r.predicted_one == model.classes[int(q.argmax())] and r.confidence_one >= r.confidence_two for r, q in zip(got, p, strict=True))
    right = np.array([r.predicted == r.category for r in got])
    best = p.max(axis=1)
    edges = np.quantile(best, [0, 0.25, 0.5, 0.75, 1])
    error = sum(abs(right[m].mean() - best[m].mean()) * m.mean() for lo, hi in zip(edges, edges[1:], strict=False) if (m := (best >= lo) & (best <= hi)).any())
    assert error < 0.12 and right.mean() > 0.6
    # the confidences say something: log loss beats the class shares'
    share = np.array([sum(r.category == c for r in got) for c in model.classes]) / len(got)
    truth = np.array([model.classes.index(r.category) for r in got])
    assert -np.log(p[np.arange(len(p)), truth]).mean() < -np.log(share[truth]).mean() - 0.2


def test_cross_validation_matches_confusion(spark, vecs):
    per = {r.fold: r for r in ml.cross_validate(vecs, n_features=24, folds=3).collect()}
    assert sum(r.n for r in per.values()) == 360 and all(0.3 < r.accuracy <= 1 for r in per.values())


def test_classifier_of_odd_inputs(spark, vecs):
    odd = vecs.withColumn("category", F.when(F.col("vec_id") % 7 == 0, None).otherwise(F.col("category"))).withColumn(
        "embedding", F.when(F.col("vec_id") % 11 == 0, None).otherwise(F.col("embedding")))
    model = ml.fit_rbf_classifier(odd, n_features=8)
    got = ml.predict(model, odd).collect()
    assert all((r.predicted is None) == (r.embedding is None) for r in got) and len(got) == 360
    one = ml.fit_rbf_classifier(vecs.where("category = 'a'"), n_features=8)
    assert {(r.predicted, tuple(r.probabilities)) for r in ml.predict(one, vecs).collect()} == {("a", (1.0,))}
    with pytest.raises(ValueError):
        ml.fit_rbf_classifier(vecs.limit(0))


def test_tuned_model_is_the_best_setting(spark, vecs):
    gamma, c, score, model = ml.tune_rbf(vecs, Cs=(0.1, 1.0), gammas=("scale", 0.01), folds=3, n_features=16)
    found = ml.search_rbf(vecs, [(g, k) for g in ("scale", 0.01) for k in (0.1, 1.0)], folds=3, n_features=16, id_col="vec_id")
    assert (gamma, c) == found.settings[found.best] and score == pytest.approx(found.f1().mean(axis=1).max())
    assert model.weights.shape == (6, 17)


def test_minimise_finds_the_minimum():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((12, 12))
    a = a @ a.T + np.eye(12) * 0.1
    b = rng.standard_normal(12)
    x = cf.minimise(lambda v: (0.5 * v @ a @ v - b @ v, a @ v - b), 12, 500, 1e-9)
    assert np.allclose(x, np.linalg.solve(a, b), atol=1e-5)


def test_fit_makes_no_features_of_held_out_rows(spark):
    rows = [([float(i % 2), float("nan") if i % 5 == 0 else 1.0], i % 2, i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "x array<double>, y int, fold int").coalesce(1)
    rng = np.random.default_rng(0)
    maps = [cf.FeatureMap(rng.normal(size=(2, 8)), np.zeros(8))]
    weights, _ = cf.fit(df, maps, [cf.Model(0, 0, 1, 0, 1.0, 1.0)], steps=5)
    assert np.isfinite(weights).all() and np.abs(weights).max() > 0
