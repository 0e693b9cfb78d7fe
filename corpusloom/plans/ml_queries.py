"""Learning queries (L4-L8, A14, A15, S12, G6).  Fitted weights are not comparable across
engines, so queries that return what a fitted model says have no SQL; ``tests/test_ml.py`` holds them
against plain numpy."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import graph as g
from corpusloom.operators import metrics as mt
from corpusloom.operators import ml
from corpusloom.operators import sampling as sm
from corpusloom.plans import graph_queries, sampling_queries  # noqa: F401  (their shared CTEs)
from corpusloom.plans.registry import query
from corpusloom.plans.sql_fixtures import sql
from corpusloom.sources import fixtures as fx
from corpusloom.session import cut_lineage
from corpusloom.sources import io


@query("l4_standardise", sql=sql(["vectors"], """,
e AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, embedding[i] AS x FROM (SELECT vec_id, embedding, generate_subscripts(embedding, 1) AS i FROM vectors)),
s AS (SELECT dim, avg(x) AS mu, stddev_pop(x) AS sd FROM e GROUP BY dim)
SELECT vec_id, dim, CASE WHEN sd = 0 THEN x - mu ELSE (x - mu) / sd END AS value FROM e JOIN s USING (dim)"""))
def l4(spark, sf):
    return ml.standardise_long(fx.vectors(spark, sf), "embedding", "vec_id")


def _vector_split(spark, sf):
    v = fx.vectors(spark, sf)
    return cut_lineage(sm.stratified_split(v, "category", 0.2, 42, id_col="vec_id"))  # read by the fit and by the scoring


@query("l5_rbf_classifier")
def l5(spark, sf):
    """Fit on the stratified 80 % (L5), score the 20 % (L7), report."""
    s = _vector_split(spark, sf)
    model = ml.fit_rbf_classifier(s.filter(~F.col("is_test")), n_features=256)
    p = ml.predict(model, s.filter(F.col("is_test")))
    return mt.classification_report(p, "category", "predicted")


@query("l6_tune_rbf")
def l6(spark, sf):
    """Grid search: 3 C x 4 gamma, 5 stratified folds; every setting with its mean weighted F1, and whether it is the
    chosen one."""
    s = _vector_split(spark, sf).filter(~F.col("is_test"))
    settings = [(g_, c) for g_ in ml.GRID_GAMMA for c in ml.GRID_C]
    found = ml.search_rbf(s, settings, n_features=64, id_col="vec_id")
    scores = found.f1().mean(axis=1)
    rows = [(str(g_), float(c), float(scores[i]), i == found.best) for i, (g_, c) in enumerate(settings)]
    return spark.createDataFrame(rows, "gamma string, c double, mean_f1 double, best boolean")


@query("a14_cross_validation")
def a14_refit(spark, sf):
    """Accuracy of each of five folds by a model fitted on the others."""
    return ml.cross_validate(fx.vectors(spark, sf))


@query("l7_predict")
def l7(spark, sf):
    """Test vectors with their prediction, class probabilities and top two."""
    s = _vector_split(spark, sf)
    model = ml.fit_rbf_classifier(s.filter(~F.col("is_test")), n_features=128)
    return ml.predict(model, s.filter(F.col("is_test")).select("vec_id", "category", "embedding")).drop("embedding")


def _masked_graph(spark, sf):
    recs, nodes, cats, feats = graph_queries._graph(spark, sf)
    split = sm.split_fraction(recs.select("lens_id", "category"), 0.8, 42, tiebreak=["category"])
    masks = cut_lineage(g.node_masks(nodes, split))
    return recs, nodes, cats, feats, masks


@query("g6_node_masks", sql=sql(["split80", "ids"], """
SELECT i.node, i.lens_id, bool_or(NOT s.is_test) AS train_mask, bool_or(s.is_test) AS test_mask
FROM split80 s JOIN ids i ON i.lens_id = s.lens_id GROUP BY 1, 2"""))
def g6(spark, sf):
    return _masked_graph(spark, sf)[4]


@query("l8_node_classifier")
def l8(spark, sf):
    """Label features of train nodes only (test rows masked, no leakage),
    one GCN hop over class-code edges, MLP [k, 16, k] on train nodes: each test
    node with its label and prediction."""
    recs, nodes, cats, feats, masks = _masked_graph(spark, sf)
    train_feats = feats.join(masks.filter("train_mask").select("node"), "node")
    prop = g.gcn_propagate(nodes, graph_queries._edges(recs, nodes), train_feats, hops=1)
    k = cats.count()  # the model's output width
    _, scored = ml.fit_node_classifier(nodes, prop, masks, n_classes=k, width=k, max_iter=100)
    return scored.select("node", F.col("y").alias("label"), F.col("prediction").cast("int").alias("prediction"))


@query("a15_loss_history")
def a15_history(spark, sf):
    """Training loss of the node classifier, every tenth iteration and the last."""
    recs, nodes, cats, feats, masks = _masked_graph(spark, sf)
    train_feats = feats.join(masks.filter("train_mask").select("node"), "node")
    prop = g.gcn_propagate(nodes, graph_queries._edges(recs, nodes), train_feats, hops=1)
    k = cats.count()
    model, _ = ml.fit_node_classifier(nodes, prop, masks, n_classes=k, width=k, max_iter=100)
    return ml.loss_history(spark, model)


@query("s12_model_store")
def s12(spark, sf):
    """Predictions of a model that was saved and read again."""
    s = _vector_split(spark, sf)
    model = ml.fit_rbf_classifier(s.filter(~F.col("is_test")), n_features=64)
    path = io.scratch_path(spark, "model")
    model.save(path)
    p = ml.predict(ml.RbfModel.load(path), s.filter(F.col("is_test")))
    return p.select("vec_id", "category", "predicted", "confidence_one")
