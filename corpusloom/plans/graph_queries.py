"""Graph-pipeline queries: incidence, co-occurrence edges, nodes, masks,
propagation (J1-J3, J7, G1-G9, U4, A4, A12, P20, P21, W1, W4, W7, B8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import merge_codes, normalise_codes
from corpusloom.operators import graph as g
from corpusloom.operators import twins as tw
from corpusloom.operators.links import Links
from corpusloom.plans.registry import query
from corpusloom.plans.sql_fixtures import sql
from corpusloom.session import cut_lineage
from corpusloom.sources import fixtures as fx


def _level_incidence(recs: DataFrame) -> DataFrame:
    r = recs.select("lens_id", normalise_codes(merge_codes("cpc", "ipcr")).alias("_codes"))
    return g.incidence(r, "lens_id", "_codes", levels=("group",))


def _raw_incidence(recs: DataFrame, drop_empty: bool) -> DataFrame:
    r = recs.select("lens_id", normalise_codes(merge_codes("cpc", "ipcr")).alias("_codes"))
    return g.incidence(r, "lens_id", "_codes", drop_empty=drop_empty)


# ---------------------------------------------------------------- flagship (G3 -> J1 -> U4 -> agg)

def category_pair_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct directed same-classification edges per (source category,
    destination category) — the live graph path of the reference ending in a
    small aggregate."""
    # the category travels on the incidence rows, so no edge is joined to a record; so do a record's few keys:
    # each undirected pair is counted under its smallest shared key only, where it is found (pairs are not
    # shuffled to be told apart), and only the few result rows are mirrored
    recs = fx.records(spark, sf_dir).select(
        F.struct("lens_id", "category").alias("node"),
        normalise_codes(merge_codes("cpc", "ipcr")).alias("_codes"))
    keys = g.incidence(recs, "node", "_codes", levels=("group",)).groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    inc = keys.select(F.struct("node.lens_id", "node.category", "keys").alias("node"), F.explode("keys").alias("key"))
    pairs = g.cooccurrence_pairs(inc, keep_key=True)
    pairs = pairs.where(F.col("key") == F.array_min(F.array_intersect("src.keys", "dst.keys")))
    one_way = pairs.groupBy(F.col("src.category").alias("src_category"), F.col("dst.category").alias("dst_category")).agg(
        F.count(F.lit(1)).alias("n"))
    other_way = F.array(F.struct("src_category", "dst_category", "n"),
                        F.struct(F.col("dst_category").alias("src_category"), F.col("src_category").alias("dst_category"), "n"))
    return (one_way.select(F.inline(other_way)).groupBy("src_category", "dst_category")
            .agg(F.sum("n").alias("n_edges")))


query("g3_category_pair_edges", sql=sql(["records", "level_keys"], """,
inc AS (SELECT DISTINCT node, key FROM level_keys),
pairs AS (SELECT DISTINCT a.node AS src, b.node AS dst FROM inc a JOIN inc b ON a.key = b.key AND a.node < b.node),
directed AS (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs)
SELECT ca.category AS src_category, cb.category AS dst_category, count(*) AS n_edges
FROM directed d JOIN records ca ON ca.lens_id = d.src JOIN records cb ON cb.lens_id = d.dst
GROUP BY 1, 2"""))(category_pair_edges)


# ---------------------------------------------------------------- shared SQL for the graph family
from corpusloom.plans.sql_fixtures import cte  # noqa: E402

cte("ids", ("records",), """
SELECT lens_id, row_number() OVER (ORDER BY md5('0:' || lens_id), lens_id) - 1 AS node
FROM (SELECT DISTINCT lens_id FROM records WHERE lens_id IS NOT NULL)""")
cte("cats", ("records",), """
SELECT category, row_number() OVER (ORDER BY md5('0:' || category), category) - 1 AS cat
FROM (SELECT DISTINCT category FROM records WHERE category IS NOT NULL)""")
cte("nodes", ("ids", "cats"), """
SELECT i.node, i.lens_id, max(c.cat) AS y
FROM records r JOIN ids i ON i.lens_id = r.lens_id JOIN cats c ON c.category = r.category
GROUP BY i.node, i.lens_id""")
cte("feats", ("ids", "cats"), """
SELECT DISTINCT i.node, c.cat AS dim, CAST(1.0 AS DOUBLE) AS value
FROM records r JOIN ids i ON i.lens_id = r.lens_id JOIN cats c ON c.category = r.category""")


def _edges_sql(name: str, keys_cte: str, edge_type: str, self_loops: bool = False) -> None:
    selfp = f"""
  UNION ALL SELECT node, node, 1 FROM (SELECT node, key FROM {keys_cte} GROUP BY node, key HAVING count(*) >= 2)
  GROUP BY node""" if self_loops else ""
    cte(name, ("ids", keys_cte), f"""
SELECT '{edge_type}' AS edge_type, i1.node AS src, i2.node AS dst, d.n_shared
FROM (
  SELECT src, dst, n_shared FROM (
    SELECT a.node AS src, b.node AS dst, count(*) AS n_shared
    FROM (SELECT DISTINCT node, key FROM {keys_cte}) a JOIN (SELECT DISTINCT node, key FROM {keys_cte}) b
      ON a.key = b.key AND a.node < b.node GROUP BY 1, 2) p
  UNION ALL SELECT dst, src, n_shared FROM (
    SELECT a.node AS src, b.node AS dst, count(*) AS n_shared
    FROM (SELECT DISTINCT node, key FROM {keys_cte}) a JOIN (SELECT DISTINCT node, key FROM {keys_cte}) b
      ON a.key = b.key AND a.node < b.node GROUP BY 1, 2) q{selfp}
) d JOIN ids i1 ON i1.lens_id = d.src JOIN ids i2 ON i2.lens_id = d.dst""")


cte("raw_keys_ne", ("raw_keys",), "SELECT node, key FROM raw_keys WHERE key <> ''")
cte("kp_keys", ("with_kp",), """
SELECT lens_id AS node, unnest(string_split(keyphrases, '|')) AS key FROM with_kp""")
cte("kp_keys_ne", ("kp_keys",), "SELECT node, key FROM kp_keys WHERE key <> ''")
_edges_sql("g3_edges", "level_keys", "same_classification")
_edges_sql("g2_edges", "raw_keys_ne", "same_classification")
_edges_sql("g2_edges_all", "raw_keys", "same_classification", self_loops=True)
_edges_sql("g4_edges", "kp_keys_ne", "same_keyphrase")


def _graph(spark: SparkSession, sf_dir: str):
    """Records (ids, labels and codes only) and node tables as stage tables: every
    later join reads them instead of re-planning records -> ranks in each branch."""
    recs = cut_lineage(fx.records(spark, sf_dir).select("lens_id", "category", "cpc", "ipcr")
                       .withColumn("classifications", merge_codes("cpc", "ipcr")))
    nodes, cats, feats = g.build_nodes(recs, materialize=True)
    return recs, nodes, cats, feats


def _edges(recs: DataFrame, nodes: DataFrame) -> Links:
    """Class-code (group level) edges, not stored: each step that reads them finds or adds them up itself."""
    return g.class_links(recs, nodes)


@query("g1_build_nodes", sql=sql(["nodes"], "SELECT node, lens_id, y FROM nodes"))
def g1(spark, sf):
    return _graph(spark, sf)[1]


@query("p20_one_hot", sql=sql(["feats"], "SELECT node, dim, value FROM feats"))
def p20(spark, sf):
    return _graph(spark, sf)[3]


@query("p20_one_hot_array", sql=sql(["feats", "cats"], """,
n AS (SELECT count(*) AS k FROM cats)
SELECT f.node, CAST(list_position(list_transform(range(0, n.k), lambda i: CASE WHEN i = f.dim THEN 1.0 ELSE 0.0 END), 1.0) - 1 AS BIGINT) AS hot,
       n.k AS width FROM feats f, n"""))
def p20_array(spark, sf):
    _, _, cats, feats = _graph(spark, sf)
    per = feats.groupBy("node").agg(F.collect_set("dim").alias("dims"))
    from corpusloom.operators.ranking import attach_scalars
    x = attach_scalars(per, cats.agg(F.count(F.lit(1)).alias("k")))
    x = g.one_hot(x, "dims", F.col("k"))
    return x.select("node", (F.array_position("x", 1.0) - 1).cast("long").alias("hot"), F.col("k").alias("width"))


@query("w1_dense_index", sql=sql(["cats"], "SELECT category, cat FROM cats"))
def w1(spark, sf):
    return _graph(spark, sf)[2]


@query("j2_attach_index", sql=sql(["ids", "cats"], """
SELECT r.lens_id, r.category, i.node, c.cat FROM records r JOIN ids i ON i.lens_id = r.lens_id JOIN cats c ON c.category = r.category"""))
def j2(spark, sf):
    recs, nodes, cats, _ = _graph(spark, sf)
    x = g.attach_index(recs.select("lens_id", "category"), nodes, "lens_id", "node", "node")
    return g.attach_index(x, cats, "category", "cat", "cat")


@query("w7_last_label", sql="""
SELECT l_partkey AS id, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber)) AS label
FROM lineitem GROUP BY l_partkey""")
def w7(spark, sf):
    from corpusloom.sources.tables import table
    li = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("label"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("seq"))
    return g.last_label(li, "id", "label", "seq")


@query("a4_inverted_index", sql=sql(["raw_keys"], """
SELECT key, count(*) AS n_postings, count(DISTINCT node) AS n_nodes FROM raw_keys GROUP BY key"""))
def a4(spark, sf):
    recs = fx.records(spark, sf)
    return g.inverted_index(_raw_incidence(recs, drop_empty=False))


def _class_edges(spark, sf, levels, drop_empty=True, drop_self=True):
    recs, nodes, _, _ = _graph(spark, sf)
    return g.class_edges(recs, nodes, levels=levels, drop_empty=drop_empty, drop_self=drop_self)


@query("g2_class_edges", sql=sql(["g2_edges"], "SELECT * FROM g2_edges"))
def g2(spark, sf):
    return _class_edges(spark, sf, None)


@query("g2_class_edges_with_empty_key", sql=sql(["g2_edges_all"], "SELECT * FROM g2_edges_all"))
def g2_all(spark, sf):
    """The reference's behaviour: the empty key links every code-less record
    (one clique) and a key repeated inside a record adds a self loop."""
    return _class_edges(spark, sf, None, drop_empty=False, drop_self=False)


@query("g3_class_edges", sql=sql(["g3_edges"], "SELECT * FROM g3_edges"))
def g3(spark, sf):
    return _class_edges(spark, sf, ("group",))


@query("g4_keyphrase_edges", sql=sql(["g4_edges"], "SELECT * FROM g4_edges"))
def g4(spark, sf):
    recs = cut_lineage(fx.with_keyphrases(spark, sf, codes=False).select("lens_id", "category", "keyphrases"))
    nodes, _, _ = g.build_nodes(recs, materialize=True)
    return g.keyphrase_edges(recs, nodes)


@query("j1_basket_pairs", sql="""
WITH b AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS id, CAST(l_orderkey AS VARCHAR) AS key FROM lineitem)
SELECT x.id AS src, y.id AS dst, count(*) AS n_shared FROM b x JOIN b y ON x.key = y.key AND x.id < y.id GROUP BY 1, 2""")
def j1(spark, sf):
    """J1 at bench size: parts linked by a common order, one row per
    undirected pair with the number of shared orders."""
    b = fx.baskets(spark, sf).select(F.col("id").alias("node"), "key")
    return g.cooccurrence_pairs(b).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_shared"))


@query("j1_pair_count_by_category", sql=sql(["level_keys", "records"], """,
inc AS (SELECT DISTINCT node, key FROM level_keys)
SELECT ra.category AS src_grp, rb.category AS dst_grp, count(*) AS n_pairs
FROM inc a JOIN inc b ON a.key = b.key AND a.node <> b.node
JOIN records ra ON ra.lens_id = a.node JOIN records rb ON rb.lens_id = b.node GROUP BY 1, 2"""))
def j1_counts(spark, sf):
    """Directed (pair, shared key) counts per category pair computed per key
    (cnt_a * cnt_b), never emitting pairs — safe for any key size."""
    recs = fx.records(spark, sf)
    groups = recs.select(F.col("lens_id").alias("node"), F.col("category").alias("grp"))
    return g.pair_count_by_group(_level_incidence(recs), groups)


@query("j3_category_edges", sql=sql(["ids", "cats"], """
SELECT 'contains' AS edge_type, i.node AS src, c.cat AS dst FROM records r JOIN ids i ON i.lens_id = r.lens_id JOIN cats c ON c.category = r.category"""))
def j3(spark, sf):
    recs, nodes, cats, _ = _graph(spark, sf)
    return g.category_edges(recs, nodes, cats).filter(F.col("edge_type") == "contains")


@query("g5_category_edges", sql=sql(["ids", "cats"], """,
e AS (SELECT i.node AS src, c.cat AS dst FROM records r JOIN ids i ON i.lens_id = r.lens_id JOIN cats c ON c.category = r.category)
SELECT 'contains' AS edge_type, src, dst FROM e UNION ALL SELECT 'rev_contains', dst, src FROM e"""))
def g5(spark, sf):
    recs, nodes, cats, _ = _graph(spark, sf)
    return g.category_edges(recs, nodes, cats)


@query("u4_to_undirected", sql=sql(["g3_edges", "ids", "cats"], """,
ce AS (SELECT i.node AS src, c.cat AS dst FROM records r JOIN ids i ON i.lens_id = r.lens_id JOIN cats c ON c.category = r.category)
SELECT edge_type, src, dst FROM g3_edges UNION SELECT edge_type, dst, src FROM g3_edges
UNION ALL SELECT 'contains', src, dst FROM ce UNION ALL SELECT 'rev_contains', dst, src FROM ce"""))
def u4(spark, sf):
    """Every edge: reverses of the one type coalesced, the bipartite type reversed."""
    recs, nodes, cats, _ = _graph(spark, sf)
    ce = g.category_edges(recs, nodes, cats).filter(F.col("edge_type") == "contains")
    return g.to_undirected(ce, bipartite_types=["contains"], found=_edges(recs, nodes))


@query("w4_fallback_masks", sql=sql(["ids"], """
SELECT node, node < floor(n * 0.8) AS train_mask, false AS val_mask, node >= floor(n * 0.8) AS test_mask
FROM ids, (SELECT count(*) AS n FROM ids)"""))
def w4(spark, sf):
    return g.fallback_masks(_graph(spark, sf)[1]).select("node", "train_mask", "val_mask", "test_mask")


@query("a12_graph_profile", sql=sql(["nodes", "g3_edges", "feats"], """
SELECT (SELECT count(*) FROM nodes) AS num_nodes, (SELECT count(DISTINCT y) FROM nodes) AS num_classes,
       (SELECT count(*) FROM g3_edges) AS num_edges,
       (SELECT count(*) = 0 FROM g3_edges e WHERE NOT EXISTS (SELECT 1 FROM g3_edges m WHERE m.src = e.dst AND m.dst = e.src)) AS is_undirected,
       (SELECT max(dim) + 1 FROM feats) AS feature_dim"""))
def a12(spark, sf):
    recs, nodes, _, feats = _graph(spark, sf)
    return g.graph_profile(nodes, _edges(recs, nodes), features=feats)


_GCN = """,
e AS (SELECT DISTINCT src, dst FROM g3_edges WHERE src <> dst),
deg AS (SELECT n.node, 1.0 / sqrt(1 + coalesce(d.c, 0)) AS dinv
        FROM ids n LEFT JOIN (SELECT dst AS node, count(*) AS c FROM e GROUP BY dst) d ON d.node = n.node),
x0 AS (SELECT node, dim, value FROM feats),
y0 AS (SELECT x.node, x.dim, x.value * deg.dinv AS v FROM x0 x JOIN deg USING (node)),
h1 AS (SELECT m.node, m.dim, sum(m.v) * any_value(deg.dinv) AS value
       FROM (SELECT e.dst AS node, y.dim, y.v FROM e JOIN y0 y ON y.node = e.src UNION ALL SELECT node, dim, v FROM y0) m
       JOIN deg USING (node) GROUP BY m.node, m.dim)"""


@query("g7_gcn_propagate", sql=sql(["g3_edges", "ids", "feats"], _GCN + "\nSELECT node, dim, value FROM h1"))
def g7(spark, sf):
    recs, nodes, _, feats = _graph(spark, sf)
    return g.gcn_propagate(nodes, _edges(recs, nodes), feats, hops=1)


@query("g7_gcn_two_hop", sql=sql(["g3_edges", "ids", "feats"], _GCN + """,
y1 AS (SELECT x.node, x.dim, x.value * deg.dinv AS v FROM h1 x JOIN deg USING (node)),
h2 AS (SELECT m.node, m.dim, sum(m.v) * any_value(deg.dinv) AS value
       FROM (SELECT e.dst AS node, y.dim, y.v FROM e JOIN y1 y ON y.node = e.src UNION ALL SELECT node, dim, v FROM y1) m
       JOIN deg USING (node) GROUP BY m.node, m.dim)
SELECT node, dim, value FROM h2"""))
def g7_two(spark, sf):
    recs, nodes, _, feats = _graph(spark, sf)
    return g.gcn_propagate(nodes, _edges(recs, nodes), feats, hops=2)


@query("j7_neighbour_sum", sql=sql(["g3_edges", "feats"], """
SELECT e.dst AS node, f.dim, sum(f.value) AS value FROM g3_edges e JOIN feats f ON f.node = e.src GROUP BY e.dst, f.dim"""))
def j7(spark, sf):
    recs, nodes, _, feats = _graph(spark, sf)
    return _edges(recs, nodes).received(feats).select("node", "dim", F.col("s").alias("value"))


_SAGE = """,
nb AS (SELECT DISTINCT src, dst FROM g3_edges),
indeg AS (SELECT dst AS node, count(*) AS deg FROM nb GROUP BY dst),
d AS (SELECT max(dim) + 1 AS w FROM feats),
pool AS (SELECT nb.dst AS node, f.dim, {agg}(f.value) AS p, count(*) AS k FROM nb JOIN feats f ON f.node = nb.src GROUP BY nb.dst, f.dim),
neigh AS (SELECT p.node, p.dim + d.w AS dim, {val} AS value FROM pool p JOIN indeg i USING (node), d)
SELECT node, dim, value FROM (SELECT node, dim, value FROM feats UNION ALL SELECT node, dim, value FROM neigh) WHERE value <> 0"""


@query("g8_sage_mean", sql=sql(["g3_edges", "feats"], _SAGE.format(agg="sum", val="p / i.deg")))
def g8_mean(spark, sf):
    recs, nodes, _, feats = _graph(spark, sf)
    return g.sage_aggregate(nodes, _edges(recs, nodes), feats, agg="mean")


@query("g8_sage_max", sql=sql(["g3_edges", "feats"], _SAGE.format(
    agg="max", val="CASE WHEN p.k < i.deg THEN greatest(p.p, 0.0) ELSE p.p END")))
def g8_max(spark, sf):
    recs, nodes, _, feats = _graph(spark, sf)
    return g.sage_aggregate(nodes, _edges(recs, nodes), feats, agg="max")


def _sage_hop(k: int, x: str) -> str:
    return f""",
d{k} AS (SELECT max(dim) + 1 AS w FROM {x}),
p{k} AS (SELECT nb.dst AS node, f.dim, sum(f.value) AS p FROM nb JOIN {x} f ON f.node = nb.src GROUP BY nb.dst, f.dim),
x{k} AS (SELECT node, dim, value FROM (SELECT node, dim, value FROM {x} UNION ALL
         SELECT p.node, p.dim + d.w, p.p / i.deg FROM p{k} p JOIN indeg i USING (node), d{k} d) WHERE value <> 0)"""


@query("g8_sage_two_hop", sql=sql(["g3_edges", "feats"], """,
nb AS (SELECT DISTINCT src, dst FROM g3_edges),
indeg AS (SELECT dst AS node, count(*) AS deg FROM nb GROUP BY dst)""" + _sage_hop(1, "feats") + _sage_hop(2, "x1")
                                  + "\nSELECT node, dim, value FROM x2"))
def g8_two(spark, sf):
    recs, nodes, _, feats = _graph(spark, sf)
    return g.sage_aggregate(nodes, _edges(recs, nodes), feats, agg="mean", hops=2)


def _gcn_cte(t: str, edges: str) -> str:
    return f""",
e_{t} AS (SELECT DISTINCT src, dst FROM {edges} WHERE src <> dst),
deg_{t} AS (SELECT n.node, 1.0 / sqrt(1 + coalesce(d.c, 0)) AS dinv
            FROM ids n LEFT JOIN (SELECT dst AS node, count(*) AS c FROM e_{t} GROUP BY dst) d ON d.node = n.node),
y_{t} AS (SELECT x.node, x.dim, x.value * deg.dinv AS v FROM feats x JOIN deg_{t} deg USING (node)),
h_{t} AS (SELECT m.node, m.dim, sum(m.v) * any_value(deg.dinv) AS value
          FROM (SELECT e.dst AS node, y.dim, y.v FROM e_{t} e JOIN y_{t} y ON y.node = e.src
                UNION ALL SELECT node, dim, v FROM y_{t}) m JOIN deg_{t} deg USING (node) GROUP BY m.node, m.dim)"""


@query("g9_hetero_propagate", sql=sql(["g3_edges", "g4_edges", "ids", "feats"],
                                      _gcn_cte("a", "g3_edges") + _gcn_cte("b", "g4_edges") + """
SELECT node, dim, sum(value) AS value FROM (SELECT * FROM h_a UNION ALL SELECT * FROM h_b) GROUP BY node, dim"""))
def g9(spark, sf):
    """Per-edge-type GCN over class-code and keyphrase edges, summed per node
    and dim (the heterogeneous convolution's ``aggr='sum'``)."""
    recs = cut_lineage(fx.with_keyphrases(spark, sf).withColumn("classifications", merge_codes("cpc", "ipcr"))
                       .select("lens_id", "category", "classifications", "keyphrases"))
    nodes, _, feats = g.build_nodes(recs, materialize=True)
    edges = [_edges(recs, nodes), g.keyphrase_links(recs, nodes)]
    return g.hetero_propagate(nodes, edges, feats, ["same_classification", "same_keyphrase"])


@query("g7_shared_key_messages", sql=sql(["level_keys", "ids", "feats"], """,
inc AS (SELECT DISTINCT i.node, k.key FROM level_keys k JOIN ids i ON i.lens_id = k.node),
pairs AS (SELECT a.node AS src, b.node AS dst, count(*) AS w FROM inc a JOIN inc b ON a.key = b.key AND a.node <> b.node GROUP BY 1, 2)
SELECT p.dst AS node, f.dim, sum(p.w * f.value) AS value FROM pairs p JOIN feats f ON f.node = p.src GROUP BY 1, 2
HAVING sum(p.w * f.value) <> 0"""))
def g7_shared(spark, sf):
    """``n_shared``-weighted neighbour sums straight from the incidence table
    (two aggregations, no pairs): the hot-key-proof form of the message step."""
    recs, nodes, _, feats = _graph(spark, sf)
    inc = g._to_dense(_level_incidence(recs), nodes)
    return g.shared_key_propagate(inc, feats)


@query("p21_normalise_rows", sql=sql(["vectors"], """,
e AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, abs(embedding[i]) AS x FROM (SELECT vec_id, embedding, generate_subscripts(embedding, 1) AS i FROM vectors))
SELECT vec_id, dim, CASE WHEN s <> 0 THEN x / s ELSE x END AS value FROM (SELECT *, sum(x) OVER (PARTITION BY vec_id) AS s FROM e)"""))
def p21(spark, sf):
    v = fx.vectors(spark, sf).select("vec_id", F.transform("embedding", lambda x: F.abs(x)).alias("a"))
    return v.select("vec_id", F.posexplode(g.normalise_rows("a")).alias("dim", "value"))


cte("edge_split", ("g3_edges",), """
SELECT e.edge_type, e.src, e.dst, CASE WHEN rk < n - floor(n * 0.05) - floor(n * 0.10) THEN 'train' WHEN rk < n - floor(n * 0.10) THEN 'val' ELSE 'test' END AS split
FROM g3_edges e JOIN (SELECT *, row_number() OVER (PARTITION BY edge_type ORDER BY md5('42:' || edge_type || ':' || a || ':' || b), a, b) - 1 AS rk,
                             count(*) OVER (PARTITION BY edge_type) AS n
                      FROM (SELECT DISTINCT edge_type, least(src, dst) AS a, greatest(src, dst) AS b FROM g3_edges)) r
  ON r.edge_type = e.edge_type AND r.a = least(e.src, e.dst) AND r.b = greatest(e.src, e.dst)""")


@query("b8_split_edges", sql=sql(["edge_split"], "SELECT * FROM edge_split"))
def b8(spark, sf):
    """Every edge with its split."""
    recs, nodes, _, _ = _graph(spark, sf)
    return g.split_edges(_edges(recs, nodes), 0.05, 0.10, seed=42)


@query("b8_link_views", sql=sql(["edge_split"], """
SELECT v.view, v.role, e.edge_type, e.src, e.dst FROM edge_split e
JOIN (VALUES ('train', 'train', 'message'), ('train', 'train', 'supervision'), ('train', 'val', 'message'), ('train', 'test', 'message'),
             ('val', 'val', 'supervision'), ('val', 'test', 'message'), ('test', 'test', 'supervision')) v(split, view, role) USING (split)"""))
def b8_views(spark, sf):
    """What a link predictor may use and must predict in each stage."""
    recs, nodes, _, _ = _graph(spark, sf)
    return g.link_views(g.split_edges(_edges(recs, nodes), 0.05, 0.10, seed=42))


# ---------------------------------------------------------------- quotient by structural twins (all raw keys, the empty one too)

cte("key_sets", ("raw_keys", "ids"), """
SELECT i.node, list_sort(list(DISTINCT k.key)) AS keys FROM raw_keys k JOIN ids i ON i.lens_id = k.node GROUP BY i.node""")
cte("twin_members", ("key_sets",), "SELECT node, min(node) OVER (PARTITION BY keys) AS cls, count(*) OVER (PARTITION BY keys) AS size, keys FROM key_sets")
cte("twin_edges", ("twin_members",), """
SELECT a.cls AS src, b.cls AS dst, count(*) AS n_shared
FROM (SELECT DISTINCT cls, unnest(keys) AS key FROM twin_members) a JOIN (SELECT DISTINCT cls, unnest(keys) AS key FROM twin_members) b
  ON a.key = b.key AND a.cls <> b.cls GROUP BY 1, 2""")


def _twins(spark, sf):
    recs, nodes, _, feats = _graph(spark, sf)
    return tw.twin_graph(g._to_dense(_raw_incidence(recs, drop_empty=False), nodes)), feats


@query("g2_twin_members", sql=sql(["twin_members"], "SELECT node, cls, size, len(keys) AS n_keys FROM twin_members"))
def g2_members(spark, sf):
    """Every record with the class of records that have the same codes (those without codes are one)."""
    graph, _ = _twins(spark, sf)
    return graph.members.join(graph.classes, "cls").select("node", "cls", "size", "n_keys")


@query("g2_twin_edges", sql=sql(["twin_edges"], "SELECT * FROM twin_edges"))
def g2_quotient(spark, sf):
    """Edges between classes."""
    return _twins(spark, sf)[0].edges


_PAIR_GCN = """
deg_{t} AS (SELECT n.node, 1.0 / sqrt(1 + coalesce(d.c, 0)) AS dinv FROM ids n LEFT JOIN (SELECT dst AS node, count(*) AS c FROM e_{t} GROUP BY dst) d ON d.node = n.node),
y_{t} AS (SELECT x.node, x.dim, x.value * d.dinv AS v FROM {x} x JOIN deg_{t} d USING (node)),
h_{t} AS (SELECT m.node, m.dim, sum(m.v) * any_value(d.dinv) AS value
          FROM (SELECT e.dst AS node, y.dim, y.v FROM e_{t} e JOIN y_{t} y ON y.node = e.src UNION ALL SELECT node, dim, v FROM y_{t}) m
          JOIN deg_{t} d USING (node) GROUP BY m.node, m.dim)"""


@query("g7_twin_propagate", sql=sql(["g2_edges_all", "ids", "feats"], """,
e_a AS (SELECT DISTINCT src, dst FROM g2_edges_all WHERE src <> dst),""" + _PAIR_GCN.format(t="a", x="feats") + """,
e_b AS (SELECT * FROM e_a),""" + _PAIR_GCN.format(t="b", x="h_a") + """
SELECT node, dim, value FROM h_b"""))
def g7_twins(spark, sf):
    """Two propagation steps over the quotient; SQL takes them over all pairs."""
    graph, feats = _twins(spark, sf)
    return tw.to_nodes(graph, tw.twin_propagate(graph, feats, hops=2))


@query("g9_twin_hetero_propagate", sql=sql(["g2_edges_all", "g4_edges", "ids", "feats"], """,
e_a AS (SELECT DISTINCT src, dst FROM g2_edges_all WHERE src <> dst),""" + _PAIR_GCN.format(t="a", x="feats") + """,
e_b AS (SELECT DISTINCT src, dst FROM g4_edges WHERE src <> dst),""" + _PAIR_GCN.format(t="b", x="feats") + """
SELECT node, dim, sum(value) AS value FROM (SELECT * FROM h_a UNION ALL SELECT * FROM h_b) GROUP BY node, dim"""))
def g9_twins(spark, sf):
    """Class codes and keyphrases, each over its own quotient."""
    recs = cut_lineage(fx.with_keyphrases(spark, sf).select("lens_id", "category", "cpc", "ipcr", "keyphrases"))
    nodes, _, feats = g.build_nodes(recs, materialize=True)
    by_code = tw.twin_graph(g._to_dense(_raw_incidence(recs, drop_empty=False), nodes))
    by_phrase = tw.twin_graph(g._to_dense(g.incidence(recs, "lens_id", "keyphrases"), nodes))
    return tw.twin_hetero_propagate([by_code, by_phrase], feats)
