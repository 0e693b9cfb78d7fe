"""Co-occurrence graphs over an incidence table and feature propagation on them
(J1-J3, J7, G1-G9, U4, A4, A12, P20, W1, W4, W7).

Data model
----------
* incidence ``(node, key)`` — one row per (record, key); the inverted index of
  the reference *is* this table.
* edges ``(edge_type, src, dst[, n_shared])`` — directed, coalesced rows.
* node features in long, sparse form ``(node, dim, value)``: aggregations stay
  partial (map-side) and no vector is ever assembled in one task.

Scale notes
-----------
A key shared by ``m`` records yields ``m(m-1)/2`` pairs.  ``cooccurrence_pairs``
splits every key into ``b = ceil(m / block_rows)`` hash blocks and joins block
``p`` against block ``q >= p`` as separate join keys, so a hot key's pairs are
spread evenly over ``b(b+1)/2`` tasks instead of landing in one.  Aggregates that
only need pair *counts* (``pair_count_by_group``) or ``n_shared``-weighted sums
(``shared_key_propagate``) never emit pairs at all.

Edges between dense ids are found under their smallest shared key (``operators/links``): pairs are not
shuffled, and an operator that is given ``Links`` in place of edge rows does not store them either
(profile, split) or makes none (degrees, propagation).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import KEY_SEP, code_levels, explode_keys, normalise_codes
from corpusloom.operators.links import LINK_ROWS, Links, links
from corpusloom.operators.partitioning import default_parallelism
from corpusloom.operators.ranking import attach_scalars, hash32, hash_rank, seeded_hash
from corpusloom.session import cut_lineage, met, stage_table

DEFAULT_BLOCK_ROWS = 2048


# --------------------------------------------------------------------------- incidence

def incidence(df: DataFrame, id_col: str, keys_col: str, sep: str = KEY_SEP,
              drop_empty: bool = True, levels: Sequence[str] | None = None) -> DataFrame:
    """P8 (+P9): ``(node, key)`` rows from a packed key column.

    ``levels=None`` uses the raw split keys (G2/G4); ``levels=('group',)`` maps
    every code to its hierarchy levels first (G3), which drops empty and
    slash-less codes.  Repeats inside one record are kept here.
    """
    x = explode_keys(df.select(F.col(id_col).alias("node"), F.col(keys_col).alias("_k")), "_k", sep,
                     drop_empty=drop_empty and levels is None)
    if levels is not None:
        x = x.select("node", F.explode(code_levels("key", levels)).alias("key"))
    return x.select("node", "key")


def inverted_index(inc: DataFrame) -> DataFrame:
    """A4: per key the number of postings (duplicates kept) and of distinct nodes.
    The posting lists themselves are the incidence rows — never collected."""
    return inc.groupBy("key").agg(F.count(F.lit(1)).alias("n_postings"),
                                  F.countDistinct("node").alias("n_nodes"))


# --------------------------------------------------------------------------- J1

def cooccurrence_pairs(inc: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS,
                       keep_key: bool = False) -> DataFrame:
    """All unordered pairs ``src < dst`` of distinct nodes sharing a key, one row
    per (pair, shared key).  Hot keys are split into hash blocks (see module doc)."""
    inc = inc.select("node", "key").distinct()
    sizes = (inc.groupBy("key").agg(F.count(F.lit(1)).alias("_m"))
             .filter(F.col("_m") >= 2)
             .withColumn("_b", F.ceil(F.col("_m") / F.lit(block_rows)).cast("int")))
    x = inc.join(sizes, "key").withColumn("_u", F.pmod(F.xxhash64("node"), F.col("_b")).cast("int"))
    left = x.select("key", F.col("node").alias("a"), F.col("_u").alias("_p"),
                    F.explode(F.sequence(F.col("_u"), F.col("_b") - 1)).alias("_q"))
    right = x.select("key", F.col("node").alias("c"),
                     F.explode(F.sequence(F.lit(0), F.col("_u"))).alias("_p"), F.col("_u").alias("_q"))
    # The join's output is quadratic in its input, so size-based partition
    # coalescing (which sees only the small input) would starve it: fix the
    # partition count on the block key; the join reuses this partitioning.
    n = default_parallelism(inc)
    left = left.repartition(n, "key", "_p", "_q")
    right = right.repartition(n, "key", "_p", "_q")
    # Sort-merge (not a forced hash join): a partition holds many cells and
    # must be able to spill at scale.
    pairs = (left.join(right, ["key", "_p", "_q"])
             .where((F.col("_p") < F.col("_q")) | (F.col("a") < F.col("c"))))
    cols = [F.least("a", "c").alias("src"), F.greatest("a", "c").alias("dst")]
    if keep_key:
        cols.append("key")
    return pairs.select(*cols)


def self_pairs(inc: DataFrame) -> DataFrame:
    """Self pairs ``(i, i)`` of the reference: a key repeated inside one record."""
    return (inc.groupBy("node", "key").count().filter(F.col("count") >= 2)
            .select(F.col("node").alias("src"), F.col("node").alias("dst")).distinct())


def cooccurrence_edges(inc: DataFrame, edge_type: str, drop_self: bool = True,
                       directed: bool = True, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """J1 + U4: coalesced co-occurrence edges ``(edge_type, src, dst, n_shared)``.

    Pairs of long ids come from ``links``; others are made key by key in blocks of ``block_rows`` and
    aggregated on ``src < dst`` (partial aggregation map-side).  Both are mirrored only at the end.  ``drop_self=False`` adds the self
    loops the reference creates for a key repeated inside one record.
    """
    if inc.schema["node"].dataType == T.LongType():
        und = links(inc, edge_type).pairs()
    else:
        und = (cooccurrence_pairs(inc, block_rows)
               .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_shared")))
    if directed:
        # Both directions from one pass over the aggregated pairs (no second
        # evaluation of the pair join as a union branch would need).
        und = und.select(F.explode(F.array(
            F.struct(F.col("src").alias("s"), F.col("dst").alias("d"), "n_shared"),
            F.struct(F.col("dst").alias("s"), F.col("src").alias("d"), "n_shared"))).alias("e")) \
            .select(F.col("e.s").alias("src"), F.col("e.d").alias("dst"), F.col("e.n_shared").alias("n_shared"))
    if not drop_self:
        und = und.unionByName(self_pairs(inc).withColumn("n_shared", F.lit(1).cast("long")))
    return und.select(F.lit(edge_type).alias("edge_type"), "src", "dst", "n_shared")


def to_undirected(edges: DataFrame, bipartite_types: Sequence[str] = (), found: Links | None = None) -> DataFrame:
    """U4: same-type edges get their reverses and duplicates are coalesced;
    bipartite types get a reversed edge type ``rev_<type>`` (duplicates kept).  The pairs of ``found``,
    of a type of their own, are told apart where they are found: both ways, nothing left to coalesce."""
    if found is not None:
        return to_undirected(edges, bipartite_types).unionByName(found.edges().select("edge_type", "src", "dst"))
    bip = list(bipartite_types)
    same = edges.filter(~F.col("edge_type").isin(bip)) if bip else edges
    same = (same.select("edge_type", "src", "dst")
            .unionByName(same.select("edge_type", F.col("dst").alias("src"), F.col("src").alias("dst")))
            .dropDuplicates(["edge_type", "src", "dst"]))
    if not bip:
        return same
    b = edges.filter(F.col("edge_type").isin(bip)).select("edge_type", "src", "dst")
    rev = b.select(F.concat(F.lit("rev_"), "edge_type").alias("edge_type"),
                   F.col("dst").alias("src"), F.col("src").alias("dst"))
    return same.unionByName(b).unionByName(rev)


def pair_count_by_group(inc: DataFrame, groups: DataFrame) -> DataFrame:
    """Directed pair count per (source group, destination group) *with*
    multiplicity (a pair sharing k keys counts k times), without emitting pairs:
    per key, ``cnt(a) * cnt(b)`` minus the diagonal.  ``groups`` is ``(node, grp)``."""
    x = inc.select("node", "key").distinct().join(groups, "node")
    per = x.groupBy("key", "grp").agg(F.count(F.lit(1)).alias("c"))
    a = per.select("key", F.col("grp").alias("src_grp"), F.col("c").alias("ca"))
    b = per.select("key", F.col("grp").alias("dst_grp"), F.col("c").alias("cb"))
    prod = a.join(b, "key").select(
        "src_grp", "dst_grp",
        F.when(F.col("src_grp") == F.col("dst_grp"), F.col("ca") * (F.col("ca") - 1))
        .otherwise(F.col("ca") * F.col("cb")).alias("n"))
    return prod.groupBy("src_grp", "dst_grp").agg(F.sum("n").alias("n_pairs")).filter(F.col("n_pairs") > 0)


# --------------------------------------------------------------------------- nodes

def dense_index(df: DataFrame, col: str, index_col: str = "idx", seed: int = 0) -> DataFrame:
    """Dense 0-based index over the distinct values of ``col``.

    The reference numbers ids by first appearance; Spark has no row order, so
    the index follows a seeded hash order (a bijection — the graph is the same
    up to relabelling) computed with the skew-safe exact rank."""
    d = df.select(col).distinct().filter(F.col(col).isNotNull())
    return hash_rank(d, seeded_hash(seed, col), tiebreak=[col], rank_col=index_col)


def last_label(df: DataFrame, id_col: str, label_col: str, seq_col: str) -> DataFrame:
    """The label of the last row per id in an explicit load order ``seq_col``."""
    return df.groupBy(id_col).agg(F.max_by(label_col, seq_col).alias(label_col))


def build_nodes(records: DataFrame, id_col: str = "lens_id", label_col: str = "category",
                seq_col: str | None = None, seed: int = 0,
                materialize: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """G1: node tables for records and categories.

    Returns ``(nodes, categories, features)``:
    * nodes ``(node, lens_id, y)`` — dense index, id, last label's index (W7);
    * categories ``(cat, category)`` — dense category index;
    * features ``(node, dim, value)`` — P20 multi-hot of every category an id
      appears under (sparse: only ones are stored).
    """
    cats = dense_index(records, label_col, "cat", seed).withColumnRenamed(label_col, "category")
    ids = dense_index(records, id_col, "node", seed).withColumnRenamed(id_col, "lens_id")
    r = records.select(F.col(id_col).alias("lens_id"), F.col(label_col).alias("category"),
                       (F.col(seq_col) if seq_col else F.col(id_col)).alias("_seq"))
    r = met(r.join(cats, "category"), ids, "lens_id")
    if materialize:
        # one stage table (rows with both indices); nodes and features are
        # cheap aggregates of it
        r = cut_lineage(r)
    # rows that tie in the order (all rows of an id without one) are told apart by label
    nodes = r.groupBy("node", "lens_id").agg(F.max_by("cat", F.struct("_seq", "cat")).alias("y"))
    feats = r.select("node", F.col("cat").alias("dim")).distinct().withColumn("value", F.lit(1.0))
    return nodes, cats, feats


def one_hot(df: DataFrame, idx_col: str, n: Column | int, out_col: str = "x") -> DataFrame:
    """P20 in array form: multi-hot vector of the indices collected per row
    (``idx_col`` is an array of indices)."""
    n = F.lit(n) if isinstance(n, int) else n
    return df.withColumn(out_col, F.transform(F.sequence(F.lit(0), n - 1),
                                              lambda i: F.when(F.array_contains(F.col(idx_col), i), 1.0)
                                              .otherwise(0.0)))


def attach_index(df: DataFrame, index: DataFrame, on: str, idx_col: str, out_col: str) -> DataFrame:
    """Id -> dense index lookup (a join; Catalyst/AQE picks broadcast or SMJ)."""
    return df.join(index.select(F.col(on), F.col(idx_col).alias(out_col)), on)


def category_edges(records: DataFrame, nodes: DataFrame, cats: DataFrame,
                   id_col: str = "lens_id", label_col: str = "category") -> DataFrame:
    """Record -> category bipartite edges, one per record row, plus the
    reversed type (U4 for bipartite edges)."""
    e = (records.select(F.col(id_col).alias("lens_id"), F.col(label_col).alias("category"))
         .join(nodes.select("lens_id", "node"), "lens_id").join(cats, "category")
         .select(F.lit("contains").alias("edge_type"), F.col("node").alias("src"), F.col("cat").alias("dst")))
    return to_undirected(e, bipartite_types=["contains"])


def node_masks(nodes: DataFrame, split: DataFrame, id_col: str = "lens_id",
               test_col: str = "is_test") -> DataFrame:
    """``train_mask``/``test_mask`` per node from the split flag of its rows."""
    m = (split.groupBy(F.col(id_col).alias("lens_id"))
         .agg(F.bool_or(F.col(test_col)).alias("test_mask"),
              F.bool_or(~F.col(test_col)).alias("train_mask")))
    return (nodes.join(m, "lens_id", "left")
            .select("node", "lens_id", F.coalesce("train_mask", F.lit(False)).alias("train_mask"),
                    F.coalesce("test_mask", F.lit(False)).alias("test_mask")))


def fallback_masks(nodes: DataFrame, train: float = 0.8, val: float = 0.0) -> DataFrame:
    """Positional masks on dense ids: first ``floor(train*n)`` nodes train,
    the next ``floor(val*n)`` validation, the rest test."""
    x = attach_scalars(nodes, nodes.agg(F.count(F.lit(1)).alias("_n")))
    nt = F.floor(F.col("_n") * train)
    nv = F.floor(F.col("_n") * val)
    return (x.withColumn("train_mask", F.col("node") < nt)
            .withColumn("val_mask", (F.col("node") >= nt) & (F.col("node") < nt + nv))
            .withColumn("test_mask", F.col("node") >= nt + nv).drop("_n"))


# --------------------------------------------------------------------------- graph builders

def class_edges(records: DataFrame, nodes: DataFrame, codes_col: str = "classifications",
                levels: Sequence[str] | None = ("group",), drop_empty: bool = True,
                drop_self: bool = True, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """G2 (``levels=None``, raw keys) / G3 (``levels=('group',)``): same-classification
    edges between dense node ids.  ``codes_col`` holds ';;'-packed codes
    (normalised to '|' here, P6).  ``drop_empty=False`` with raw keys reproduces
    the reference's clique of code-less records."""
    inc = _class_incidence(records, nodes, codes_col, levels, drop_empty)
    return cooccurrence_edges(inc, "same_classification", drop_self=drop_self, block_rows=block_rows)


def _class_incidence(records: DataFrame, nodes: DataFrame, codes_col: str, levels: Sequence[str] | None,
                     drop_empty: bool) -> DataFrame:
    r = records.select("lens_id", normalise_codes(codes_col).alias("_codes"))
    return _to_dense(incidence(r, "lens_id", "_codes", drop_empty=drop_empty, levels=levels), nodes)


def class_links(records: DataFrame, nodes: DataFrame, codes_col: str = "classifications",
                levels: Sequence[str] | None = ("group",), block_rows: int = LINK_ROWS) -> Links:
    """The edges of ``class_edges`` (without empty keys and self loops) for operators that need no rows."""
    return links(_class_incidence(records, nodes, codes_col, levels, True), "same_classification", block_rows)


def keyphrase_edges(records: DataFrame, nodes: DataFrame, phrases_col: str = "keyphrases",
                    drop_empty: bool = True, drop_self: bool = True,
                    block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Same-keyphrase edges on the raw '|'-split keyphrase column."""
    inc = _phrase_incidence(records, nodes, phrases_col, drop_empty)
    return cooccurrence_edges(inc, "same_keyphrase", drop_self=drop_self, block_rows=block_rows)


def _phrase_incidence(records: DataFrame, nodes: DataFrame, phrases_col: str, drop_empty: bool) -> DataFrame:
    r = records.select("lens_id", F.col(phrases_col).alias("_k")).filter(F.col("_k").isNotNull())
    return _to_dense(incidence(r, "lens_id", "_k", drop_empty=drop_empty), nodes)


def keyphrase_links(records: DataFrame, nodes: DataFrame, phrases_col: str = "keyphrases",
                    block_rows: int = LINK_ROWS) -> Links:
    """The edges of ``keyphrase_edges`` (without empty keys and self loops) for operators that need no rows."""
    return links(_phrase_incidence(records, nodes, phrases_col, True), "same_keyphrase", block_rows)


def _to_dense(inc: DataFrame, nodes: DataFrame) -> DataFrame:
    return met(inc.withColumnRenamed("node", "lens_id"), nodes.select("lens_id", "node"), "lens_id").select("node", "key")


# --------------------------------------------------------------------------- profile

def graph_profile(nodes: DataFrame, edges: DataFrame | Links | Sequence[Links], masks: DataFrame | None = None,
                  features: DataFrame | None = None) -> DataFrame:
    """One row — node count, directed edge count, train nodes, label rate,
    undirected flag (no edge without its mirror), feature dim, class count.  Edges of ``Links`` are
    distinct and counted where they are found; they are undirected if their hashes, added up, equal those
    of the mirrored edges."""
    n = nodes.agg(F.count(F.lit(1)).alias("num_nodes"),
                  F.countDistinct("y").alias("num_classes"))
    if isinstance(edges, DataFrame):
        e = edges.agg(F.count(F.lit(1)).alias("num_edges"))
        # one aggregation by undirected pair: each pair (but a self loop) needs both directions
        pairs = edges.groupBy("edge_type", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
            F.bool_or(F.col("src") <= F.col("dst")).alias("there"), F.bool_or(F.col("src") >= F.col("dst")).alias("back"))
        u = pairs.agg((F.count_if(~(F.col("there") & F.col("back"))) == 0).alias("is_undirected"))
        out = _one_row_join([n, e, u])
    else:
        rows = _link_rows(edges)
        total = lambda *c: F.coalesce(F.sum(F.xxhash64("edge_type", *c).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))
        out = _one_row_join([n, rows.agg(F.count(F.lit(1)).alias("num_edges"), (total("src", "dst") == total("dst", "src")).alias("is_undirected"))])
    if masks is not None:
        t = masks.agg(F.count_if("train_mask").alias("num_train"))
        out = _one_row_join([out, t]).withColumn(
            "train_label_rate", F.round(F.col("num_train") / F.col("num_nodes"), 6))
    if features is not None:
        out = _one_row_join([out, features.agg((F.max("dim") + 1).alias("feature_dim"))])
    return out


def _link_rows(edges: Links | Sequence[Links]) -> DataFrame:
    """The edges of graphs of different types, both ways."""
    first, *others = [edges] if isinstance(edges, Links) else edges
    out = first.edges()
    for x in others:
        out = out.unionByName(x.edges())
    return out


def _one_row_join(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = attach_scalars(out, f)
    return out


# --------------------------------------------------------------------------- propagation

def _degree_inv_sqrt(nodes: DataFrame, edges: DataFrame | Links) -> DataFrame:
    if isinstance(edges, Links):
        deg = edges.degrees().withColumnRenamed("degree", "_d")
    else:
        deg = edges.filter(F.col("src") != F.col("dst")).groupBy(F.col("dst").alias("node")) \
            .agg(F.count(F.lit(1)).alias("_d"))
    return (met(nodes.select("node"), deg, "node", "left")
            .select("node", F.pow(F.coalesce("_d", F.lit(0)) + 1.0, -0.5).alias("dinv")))


def gcn_propagate(nodes: DataFrame, edges: DataFrame | Links, features: DataFrame, hops: int = 1) -> DataFrame:
    """``X' = D^-1/2 (A + I) D^-1/2 X`` on coalesced 0/1 edges (self
    loops added once, degrees counted with them), repeated ``hops`` times.

    Long form in and out: ``(node, dim, value)``.  Each hop is one join of the
    edge list with pre-scaled features and one ``groupBy(dst, dim).sum`` with
    partial aggregation; hot destination nodes only grow the map-side combine.
    Between hops the features are a stage table, so the plan grows linearly.
    With ``Links`` the messages are added up by key subsets, and no edge is stored.
    """
    e = edges if isinstance(edges, Links) else edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct()
    dinv = _degree_inv_sqrt(nodes, e)
    if isinstance(edges, Links):
        dinv = cut_lineage(dinv)  # read three times by each hop
    x = features.select("node", "dim", F.col("value").cast("double").alias("value"))
    for hop in range(hops):
        if hop:
            x = cut_lineage(x)
        y = met(x, dinv, "node").select("node", "dim", (F.col("value") * F.col("dinv")).alias("v"))
        if isinstance(e, Links):
            msg = e.received(y.withColumnRenamed("v", "value")).select("node", "dim", F.col("s").alias("v"))
        else:
            msg = (e.join(y.withColumnRenamed("node", "src"), "src")
                   .select(F.col("dst").alias("node"), "dim", "v"))
        agg = msg.unionByName(y).groupBy("node", "dim").agg(F.sum("v").alias("s"))
        x = met(agg, dinv, "node").select("node", "dim", (F.col("s") * F.col("dinv")).alias("value"))
    return x


def sage_aggregate(nodes: DataFrame, edges: DataFrame | Links, features: DataFrame, agg: str = "mean",
                   hops: int = 1, n_dims: int | None = None) -> DataFrame:
    """SAGE-style neighbour pooling; the node's own features are kept beside
    the pooled neighbour features (dims ``d..2d-1`` hold the pooled part), then
    the concatenation feeds the next hop.  ``agg`` in mean / max / sum.

    Dense semantics for max/mean: a missing (zero) feature of a neighbour counts
    as 0, so mean = sum / in-degree and max = max(0, stored max) when some
    neighbour lacks the dim.  Between hops the features are a stage table."""
    fn = {"mean": F.sum, "sum": F.sum, "max": F.max}[agg]
    if isinstance(edges, Links):
        indeg = cut_lineage(edges.degrees().withColumnRenamed("degree", "_deg"))
    else:
        e = edges.select("src", "dst").distinct()
        indeg = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_deg"))
    x = features.select("node", "dim", F.col("value").cast("double").alias("value"))
    for hop in range(hops):
        if hop:
            x = cut_lineage(x)
        d = x.agg((F.max("dim") + 1).alias("_d")) if n_dims is None else None
        if isinstance(edges, Links):
            pooled = edges.received(x, most=agg == "max").select("node", "dim", F.col("m" if agg == "max" else "s").alias("p"), F.col("k").alias("_k"))
        else:
            msg = e.join(x.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "dim", "value")
            pooled = msg.groupBy("node", "dim").agg(fn("value").alias("p"), F.count(F.lit(1)).alias("_k"))
        pooled = met(pooled, indeg, "node")
        if agg == "mean":
            pv = F.col("p") / F.col("_deg")
        elif agg == "max":
            pv = F.when(F.col("_k") < F.col("_deg"), F.greatest(F.col("p"), F.lit(0.0))).otherwise(F.col("p"))
        else:
            pv = F.col("p")
        if n_dims is None:
            pooled = attach_scalars(pooled, d)
            shift = F.col("_d")
        else:
            shift = F.lit(n_dims)
        neigh = pooled.select("node", (F.col("dim") + shift).alias("dim"), pv.alias("value"))
        x = x.unionByName(neigh).filter(F.col("value") != 0.0)
        if n_dims is not None:
            n_dims *= 2
    return x


def hetero_propagate(nodes: DataFrame, edges: DataFrame | Sequence[Links], features: DataFrame,
                     edge_types: Sequence[str] | None = None) -> DataFrame:
    """Per-edge-type GCN propagation, summed per destination node and dim.  ``edges`` are rows of all
    types, or one ``Links`` for each type."""
    types = list(edge_types) if edge_types else None
    if types is None:
        raise ValueError("edge_types must be given (they are a plan parameter, not data)")
    if isinstance(edges, DataFrame):
        of_type = {t: edges.filter(F.col("edge_type") == t) for t in types}
    else:
        of_type = {x.edge_type: x for x in edges}
    outs = [gcn_propagate(nodes, of_type[t], features) for t in types]
    u = outs[0]
    for o in outs[1:]:
        u = u.unionByName(o)
    return u.groupBy("node", "dim").agg(F.sum("value").alias("value"))


def shared_key_propagate(inc: DataFrame, features: DataFrame) -> DataFrame:
    """Edge-free ``n_shared``-weighted neighbour sum:
    ``sum_j n_shared(i,j) x_j = sum_{k in K(i)} (S_k - x_i)`` with ``S_k`` the
    feature sum of key ``k`` — two aggregations, no pair ever materialised.
    Equals G7's message sum only for ``n_shared`` weights, not 0/1 edges."""
    i = inc.select("node", "key").distinct()
    xf = features.select("node", "dim", F.col("value").cast("double").alias("value"))
    # a table of its own, so that the join below is of plain shuffles that Spark may split at a hot key
    sk = cut_lineage(i.join(xf, "node").groupBy("key", "dim").agg(F.sum("value").alias("S")))
    kcount = i.groupBy("node").agg(F.count(F.lit(1)).alias("_nk"))
    tot = i.join(sk, "key").groupBy("node", "dim").agg(F.sum("S").alias("_t"))
    own = xf.join(kcount, "node").select("node", "dim", (F.col("value") * F.col("_nk")).alias("_o"))
    return (tot.join(own, ["node", "dim"], "left")
            .select("node", "dim", (F.col("_t") - F.coalesce("_o", F.lit(0.0))).alias("value"))
            .filter(F.col("value") != 0.0))


def normalise_rows(vec) -> Column:
    """Row-L1 normalisation (features scaled to sum 1); zero rows unchanged."""
    from corpusloom.functions.scores import bind_sum
    v = F.col(vec) if isinstance(vec, str) else vec
    # the row sum is bound once (not recomputed inside the per-element lambda)
    return bind_sum(v, lambda s: F.when(s != 0, F.transform(v, lambda x: x / s)).otherwise(v))


def split_edges(edges: DataFrame | Links, val: float = 0.05, test: float = 0.10, seed: int = 42) -> DataFrame:
    """Link-level split per edge type on undirected pairs (mirror rows stay
    together): first ``E - floor(val E) - floor(test E)`` pairs of the seeded
    hash order train, then val, then test.  Pairs of ``Links`` are compared with the first val and the
    first test pair of that order, so none is shuffled."""
    if isinstance(edges, Links):
        return _split_links(edges, val, test, seed)
    und = edges.select("edge_type", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    r = hash_rank(und, seeded_hash(seed, "edge_type", "a", "b"), by=["edge_type"], tiebreak=["a", "b"],
                  rank_col="_r", size_col="_E")
    nv = F.floor(F.col("_E") * val)
    nt = F.floor(F.col("_E") * test)
    ntrain = F.col("_E") - nv - nt
    r = r.withColumn("split", F.when(F.col("_r") < ntrain, "train")
                     .when(F.col("_r") < ntrain + nv, "val").otherwise("test"))
    e = edges.select("edge_type", "src", "dst", F.least("src", "dst").alias("a"),
                     F.greatest("src", "dst").alias("b"))
    return (e.join(r.select("edge_type", "a", "b", "split"), ["edge_type", "a", "b"])
            .select("edge_type", "src", "dst", "split"))


def _split_links(edges: Links, val: float, test: float, seed: int) -> DataFrame:
    und = edges.pairs().select(F.lit(edges.edge_type).alias("edge_type"), F.col("src").alias("a"), F.col("dst").alias("b"))
    und = und.withColumn("_h", seeded_hash(seed, "edge_type", "a", "b")).withColumn("_s", F.shiftright(hash32(F.col("_h")), 16))
    # 2^16 sub-buckets of the order at most; only the two that hold a cut are ranked
    sub = stage_table(und.groupBy("_s").agg(F.count(F.lit(1)).alias("_c")), "edge-buckets")
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    size = sub.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_E"))
    cuts = attach_scalars(sub.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))), size)
    nv, nt = F.floor(F.col("_E") * val), F.floor(F.col("_E") * test)
    cuts = cuts.select("_s", "_off", "_c", (F.col("_E") - nv - nt).alias("_v"), (F.col("_E") - nt).alias("_t"))
    holds = lambda r: (F.col("_off") <= F.col(r)) & (F.col(r) < F.col("_off") + F.col("_c"))
    near = und.join(F.broadcast(cuts.where(holds("_v") | holds("_t"))), "_s")
    rank = F.col("_off") + F.row_number().over(Window.partitionBy("_s").orderBy("_h", "a", "b")) - 1
    at = F.struct("_h", "a", "b")
    near = near.withColumn("_r", rank).agg(F.min(F.when(F.col("_r") == F.col("_v"), at)).alias("_first_val"),
                                           F.min(F.when(F.col("_r") == F.col("_t"), at)).alias("_first_test"))
    x = attach_scalars(und, stage_table(near, "edge-cuts"))
    x = x.withColumn("split", F.when(at >= F.col("_first_test"), "test").when(at >= F.col("_first_val"), "val").otherwise("train"))
    return x.select("edge_type", F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                                                  F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))), "split")


def link_views(splits: DataFrame) -> DataFrame:
    """What a link predictor sees in each stage, from the rows of ``split_edges``: ``(view, role,
    edge_type, src, dst)``.  Edges of role ``message`` carry messages, those of role
    ``supervision`` are to be predicted (label 1): training passes messages along train edges and
    predicts them, validation passes along train edges and predicts val edges, testing passes along
    train and val edges and predicts test edges.  One pass, no join."""
    def rows(*pairs: tuple[str, str]) -> Column:
        return F.array(*[F.struct(F.lit(v).alias("view"), F.lit(r).alias("role")) for v, r in pairs])

    seen = (F.when(F.col("split") == "train", rows(("train", "message"), ("train", "supervision"), ("val", "message"), ("test", "message")))
            .when(F.col("split") == "val", rows(("val", "supervision"), ("test", "message")))
            .otherwise(rows(("test", "supervision"))))
    return splits.select(F.inline(seen), "edge_type", "src", "dst")
