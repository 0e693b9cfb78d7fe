"""J1, U4, G1-G9 against brute force on small literal graphs (the block split
of hot keys is forced with a tiny ``block_rows``)."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph as g


def _incidence(seed, n_nodes=40, n_keys=6, hot=0.5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n_nodes):
        for _ in range(rnd.randint(0, 4)):
            k = "hot" if rnd.random() < hot else f"k{rnd.randrange(n_keys)}"
            rows.append((f"n{i:03d}", k))
    return rows


def _brute_pairs(rows):
    by = defaultdict(set)
    for n, k in rows:
        by[k].add(n)
    out = defaultdict(int)
    for k, ns in by.items():
        for a, b in itertools.combinations(sorted(ns), 2):
            out[(a, b)] += 1
    return out


@pytest.mark.parametrize("seed,block", [(1, 3), (2, 5), (3, 2048)])
def test_cooccurrence_matches_brute_force(spark, seed, block):
    rows = _incidence(seed)
    inc = spark.createDataFrame(rows, "node string, key string")
    got = {(r.src, r.dst): r.n_shared for r in
           g.cooccurrence_edges(inc, "t", directed=False, block_rows=block).collect()}
    assert got == dict(_brute_pairs(rows))


def test_hot_key_third_of_rows_is_spread(spark):
    """One key holds a third of all incidence rows: its pairs come from many
    block cells and land in many partitions, and the count is exact."""
    rows = [(f"h{i:04d}", "hot") for i in range(600)] + \
           [(f"c{i:04d}", f"k{i % 300}") for i in range(1200)]
    inc = spark.createDataFrame(rows, "node string, key string")
    pairs = g.cooccurrence_pairs(inc, block_rows=64)
    per_part = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(per_part) == 600 * 599 // 2 + 300 * (4 * 3 // 2)
    assert len(per_part) >= 4 and max(per_part) < 0.5 * sum(per_part)


def test_directed_edges_symmetric_and_self_loops(spark):
    rows = [("a", "x"), ("a", "x"), ("b", "x"), ("c", "y")]
    inc = spark.createDataFrame(rows, "node string, key string")
    e = {(r.src, r.dst) for r in g.cooccurrence_edges(inc, "t").collect()}
    assert e == {("a", "b"), ("b", "a")}
    e2 = {(r.src, r.dst) for r in g.cooccurrence_edges(inc, "t", drop_self=False).collect()}
    assert e2 == {("a", "b"), ("b", "a"), ("a", "a")}


def test_to_undirected_coalesces(spark):
    e = spark.createDataFrame([("s", 1, 2), ("s", 2, 1), ("s", 1, 3), ("c", 1, 0), ("c", 1, 0)],
                              "edge_type string, src long, dst long")
    u = g.to_undirected(e, bipartite_types=["c"]).collect()
    same = sorted((r.src, r.dst) for r in u if r.edge_type == "s")
    assert same == [(1, 2), (1, 3), (2, 1), (3, 1)]
    assert sorted((r.edge_type, r.src, r.dst) for r in u if r.edge_type != "s") == \
        [("c", 1, 0), ("c", 1, 0), ("rev_c", 0, 1), ("rev_c", 0, 1)]


def test_pair_count_and_shared_key_sum_without_pairs(spark):
    rows = _incidence(7, n_nodes=30)
    inc = spark.createDataFrame(rows, "node string, key string")
    grp = {f"n{i:03d}": f"g{i % 3}" for i in range(30)}
    groups = spark.createDataFrame(list(grp.items()), "node string, grp string")
    got = {(r.src_grp, r.dst_grp): r.n_pairs for r in g.pair_count_by_group(inc, groups).collect()}
    want = defaultdict(int)
    for (a, b), m in _brute_pairs(rows).items():
        want[(grp[a], grp[b])] += m
        want[(grp[b], grp[a])] += m
    assert got == dict(want)
    # n_shared-weighted neighbour sum with feature = node number
    feats = spark.createDataFrame([(n, 0, float(int(n[1:]))) for n in grp], "node string, dim int, value double")
    got = {r.node: r.value for r in g.shared_key_propagate(inc, feats).collect()}
    want = defaultdict(float)
    for (a, b), m in _brute_pairs(rows).items():
        want[a] += m * int(b[1:])
        want[b] += m * int(a[1:])
    assert {k: v for k, v in want.items() if v} == pytest.approx(got)


def test_gcn_matches_dense_formula(spark):
    n = 6
    und = [(0, 1), (1, 2), (2, 3), (0, 3), (4, 5)]
    edges = spark.createDataFrame([(a, b) for a, b in und] + [(b, a) for a, b in und], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
    x = np.arange(n * 2, dtype=float).reshape(n, 2)
    feats = spark.createDataFrame([(i, d, float(x[i, d])) for i in range(n) for d in range(2)],
                                  "node long, dim int, value double")
    a = np.eye(n)
    for s, t in und:
        a[s, t] = a[t, s] = 1
    dinv = np.diag(1 / np.sqrt(a.sum(1)))
    want = dinv @ a @ dinv @ (dinv @ a @ dinv @ x)
    got = np.zeros((n, 2))
    for r in g.gcn_propagate(nodes, edges, feats, hops=2).collect():
        got[r.node, r.dim] = r.value
    assert np.allclose(got, want)


def test_sage_mean_keeps_self_and_pools_neighbours(spark):
    edges = spark.createDataFrame([(0, 1), (2, 1)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(3)], "node long")
    feats = spark.createDataFrame([(0, 0, 2.0), (2, 0, 4.0), (1, 0, 1.0)], "node long, dim int, value double")
    got = {(r.node, r.dim): r.value for r in g.sage_aggregate(nodes, edges, feats, "mean").collect()}
    assert got == {(0, 0): 2.0, (1, 0): 1.0, (2, 0): 4.0, (1, 1): 3.0}


def test_build_nodes_multi_hot_and_last_label(spark):
    recs = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)],
                                 "lens_id string, category string, seq int")
    nodes, cats, feats = g.build_nodes(recs, seq_col="seq")
    cat = {r.category: r.cat for r in cats.collect()}
    nd = {r.lens_id: (r.node, r.y) for r in nodes.collect()}
    assert nd["a"][1] == cat["y"] and nd["b"][1] == cat["x"]       # last label wins
    hot = sorted(r.dim for r in feats.filter(F.col("node") == nd["a"][0]).collect())
    assert hot == sorted([cat["x"], cat["y"]])                        # multi-hot
    assert sorted(n for n, _ in nd.values()) == [0, 1]                # dense


def test_split_edges_keeps_mirrors_together(spark):
    und = [(i, j) for i in range(12) for j in range(i + 1, 12) if (i * j) % 3 == 0]
    e = spark.createDataFrame([("t", a, b) for a, b in und] + [("t", b, a) for a, b in und],
                              "edge_type string, src long, dst long")
    s = g.split_edges(e, 0.05, 0.10, seed=1).collect()
    per_pair = defaultdict(set)
    for r in s:
        per_pair[(min(r.src, r.dst), max(r.src, r.dst))].add(r.split)
    assert all(len(v) == 1 for v in per_pair.values())
    counts = defaultdict(int)
    for v in per_pair.values():
        counts[next(iter(v))] += 1
    n = len(und)
    assert counts["val"] == int(n * 0.05) and counts["test"] == int(n * 0.10)
