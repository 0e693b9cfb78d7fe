"""Co-occurrence graphs in cells against brute force and against the operators on edge rows."""

import random
from collections import defaultdict

import pytest

from corpusloom.operators import graph as g
from corpusloom.operators import links as lk


def _rows(seed, n=60):
    rnd = random.Random(seed)
    return [(i * 1000003, rnd.choice(["hot", "k1", "k2", "k3", f"own{i}"])) for i in range(n) for _ in range(rnd.randint(0, 4))]


def _brute(rows):
    keys = defaultdict(set)
    for n, k in rows:
        keys[n].add(k)
    return {(a, b): len(keys[a] & keys[b]) for a in keys for b in keys if a < b and keys[a] & keys[b]}


@pytest.mark.parametrize("seed,block,chunk", [(1, 7, 5), (2, 40, 64), (3, 1 << 18, 1 << 21)])
def test_pairs_and_received_match_brute_force(spark, monkeypatch, seed, block, chunk):
    rows = _rows(seed)
    monkeypatch.setattr(lk, "CHUNK", chunk)  # of the driver: more cells for the same pairs
    graph = lk.links(spark.createDataFrame(rows + rows[:9], "node long, key string"), "t", block)
    want = _brute(rows)
    assert graph.blocks > 1 or block > 100
    got = graph.pairs().collect()
    assert len(got) == len(want) and {(r.src, r.dst): r.n_shared for r in got} == want
    both = {**want, **{(b, a): n for (a, b), n in want.items()}}
    got = graph.edges().collect()
    assert len(got) == len(both) and {(r.src, r.dst): r.n_shared for r in got} == both
    x = [(n, d, float(n % 7) - 3) for n in range(0, 60 * 1000003, 1000003) for d in (2, 5) if (n + d) % 3]
    x.append((77, 2, 1.0))  # a node of no key
    sums = defaultdict(list)
    for a, b in both:
        for n, d, v in x:
            if n == a:
                sums[b, d].append(v)
    got = graph.received(spark.createDataFrame(x, "node long, dim int, value double"), most=True).collect()
    assert {(r.node, r.dim): (r.s, r.k, r.m) for r in got} == {k: (pytest.approx(sum(v)), len(v), max(v)) for k, v in sums.items()}
    assert {r.node: r.degree for r in graph.degrees().collect()} == {n: sum(n == b for _, b in both) for n in {b for _, b in both}}


def test_chunks_of_a_cell(monkeypatch):
    """A cell is made chunk by chunk: no pair is lost or doubled at a border."""
    import numpy as np
    rows = sorted(set(_rows(4)))
    name = {k: i for i, k in enumerate({k for _, k in rows})}
    c = {"cell": np.zeros(len(rows), "int64"), "side": np.zeros(len(rows), "int32"),
         "node": np.array([n for n, _ in rows]), "k": np.array([name[k] for _, k in rows])}
    for chunk in (1, 3, 50, 10**6):
        monkeypatch.setattr(lk, "CHUNK", chunk)
        cell = lk._Cell(c, 1)
        got = [(int(cell.a[i]), int(cell.b[j]), int(n)) for a, b, m in cell.chunks() for i, j, n in zip(a, b, m)]
        assert len(got) == len(set(got)) and {(a, b): n for a, b, n in got} == _brute(rows)


def test_operators_agree_on_links_and_rows(spark):
    rows = _rows(5)
    graph = lk.links(spark.createDataFrame(rows, "node long, key string"), "t", 11)
    edges = graph.edges()
    ids = sorted({n for n, _ in rows} | {5})
    nodes = spark.createDataFrame([(i, i % 3) for i in ids], "node long, y int")
    feats = spark.createDataFrame([(i, i % 4, 1.0 + i % 2) for i in ids], "node long, dim int, value double")

    def values(df):
        return {(r.node, r.dim): pytest.approx(r.value) for r in df.collect()}

    assert values(g.gcn_propagate(nodes, graph, feats, 2)) == values(g.gcn_propagate(nodes, edges, feats, 2))
    for agg in ("mean", "max", "sum"):
        assert values(g.sage_aggregate(nodes, graph, feats, agg, 2)) == values(g.sage_aggregate(nodes, edges, feats, agg, 2))
    assert values(g.hetero_propagate(nodes, [graph], feats, ["t"])) == values(g.hetero_propagate(nodes, edges, feats, ["t"]))
    assert g.graph_profile(nodes, graph).collect() == g.graph_profile(nodes, edges).collect()
    for val, test in ((0.05, 0.1), (0.0, 0.3), (0.2, 0.0), (0.0, 0.0)):
        one, other = (sorted(map(tuple, g.split_edges(e, val, test, 1).collect())) for e in (graph, edges))
        assert one == other


def test_no_pair_is_shuffled(spark):
    """The plans of edges and messages end in the step that finds the pairs: the only shuffles are of
    incidence rows and of sums by node, and a graph without rows works."""
    graph = lk.links(spark.createDataFrame(_rows(6), "node long, key string"), "t", 20)
    plan = graph.edges()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    none = lk.links(spark.createDataFrame([], "node long, key string"), "t")
    assert none.edges().count() == 0 and none.degrees().count() == 0
    assert g.split_edges(none).count() == 0


def test_category_pair_edges_shuffles_no_pairs(spark):
    import re

    from corpusloom.plans import graph_queries as q
    plan = q.category_pair_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(src_category#" in plan and not re.search(r"hashpartitioning\(src#", plan)


def _wide_rows(seed, n=40, keys=9, most=6):
    rnd = random.Random(seed)
    return [(i * 1000003, f"k{k}") for i in range(n) for k in rnd.sample(range(keys), rnd.randint(0, most))]


@pytest.mark.parametrize("subset_keys,subsets", [(12, 127), (3, 1), (0, 0)])
def test_received_of_wide_nodes(spark, monkeypatch, subset_keys, subsets):
    """Sums by subsets, in pairs where a node has too many keys, and both side by side are those of brute force."""
    monkeypatch.setattr(lk, "SUBSET_KEYS", subset_keys)
    monkeypatch.setattr(lk, "SUBSETS", subsets)
    rows = _wide_rows(7)
    graph = lk.links(spark.createDataFrame(rows, "node long, key string"), "t", 30)
    wide = graph.sets.where("wide").count()
    assert graph.any_wide == (wide > 0) == (subset_keys < 12) and (subset_keys != 3 or wide < graph.sets.count())
    x = {(i * 1000003, d): float((i * 7 + d) % 5) - 2 for i in range(40) for d in (0, 3) if (i + d) % 4}
    sums = defaultdict(list)
    for a, b in _brute(rows):
        for to, of in ((a, b), (b, a)):
            for d in (0, 3):
                if (of, d) in x:
                    sums[to, d].append(x[of, d])
    feats = spark.createDataFrame([(n, d, v) for (n, d), v in x.items()], "node long, dim int, value double")
    got = graph.received(feats, most=True)
    assert {(r.node, r.dim): (r.s, r.k, r.m) for r in got.collect()} == {k: (pytest.approx(sum(v)), len(v), max(v)) for k, v in sums.items()}
    assert ("MapInArrow" in got._jdf.queryExecution().executedPlan().toString()) == (wide > 0)


def test_incidence_rows_are_sent_once(spark, monkeypatch):
    """Shuffled rows are one for each node and key, whatever the number of blocks; only rows of a hot key are sent more than once."""
    rows = _wide_rows(8)
    n_rows = len({r for r in rows})

    def sent(graph):
        plan = graph.pairs()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(k#" in plan
        return graph, {(r.src, r.dst): r.n_shared for r in graph.pairs().collect()}

    assert lk.links(spark.createDataFrame(rows, "node long, key string"), "t", 3).inc.count() == n_rows
    for key_rows in (1, 4, 1 << 13):
        monkeypatch.setattr(lk, "KEY_ROWS", key_rows)
        graph, found = sent(lk.links(spark.createDataFrame(rows, "node long, key string"), "t", 3))
        assert graph.blocks > 1 and found == _brute(rows)


@pytest.mark.parametrize("chunk", [1, 3, 50, 10**6])
def test_pairs_of_a_key_in_chunks(monkeypatch, chunk):
    """Keys and their blocks that are cut by batches and made chunk by chunk lose and double no pair."""
    import pyarrow as pa
    monkeypatch.setattr(lk, "CHUNK", chunk)
    rows = sorted(set(_wide_rows(9)))
    number = {k: i for i, k in enumerate(sorted({k for _, k in rows}))}
    keys = defaultdict(list)
    for node, k in rows:
        keys[node].append(number[k])
    for blocks in (1, 3):
        sent = []
        for node, k in rows:
            u = node % blocks
            sent += [{"node": node, "k": number[k], "keys": sorted(keys[node]), "p": min(u, v), "q": max(u, v), "side": int(u > v)} for v in range(blocks)]
        sent.sort(key=lambda r: (r["k"], r["p"], r["q"], r["side"], r["node"]))
        for size in (1, 7, 1000):
            batches = [pa.RecordBatch.from_pylist(sent[i:i + size]) for i in range(0, len(sent), size)]
            got = [(*r.values(),) for b in lk._pair_rows(iter(batches)) for r in b.to_pylist()]
            assert len(got) == len({r[:2] for r in got}) and {(a, b): n for a, b, n in got} == _brute(rows)
