"""Tag spans, twin quotients, link views, automatic bins, density curves and exact shares."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph as g
from corpusloom.operators import keyphrases as kp
from corpusloom.operators import metrics as mt
from corpusloom.operators import ranking as rk
from corpusloom.operators import sampling as sm
from corpusloom.operators import twins as tw
from corpusloom.operators.spans import merge_spans


def plain_spans(tokens):
    out = []
    for pos, token, tag, score in tokens:
        tag = tag or "O"
        kind = tag[2:] if tag[:2] in ("B-", "I-") else tag
        if out and out[-1][0] == kind and not tag.startswith("B-"):
            out[-1][1].append((pos, token, score))
        else:
            out.append((kind, [(pos, token, score)]))
    return [(k, ts[0][0], ts[-1][0], "".join(t for _, t, _ in ts).replace("Ġ", " ").strip(" "), len(ts),
             round(sum(s for *_, s in ts) / len(ts), 9)) for k, ts in out if k != "O"]


def test_spans_match_plain_loop(spark):
    rng, rows = random.Random(2), []
    for text in (*range(30), None):
        for pos in range(rng.randint(0, 25)):
            rows.append((text, pos, rng.choice(["Ġnew", "ton", "Ġ", "", "Ġcotton"]), rng.choice(["B-KEY", "I-KEY", "O", "I-LOC", None]), rng.random()))
    df = spark.createDataFrame([(*r, "x") for r in rows], "id int, pos int, token string, tag string, score double, phrase string").repartition(4)
    got = defaultdict(list)
    for r in merge_spans(df).collect():
        got[r.id].append((r.tag, r.first, r.last, r.phrase, r.n_tokens, round(r.score, 9)))
    want = {t: sorted(plain_spans([r[1:] for r in rows if r[0] == t])) for t in {r[0] for r in rows}}
    assert {t: sorted(v) for t, v in got.items()} == {t: v for t, v in want.items() if v}
    assert merge_spans(df.limit(0)).count() == 0


def test_tagger_behind_the_keyphrase_job(spark):
    df = spark.createDataFrame([(1, "Cotton yarn of cotton yarn"), (2, ""), (3, None)], "id int, text string")

    def tagger(texts):
        return [[("Ġ" + w, "O" if w == "of" else ("B-KEY" if i == 0 or ws[i - 1] == "of" else "I-KEY"), 1.0) for i, w in enumerate(ws)]
                for ws in (t.split() for t in texts)]

    got = {r.id: (r.phrases, r.keyphrases) for r in kp.tagged_keyphrases(df, "id", "text", tagger).collect()}
    assert got == {1: (["Cotton yarn", "cotton yarn"], "cotton yarn|cotton yarn"), 2: ([], ""), 3: ([], "")}


def random_incidence(seed, n=60):
    rng = random.Random(seed)
    rows = [(i, k) for i in range(n) for k in (rng.choice([[""], ["a"], ["a", "b"], ["b", "c"], [f"own{i}"], ["", "a"], []]))]
    return rows + rows[:5]


@pytest.mark.parametrize("seed", [1, 2])
def test_quotient_equals_the_pair_form(spark, seed):
    rows = random_incidence(seed)
    inc = spark.createDataFrame(rows, "node long, key string")
    graph = tw.twin_graph(inc, block_rows=7)
    sets = defaultdict(set)
    for n, k in rows:
        sets[n].add(k)
    members = {r.node: r.cls for r in graph.members.collect()}
    assert members == {n: min(m for m in sets if sets[m] == sets[n]) for n in sets}
    pairs = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a != b and sets[a] & sets[b]}
    assert {(r.src, r.dst): r.n_shared for r in graph.node_edges().collect()} == pairs
    degree = {r.cls: r.degree for r in tw.class_degrees(graph).collect()}
    assert {n: degree[members[n]] for n in sets} == {n: sum(a == n for a, _ in pairs) for n in sets}
    feats = [(n, n % 3, 1.0 + n) for n in sets] + [(n, 3, 0.5) for n in list(sets)[::4]]
    x = spark.createDataFrame(feats, "node long, dim int, value double")
    nodes = spark.createDataFrame([(n,) for n in sets], "node long")
    edges = spark.createDataFrame([("e", a, b) for a, b in pairs], "edge_type string, src long, dst long")
    for hops in (1, 3):
        want = {(r.node, r.dim): r.value for r in g.gcn_propagate(nodes, edges, x, hops).collect()}
        got = {(r.node, r.dim): r.value for r in tw.to_nodes(graph, tw.twin_propagate(graph, x, hops)).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    # a node without a key of one type keeps its own features for it
    all_nodes = spark.createDataFrame([(n,) for n in [*sets, 999]], "node long")
    both = x.unionByName(spark.createDataFrame([(999, 0, 2.0)], "node long, dim int, value double"))
    want = {(r.node, r.dim): r.value for r in g.hetero_propagate(all_nodes, edges, both, ["e"]).collect()}
    got = {(r.node, r.dim): r.value for r in tw.twin_hetero_propagate([graph], both).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_quotient_of_one_key_set_is_linear(spark):
    inc = spark.range(5000).select(F.col("id").alias("node"), F.lit("").alias("key"))
    graph = tw.twin_graph(inc)
    assert graph.members.count() == 5000 and graph.classes.count() == 1 and graph.edges.count() == 0
    assert graph.classes.first()["size"] == 5000 and tw.class_degrees(graph).first().degree == 4999
    assert tw.twin_graph(inc.limit(0)).members.count() == 0


def test_link_views(spark):
    rows = [("e", i, i + 1, s) for i, s in enumerate(["train"] * 4 + ["val"] * 2 + ["test"])]
    got = defaultdict(set)
    for r in g.link_views(spark.createDataFrame(rows, "edge_type string, src int, dst int, split string")).collect():
        got[r.view, r.role].add(r.src)
    train, val, test = {0, 1, 2, 3}, {4, 5}, {6}
    assert got == {("train", "message"): train, ("train", "supervision"): train, ("val", "message"): train,
                   ("val", "supervision"): val, ("test", "message"): train | val, ("test", "supervision"): test}


def test_exact_quantiles_and_bins(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.gamma(2, 1, 501), 2)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(7)
    got = mt.exact_quantiles(df, "v", (0.0, 0.25, 0.5, 0.9, 1.0)).first()
    assert np.allclose(list(got), np.quantile(values, (0.0, 0.25, 0.5, 0.9, 1.0)))
    bins = mt.automatic_bins(df, "v").first()
    edges = np.histogram_bin_edges(values, "auto")
    assert bins.n_bins == len(edges) - 1 and bins.lo == edges[0] and bins.width == pytest.approx(edges[1] - edges[0])
    same = mt.automatic_bins(spark.createDataFrame([(2.0,)] * 5, "v double"), "v").first()
    assert (same.lo, same.width, same.n_bins) == (2.0, 0.0, 1)
    assert mt.automatic_bins(df.limit(0), "v").count() == 0
    h = mt.automatic_histogram(df.withColumn("g", F.col("v") > 1).where(~F.isnan("v")), "v", "g").collect()
    assert sum(r.n for r in h) == 501
    for group in (True, False):
        assert sum(r.density for r in h if r.g == group) * bins.width == pytest.approx(1)


def test_density_equals_direct_evaluation(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(0.4, 0.1, 700), "b": np.concatenate([rng.normal(0.1, 0.01, 90), rng.normal(0.95, 0.02, 60)]), None: rng.uniform(0, 1, 30)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("one", 0.5), ("same", 0.2), ("same", 0.2), ("a", None)]
    got = defaultdict(dict)
    for r in mt.density_curve(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", "g").collect():
        got[r.g][r.point] = (r.x, r.density)
    everything = np.concatenate(list(groups.values()))
    x = np.linspace(everything.min(), everything.max(), 200)
    assert set(got) == {"a", "b", None}
    for k, v in groups.items():
        h = v.std(ddof=1) * len(v) ** -0.2
        want = np.exp(-((x[:, None] - v) / h) ** 2 / 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
        assert np.allclose([got[k][i][0] for i in range(200)], x)
        assert np.abs(np.array([got[k][i][1] for i in range(200)]) - want).max() < 1e-8


@pytest.mark.parametrize("seed", range(3))
def test_shares_are_exact(spark, seed):
    rng = random.Random(seed)
    sizes = {lab: rng.randint(1, 40) for lab in "abcdefg"} | {None: 3}
    df = spark.createDataFrame([(f"{k}{i}", k) for k, n in sizes.items() for i in range(n)], "lens_id string, category string").repartition(5)
    total, got = sum(sizes.values()), {r.category: r.n_test for r in sm.apportion(sm.class_sizes(df), 0.2).collect()}
    assert sum(got.values()) == int(np.ceil(total * 0.2))
    train = total - sum(got.values())
    assert all(int(n * train / total) <= n - got[k] <= int(n * train / total) + 1 for k, n in sizes.items())
    split = sm.stratified_split(df, "category", 0.2).collect()
    assert len(split) == total
    assert {k: sum(r.is_test for r in split if r.category == k) for k in sizes} == got


def test_undersampling_keeps_rows_without_a_label(spark):
    rows = [(f"m{i}", "en") for i in range(30)] + [(f"n{i}", None) for i in range(5)] + [(f"f{i}", "fr") for i in range(4)]
    got = sm.undersample_majority(spark.createDataFrame(rows, "lens_id string, category string"), "en", ["fr"]).collect()
    assert sorted(str(r.category) for r in got) == ["None"] * 5 + ["en"] * 4 + ["fr"] * 4


@pytest.mark.parametrize("group_rows", [rk.GROUP_ROWS, 8])
def test_copy_rank_equals_a_window(spark, group_rows):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 9 + [f"id{i}" for i in range(20)] + [None]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, draw int").repartition(6)
    got = rk.copy_rank(df, rk.seeded_hash(42, "draw"), "id", ["draw"], "k", group_rows).collect()
    want = rk.hash_rank(df, rk.seeded_hash(42, "draw"), ["id"], ["draw"], "k").collect()
    key = lambda r: (str(r.id), r.draw, r.k)
    assert len(got) == 600 and sorted(map(key, got)) == sorted(map(key, want))
