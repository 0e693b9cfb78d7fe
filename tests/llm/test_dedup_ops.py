"""Line dedup, SimHash groups and mixing against plain Python and DuckDB."""

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from corpusloom.llm import line_dedup, mixing, queries, simhash
from corpusloom.llm import sql as S
from corpusloom.llm.common import connected_components
from corpusloom.sources.tables import TABLES
from pyspark.sql import functions as F
from tools.check_oracle import digest

from . import cases


@pytest.mark.parametrize("name", sorted(S.ORACLES))
def test_oracle_matches(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    got = queries.queries()[name](spark, "/root/testdata/sf0.001")
    cur = con.execute(S.ORACLES[name])
    assert sorted(got.columns) == sorted(d[0] for d in cur.description)
    assert digest(got.columns, [tuple(r) for r in got.collect()])[0] == digest([d[0] for d in cur.description], cur.fetchall())[0]


def brute_lines(rows):
    docs, kept = defaultdict(set), []
    for doc_id, text in rows:
        for k in line_dedup.line_keys(text, 40):
            if k is not None:
                docs[k].add(doc_id)
    least = float("-inf")
    drop = {k: max(ids, key=lambda i: least if i is None else i) for k, ids in docs.items() if len(ids) >= 5}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        keys = line_dedup.line_keys(text, 40)
        left = [x for x, k in zip(lines, keys, strict=True) if k not in drop or drop[k] == doc_id]
        kept.append((str(doc_id), "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(kept)


@pytest.mark.parametrize("bits", [line_dedup.MAX_FILTER_BITS, 1 << 4])
def test_line_dedup_matches_brute_force(spark, bits):
    """Also with filters far too small: the result does not depend on them."""
    rows = [(r[0], r[1]) for r in cases.rows()]
    rows += [(100 + i, "x" * 39 + "\n" + "y" * 40 + "\n" + "é" * 40 + "\n" + "ü" * 25) for i in range(7)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string").repartition(5)
    got = line_dedup.drop_lines(df, max_filter_bits=max(bits, 1 << 16))
    assert sorted((str(r.row.doc_id), r.text or "", r.n_lines, r.n_dropped) for r in got.collect()) == brute_lines(rows)


def test_line_dedup_merges_filters_in_levels(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FAN_IN", 2)
    line = "a passage of more than forty characters in all"
    df = spark.createDataFrame([(i, f"{line}\nown {i}") for i in range(9)], "doc_id long, text string").repartition(9)
    got = {r.row.doc_id: r.n_dropped for r in line_dedup.drop_lines(df).collect()}
    assert got == {i: int(i < 8) for i in range(9)}


def test_only_documents_that_lose_lines_are_joined(spark):
    line = "a passage of more than forty characters in all"
    df = spark.createDataFrame([(i, f"{line}\nown {i}" if i < 9 else f"clean {i}") for i in range(4000)], "doc_id long, text string")
    lost = line_dedup.repeated_lines(df)
    may = line_dedup._id_filter(lost.select("doc_id"), line_dedup.MAX_FILTER_BITS)
    hit = {r.doc_id for r in df.where(may(F.xxhash64("doc_id"))).collect()}
    assert set(range(8)) <= hit and len(hit) < 20
    none = line_dedup._id_filter(lost.select("doc_id").limit(0), line_dedup.MAX_FILTER_BITS)
    assert df.where(none(F.xxhash64("doc_id"))).count() == 0


def test_golay_code_is_perfect_and_keys_are_shared():
    words = np.random.default_rng(1).integers(0, 1 << 23, 300)
    low, high, errors = simhash._golay()
    assert len(set(errors.tolist())) == 2048 and max(int(e).bit_count() for e in errors) == 3
    assert {len(set(k[k >= 0].tolist())) for k in simhash.golay_keys(words)} <= {1, 6}
    for i in range(23):
        for j in range(i, 23):
            near = words ^ (1 << i) ^ (1 << j if j > i else 0)
            a, b = simhash.golay_keys(words), simhash.golay_keys(near)
            assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a.tolist() and a, b, strict=True))


def brute_components(prints, distance=3):
    """The least fingerprint that each one hangs together with."""
    prints = np.array(sorted(prints), np.int64)
    label = np.arange(len(prints))
    near = np.bitwise_count((prints[:, None] ^ prints[None, :]).view(np.uint64)) <= distance
    while True:
        least = np.where(near, label[None, :], len(prints)).min(axis=1)
        if (least == label).all():
            return dict(zip(prints.tolist(), prints[label].tolist(), strict=True))
        label = least


def flipped(rng, x, d):
    for b in rng.sample(range(64), d):
        x ^= 1 << b
    return x


def clouds(rng):
    out = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        out |= {x} | {flipped(rng, x, d) for d in (1, 2, 3, 3, 3, 4)}
    return out


def chains(rng):
    out = set()
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(80):
            x = flipped(rng, x, 3)
            out.add(x)
    return out


def dense_ball(rng):
    """Many near fingerprints around a few centres that lie just too far apart."""
    x = rng.getrandbits(64)
    centres = [x, x ^ 0xF, x ^ (0x1F << 40), flipped(rng, x, 9)]
    return {flipped(rng, c, rng.choice((0, 1, 1, 2))) for c in centres for _ in range(250)}


def apart_in_one_key(rng):
    """Fingerprints that share a block and a segment but lie apart in the other one."""
    x = rng.getrandbits(40) << 24
    return {x | rng.getrandbits(24) for _ in range(500)}


@pytest.mark.parametrize("max_group", [simhash.MAX_GROUP, 16])
@pytest.mark.parametrize("kind", [clouds, chains, dense_ball, apart_in_one_key])
def test_connections_join_what_links_join(spark, kind, max_group):
    prints = {x - (1 << 64) if x >> 63 else x for x in kind(random.Random(3))}
    df = spark.createDataFrame([(x,) for x in prints], "fp long").repartition(3)
    edges = simhash.connections(df, max_group=max_group)
    got = {x: x for x in prints} | {r.node: r.root for r in connected_components(edges).collect()}
    assert got == brute_components(prints)


def test_connections_grow_with_the_rows(spark):
    """Twice the near fingerprints: about twice the edges."""
    rng = random.Random(5)
    ball = [x - (1 << 64) if x >> 63 else x for x in dense_ball(rng)]
    some, more = (simhash.connections(spark.createDataFrame([(x,) for x in part], "fp long")).count() for part in (ball[:300], ball[:600]))
    assert more < 2.5 * some


def slow_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_follow_the_contract(spark):
    texts = [r[1] for r in cases.rows() if len(r[1] or "") < 20000]
    texts += [" ".join(random.Random(i).choices(["A", "bÉ", "\u00a0x", "c\x1cd", "e"], k=i)) for i in range(40)]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_simhash_groups_of_awkward_rows(spark):
    df = cases.awkward(spark)
    got = simhash.components(df).collect()
    assert len(got) == len(cases.rows())
    prints = {r.fp % (1 << 64) for r in got}
    assert prints == {simhash.fingerprint(r[1]) for r in cases.rows()}
    group = {}
    for r in got:
        group.setdefault(r.root, []).append(r)
    for rs in group.values():
        ids = [r.doc_id for r in rs if r.doc_id is not None]
        assert {r.component_id for r in rs} == {min(ids) if ids else None}
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns and kept.count() == len(group)
    want = {rs[0].root: rs[0].component_id for rs in group.values()}
    roots = {r.fp % (1 << 64): r.root for r in got}
    assert {roots[simhash.fingerprint(r.text)]: r.doc_id for r in kept.collect()} == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


@pytest.mark.parametrize("n", [1000, 3000])
def test_components_of_chains_in_random_order(spark, n):
    rng, links, want = random.Random(n), [], {}
    for first in (0, n):  # two chains
        ids = list(range(first, first + n))
        rng.shuffle(ids)
        links += zip(ids, ids[1:], strict=False)
        want |= dict.fromkeys(ids, first)
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == 2 * n and {r.node: r.root for r in got} == want


def test_mix_targets_and_copies(spark):
    rows = [(i, "w " * (i % 50 + 1), f"s{i % 7}") for i in range(3000)] + [(5000 + i, "big " * 100, "hot") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(df).toPandas()
    assert (plan.copies <= 2).all() and (plan.target <= 2 * plan.source_size).all()
    total = plan.drop_duplicates("source_size").target.sum()
    assert total == pytest.approx(1.5 * plan["size"].sum())
    taken = (plan["size"] * plan.copies).groupby(plan.source_size).sum()
    want = plan.groupby("source_size").target.first()
    assert (abs(taken - want) < 0.15 * want).all()
    assert plan.equals(mixing.mix_plan(df).toPandas()) or (
        plan.sort_values("doc_id").copies.tolist() == mixing.mix_plan(df).toPandas().sort_values("doc_id").copies.tolist())
    assert mixing.mix(df).count() == plan.copies.sum()


def test_mix_awkward_salted_and_empty(spark, monkeypatch):
    df = cases.awkward(spark)
    plan = sorted((str(r.doc_id), r["size"], r.copies) for r in mixing.mix_plan(df).collect())
    assert len(plan) == len(cases.rows())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((str(r.doc_id), r["size"], r.copies) for r in mixing.mix_plan(df).collect()) == plan
    out = mixing.mix(df)
    assert out.columns == df.columns and out.count() == sum(c for *_, c in plan)
    none = cases.empty(spark)
    assert mixing.mix(none).count() == 0 and mixing.mix_plan(none).count() == 0
    assert line_dedup.drop_lines(none).count() == 0 and simhash.drop_near_copies(none).count() == 0
    assert line_dedup.drop_lines(df).count() == len(cases.rows())
