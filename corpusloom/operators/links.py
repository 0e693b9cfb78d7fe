"""Pairs of nodes that share a key, and what neighbours send, without a shuffle of pairs.

A node travels with its whole key set, so a pair is made under its smallest shared key only, where that key's
rows meet, and its number of shared keys is counted there: what is shuffled are the incidence rows.  A key of
more than ``KEY_ROWS`` rows is dealt into hash blocks, and every two blocks of it meet once.  Within a task pairs are made
a bounded chunk at a time, so neither a hot key nor a large graph is ever held as pairs.

Sums over neighbours (``received``) make no pairs at all: the nodes that share a key with one of key set K are
counted by inclusion and exclusion over the subsets of K, each having one sum over the nodes that hold it, so
work grows with the nodes.  A subset held by one node only adds nothing and is left out.  Nodes with so many keys that their
subsets outnumber their pairs (``wide``) are taken in pairs instead: nodes are dealt into ``blocks`` hash blocks,
and a cell is a pair of blocks that gets the rows of both; of a maximum, the two largest values of each key are enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.partitioning import default_parallelism
from corpusloom.session import met, stage_table

#: incidence rows of a block
LINK_ROWS = 1 << 18
#: pairs (counted once for each shared key) that a task makes at a time, and that a cell should not exceed
CHUNK = 1 << 21
CELL_PAIRS = 50_000_000
#: rows of a key that meet in one task
KEY_ROWS = 1 << 13
#: a node is wide if it has more keys than these, or more subsets than these and than pairs
SUBSET_KEYS = 12
SUBSETS = 127


@dataclass(frozen=True)
class Links:
    """The co-occurrence graph of ``sets(node, ks, wide)``: long ids, ``ks`` the node's sorted keys of two
    nodes or more, as ``(k, m)`` with the key's number of nodes."""

    edge_type: str
    sets: DataFrame
    blocks: int
    any_wide: bool

    @property
    def inc(self) -> DataFrame:
        """``(node, wide, k)``, distinct."""
        return self.sets.select("node", "wide", F.explode("ks.k").alias("k"))

    def pairs(self) -> DataFrame:
        """``(src, dst, n_shared)`` with ``src < dst``, one row for each pair."""
        rows = self.sets.select("node", F.col("ks.k").alias("keys"), F.inline("ks"))
        rows = rows.withColumn("b", F.ceil(F.col("m") / KEY_ROWS).cast("int"))
        rows = rows.withColumn("u", F.pmod(F.xxhash64("node"), F.col("b")).cast("int"))
        at = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda v: F.struct(
            F.least("u", v).alias("p"), F.greatest("u", v).alias("q"), F.when(F.col("u") > v, 1).otherwise(0).alias("side")))
        rows = rows.select("node", "k", "keys", F.inline(at))
        dealt = rows.repartition(default_parallelism(rows), "k", "p", "q").sortWithinPartitions("k", "p", "q", "side", "node")
        return dealt.mapInArrow(_pair_rows, "src long, dst long, n_shared long")

    def edges(self, directed: bool = True) -> DataFrame:
        """``(edge_type, src, dst, n_shared)``, both ways or with ``src < dst``."""
        rows = self.pairs()
        if directed:
            rows = rows.select(F.inline(F.array(F.struct("src", "dst", "n_shared"), F.struct(
                F.col("dst").alias("src"), F.col("src").alias("dst"), "n_shared"))))
        return rows.select(F.lit(self.edge_type).alias("edge_type"), "src", "dst", "n_shared")

    @cached_property
    def _subsets(self) -> DataFrame:
        """``(node, g, sign)``: the subsets of the key sets of nodes that are not wide, numbered (single keys by
        their own number); of the others only those that two nodes hold."""
        few = self.sets.where(~F.col("wide")).select("node", F.col("ks.k").alias("keys"))
        masks = F.sequence(F.lit(1), (F.pow(F.lit(2.0), F.size("keys")) - 1).cast("int"))
        at = few.select("node", "keys", F.explode(F.filter(masks, lambda b: F.bit_count(b) > 1)).alias("mask"))
        many = at.select("node", F.filter("keys", lambda _, i: F.getbit("mask", i) == 1).alias("held"),
                         (F.bit_count("mask") % 2 * 2 - 1).cast("long").alias("sign"))
        shared = many.groupBy("held").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        shared = stage_table(shared.select("held", (-1 - F.monotonically_increasing_id()).alias("g")), "link-subsets")
        one = few.select("node", F.explode("keys").alias("g"), F.lit(1).cast("long").alias("sign"))
        return stage_table(one.unionByName(met(many, shared, "held").select("node", "g", "sign")), "link-subset-rows")

    def received(self, features: DataFrame, most: bool = False) -> DataFrame:
        """``(node, dim, s, k, m)``: sum, number and (if ``most``) maximum of the values that a node's
        neighbours have in ``features(node, dim, value)``."""
        value = F.col("value").cast("double")
        x = stage_table(features.groupBy("node", F.col("dim").cast("long").alias("dim")).agg(
            F.sum(value).alias("s"), F.count(F.lit(1)).alias("k"), F.max(value).alias("m")), "link-features")
        # tables of their own, so that the joins that follow are of plain shuffles that Spark may split at a hot key
        held = met(self._subsets, x, "node").groupBy("g", "dim").agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
        held = stage_table(held, "link-sums")
        # a subset's sum has the node's own value in it, which is taken off as often as the subsets add it
        own = met(self._subsets.groupBy("node").agg(F.sum("sign").alias("w")), x, "node")
        none = F.lit(None).cast("double").alias("m")
        got = met(self._subsets, held, "g").select("node", "dim", (F.col("sign") * F.col("s")).alias("s"), (F.col("sign") * F.col("k")).alias("k"), none)
        got = got.unionByName(own.select("node", "dim", (-F.col("w") * F.col("s")).alias("s"), (-F.col("w") * F.col("k")).alias("k"), none))
        if self.any_wide:
            got = got.unionByName(self._received_in_cells(x))
        if most:
            got = got.unionByName(self._most(x).select("node", "dim", F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("k"), "m"))
        return got.groupBy("node", "dim").agg(F.sum("s").alias("s"), F.sum("k").alias("k"), F.max("m").alias("m")).where(F.col("k") > 0)

    def _most(self, x: DataFrame) -> DataFrame:
        """``(node, dim, m)``: maximum over the neighbours under each key."""
        first = Window.partitionBy("k", "dim").orderBy(F.desc("m"), "node")
        values = met(self.inc.select("node", "k"), x.select("node", "dim", "m"), "node")
        two = values.withColumn("r", F.row_number().over(first)).where(F.col("r") <= 2).groupBy("k", "dim").agg(
            F.max(F.when(F.col("r") == 1, F.col("node"))).alias("of"), F.max(F.when(F.col("r") == 1, F.col("m"))).alias("most"),
            F.max(F.when(F.col("r") == 2, F.col("m"))).alias("next"))
        two = stage_table(two, "link-most")
        m = F.when(F.col("node") == F.col("of"), F.col("next")).otherwise(F.col("most"))
        return met(self.inc.select("node", "k"), two, "k").select("node", "dim", m.alias("m"))

    def _cells(self, rows: DataFrame, side: int) -> DataFrame:
        """Every row in the cells of its node's block, on the first or the second side of the cell."""
        block = F.pmod(F.xxhash64("node"), F.lit(self.blocks)).cast("int")
        at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(self.blocks - 1)), lambda q: F.struct(
            (F.least(block, q).cast("long") * self.blocks + F.greatest(block, q)).alias("cell"),
            F.when(q >= block, side).otherwise(side + 1).alias("side"))))
        return rows.select(at.alias("at"), "*").select("at.cell", "at.side", *rows.columns)

    def _received_in_cells(self, x: DataFrame) -> DataFrame:
        """What is sent between two nodes of which one is wide, ``x(node, dim, s, k, m)``.  A task holds the dims of a
        cell's nodes as dense columns."""
        inc = met(self.inc, self.inc.where("wide").select("k").distinct(), "k", "left_semi")
        keys = inc.select("node", "k", "wide", F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("c"))
        sent = met(x, inc.select("node").distinct(), "node", "left_semi").select(
            "node", F.col("dim").alias("k"), F.lit(False).alias("wide"), "s", F.col("k").alias("c"))
        rows = self._cells(keys, 0).unionByName(self._cells(sent, 2))
        dealt = rows.repartition(default_parallelism(rows), "cell").sortWithinPartitions("cell")
        got = dealt.mapInArrow(partial(_received_rows, self.blocks), "node long, dim long, s double, k long")
        return got.withColumn("m", F.lit(None).cast("double"))

    def degrees(self) -> DataFrame:
        """``(node, degree)`` of nodes that have a neighbour."""
        one = self.sets.select("node", F.lit(0).alias("dim"), F.lit(1.0).alias("value"))
        return self.received(one).select("node", F.col("k").alias("degree"))


def links(inc: DataFrame, edge_type: str = "", block_rows: int = LINK_ROWS) -> Links:
    """The graph of ``inc(node, key)``, nodes being longs.  Keys become numbers; those of one node drop out."""
    rows = inc.select("node", "key").distinct()
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= 2)
    keys = stage_table(sizes.withColumn("k", F.monotonically_increasing_id()), "link-keys")
    sets = met(rows, keys, "key").groupBy(F.col("node").cast("long").alias("node")).agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("ks"))
    n_subsets, n_pairs = F.pow(F.lit(2.0), F.size("ks")) - 1, F.aggregate("ks.m", F.lit(0).cast("long"), lambda t, m: t + m - 1)
    wide = (F.size("ks") > SUBSET_KEYS) | (n_subsets > F.greatest(F.lit(SUBSETS), n_pairs))
    sets = stage_table(sets.withColumn("wide", wide), "link-sets")
    size = keys.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.pow("m", F.lit(2))), F.lit(0.0)).alias("pairs")).first()
    # enough cells for all tasks, if there is work for them
    spread = min(4 * default_parallelism(inc), 8 * size.pairs / CHUNK)
    blocks = max(1, math.ceil(size.n / block_rows), math.ceil(math.sqrt(size.pairs / CELL_PAIRS)), math.ceil(math.sqrt(2 * spread)))
    return Links(edge_type, sets, blocks, not sets.where("wide").isEmpty())


# --------------------------------------------------------------------------- pairs of a key, within a task

def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in runs of whole keys (or pairs of a key's blocks); rows come ordered by these."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(c).to_numpy() for c in ("k", "p", "q")])
        if held and (ids[:, 0] != now).any():
            yield pa.Table.from_batches(held)
            held = []
        now = ids[:, -1]
        cuts = np.flatnonzero((np.diff(ids) != 0).any(axis=0))
        cut = int(cuts[-1]) + 1 if len(cuts) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _partners(group: np.ndarray, cross: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ascending groups the first of its partners, which follow each other, and their number: the later
    rows of the group, or in a group of two sides, for a row of the first side, all rows of the second."""
    at = np.arange(len(group))
    ends = np.cumsum(np.bincount(group))
    lo = np.where(cross, (ends - np.bincount(group, second, len(ends)).astype("int64"))[group], at + 1)
    return lo, np.where(cross & second, 0, ends[group] - lo)


def _runs(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers ``lo .. lo + n - 1`` of each entry, one after the other."""
    return np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Ascending numbers of the runs of equal rows."""
    new = np.zeros(len(columns[0]), "int64")
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _whole_keys(batches):
        k, p, q, side, node = (t.column(c).to_numpy() for c in ("k", "p", "q", "side", "node"))
        key_lists = t.column("keys").combine_chunks()
        sizes, others = key_lists.value_lengths().to_numpy(), key_lists.flatten().to_numpy()
        cell, cross, second = _groups(k, p, q), p != q, side == 1
        lo, n = _partners(cell, cross, second)
        # the other keys of the rows, those of one key and cell beside each other: pairs that share them as well
        row = np.repeat(np.arange(len(k)), sizes)
        rest = others != k[row]
        row, others = row[rest], others[rest]
        order = np.lexsort((others, cell[row]))
        row, others = row[order], others[order]
        more_lo, more_n = _partners(_groups(cell[row], others), cross[row], second[row])
        used = np.flatnonzero(more_n)
        used = used[np.argsort(row[used], kind="stable")]
        used_row = row[used]
        made = np.cumsum(n + np.bincount(row, more_n, len(k)).astype("int64"))
        start, done = 0, 0
        while start < len(k):
            end = max(start + 1, int(np.searchsorted(made, done + CHUNK, "right")))
            count, total = n[start:end], int(n[start:end].sum())
            if total:
                a, b = np.repeat(np.arange(start, end), count), _runs(lo[start:end], count)
                shared = np.ones(total, "int64")
                more = used[slice(*np.searchsorted(used_row, (start, end)))]
                if len(more):
                    first = np.cumsum(count) - count - lo[start:end]  # a pair's place is this plus its second row
                    place = np.repeat(first[row[more] - start], more_n[more]) + row[_runs(more_lo[more], more_n[more])]
                    shared += np.bincount(place, minlength=total)
                    keep = np.ones(total, bool)
                    keep[place[np.repeat(others[more] < k[row[more]], more_n[more])]] = False
                    a, b, shared = a[keep], b[keep], shared[keep]
                one, other = node[a], node[b]
                if cross[start:end].any():
                    one, other = np.minimum(one, other), np.maximum(one, other)
                if len(one):
                    yield pa.record_batch({"src": one, "dst": other, "n_shared": shared})
            start, done = end, int(made[end - 1])


# --------------------------------------------------------------------------- pairs of a cell, within a task

def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of one cell after the other; rows come ordered by cell."""
    held: list[pa.RecordBatch] = []
    now = None

    def columns() -> dict[str, np.ndarray]:
        t = pa.Table.from_batches(held)
        return {c: t.column(c).to_numpy() for c in t.column_names}

    for batch in batches:
        cells = batch.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if held and cells[lo] != now:
                yield columns()
                held = []
            now = cells[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield columns()


class _Cell:
    """Both sides' nodes, and their pairs as places in these, a chunk at a time.  ``first`` and ``second`` say
    which rows are the sides (different nodes), if not those of the cell's two blocks."""

    def __init__(self, c: dict[str, np.ndarray], blocks: int, first: np.ndarray | None = None, second: np.ndarray | None = None):
        self.same = first is None and c["cell"][0] // blocks == c["cell"][0] % blocks
        if first is None:
            first, second = c["side"] == 0, c["side"] == (0 if self.same else 1)
        self.a, ai = np.unique(c["node"][first], return_inverse=True)
        self.b, bi = np.unique(c["node"][second], return_inverse=True)
        by_node, by_key = np.argsort(ai, kind="stable"), np.argsort(c["k"][second], kind="stable")
        self.ai, keys = ai[by_node], c["k"][first][by_node]
        self.bi, posts = bi[by_key], c["k"][second][by_key]
        self.lo = np.searchsorted(posts, keys, "left")
        self.n = np.searchsorted(posts, keys, "right") - self.lo

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(places in a, places in b, shared keys)``: all pairs of a node are in one chunk."""
        ends = np.append(np.flatnonzero(np.diff(self.ai)) + 1, len(self.ai))  # of each node's rows
        made = np.cumsum(self.n)
        lo, done = 0, 0
        while lo < len(self.ai):
            fits = np.searchsorted(made[ends - 1], done + CHUNK, "right")
            hi = max(int(ends[fits - 1]) if fits else 0, int(ends[np.searchsorted(ends, lo, "right")]))
            n = self.n[lo:hi]
            total = int(n.sum())
            if total:
                within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                a = np.repeat(self.ai[lo:hi], n)
                b = self.bi[np.repeat(self.lo[lo:hi], n) + within]
                code = a * len(self.b) + b
                if self.same:
                    code = code[a < b]
                code, shared = np.unique(code, return_counts=True)
                if len(code):
                    yield code // len(self.b), code % len(self.b), shared
            lo, done = hi, int(made[hi - 1])


def _received_rows(blocks: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in _by_cell(batches):
        rows = c["side"] < 2
        dims = np.unique(c["k"][~rows])
        first, second, wide = c["side"] == 0, c["side"] == 1, c["wide"]
        if c["cell"][0] // blocks == c["cell"][0] % blocks:
            of_wide = rows & wide
            met = [_Cell({name: v[of_wide] for name, v in c.items()}, blocks)] if of_wide.any() else []
            sides = [(first & wide, first & ~wide)]
        else:
            met, sides = [], [(first & wide, second), (first & ~wide, second & wide)]
        for cell in [*met, *(_Cell(c, blocks, a, b) for a, b in sides if a.any() and b.any())]:
            yield from _sent(cell, c, dims)


def _sent(cell: _Cell, c: dict[str, np.ndarray], dims: np.ndarray) -> Iterator[pa.RecordBatch]:
    def held(nodes: np.ndarray) -> list[tuple]:
        """Sum and number of each dim, one entry for each node."""
        out = []
        for d in dims:
            mine = (c["side"] >= 2) & (c["k"] == d)
            at = np.searchsorted(nodes, c["node"][mine])
            known = at < len(nodes)
            known[known] = nodes[at[known]] == c["node"][mine][known]
            s, k = np.zeros(len(nodes)), np.zeros(len(nodes))
            s[at[known]], k[at[known]] = c["s"][mine][known], c["c"][mine][known]
            out.append((s, k))
        return out

    def empty(nodes: np.ndarray) -> list[tuple]:
        return [(np.zeros(len(nodes)), np.zeros(len(nodes))) for _ in dims]

    def send(got: list[tuple], to: np.ndarray, have: list[tuple], source: np.ndarray, size: int) -> None:
        for (s, k), (hs, hk) in zip(got, have):
            s += np.bincount(to, hs[source], size)
            k += np.bincount(to, hk[source], size)

    have_a = held(cell.a)
    have_b = have_a if cell.same else held(cell.b)
    got_a = empty(cell.a)
    got_b = got_a if cell.same else empty(cell.b)
    for a, b, _ in cell.chunks():
        send(got_b, b, have_a, a, len(cell.b))
        send(got_a, a, have_b, b, len(cell.a))
    for nodes, got in ((cell.a, got_a),) if cell.same else ((cell.a, got_a), (cell.b, got_b)):
        for d, (s, k) in zip(dims, got):
            at = np.flatnonzero(k > 0)
            if len(at):
                yield pa.record_batch({"node": nodes[at], "dim": np.full(len(at), d, "int64"), "s": s[at],
                                       "k": np.rint(k[at]).astype("int64")})
