"""Embedding whitening by a bidiagonal qd solver.

1. Vectors become whole numbers (``scaled``); their count and per-dimension sums are exact.
2. Each task centres its rows and reduces them, block by block, to one triangular factor
   by QR; factors are merged in a tree of bounded fan-in.  The last factor R has the
   covariance R'R / n, which is never formed.
3. R (dimension by dimension) is reduced to an upper bidiagonal B by Householder
   reflections.
4. dqds (the differential qd algorithm with shifts) finds the singular values of B, small
   ones as accurately as large ones.
5. Twisted factorisations of B'B - s^2 I give the directions: the stationary transform from
   the top and the progressive one from the bottom meet where the pivot is least.  Directions
   of values that lie close together are found together, by a few inverse iterations with the
   twisted factors.
6. Rows are projected; the covariance of what comes out is measured over all rows.

Only counts, sums and one triangular factor (dimension^2 numbers) come to the driver.

Defined cases: a vector that is null or empty or holds a null or non-finite entry is
dropped; the dimension is the most frequent length (ties: the larger) and vectors of
another length are dropped, too; entries are held within +-2^40; repeated ids are rows of
their own; a component whose eigenvalue is zero (to rounding) has a null ``whitened`` and
is left out of ``identity_error``, which is null if no component is left; ``explained`` is
null if all vectors are equal; a deviation beyond a long is null; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import own_columns
from corpusloom.session import stage_table

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
ENTRY_BOUND = float(1 << 40)
BLOCK_ROWS = 4096
FAN_IN = 16
#: Values with relative gaps below this are a cluster.
CLUSTER_GAP = 1e-3
EPS = float(np.finfo(float).eps)


def scaled(entry: Column) -> Column:
    """floor(1024 * c) + 100000 as a long."""
    held = F.greatest(F.least(entry.cast("double"), F.lit(ENTRY_BOUND)), F.lit(-ENTRY_BOUND))
    return (F.floor(held * SCALE) + OFFSET).cast("long")


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, x)`` of the vectors that are not dropped for their entries."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = own_columns(vectors, id_col, vec_col).toDF("vec_id", "v")
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(finite(c.cast("double")), F.lit(False)))
                      ).select("vec_id", F.transform("v", scaled).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@dataclass
class Moments:
    """Row count and exact per-dimension sums."""

    n: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, the whole part of the mean taken off first."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])
        return (x - np.array(whole, np.int64)).astype(float) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n*x - S)^2, None beyond a long."""
        about = (self.centred(x) ** 2).sum(axis=1) * float(self.n) ** 2
        if len(x) and float(np.max(np.abs(x))) * self.n < 2.0 ** 62 and about.max() < 2.0 ** 62:
            d = x * np.int64(self.n) - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        out: list[int | None] = []
        for row, rough in zip(x, about, strict=True):
            exact = sum((self.n * v - s) ** 2 for v, s in zip(row.tolist(), self.sums, strict=True)) if rough < 2.0 ** 64 else None
            out.append(exact if exact is not None and exact < 1 << 63 else None)
        return out


def moments(rows: DataFrame, dim: int) -> Moments:
    """Count and sums of ``rows(x)``: one partial row a task, added up exactly."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            for at in range(0, len(x), BLOCK_ROWS):  # 4,096 entries below 2^51 add up within a long
                sums = [a + b for a, b in zip(sums, x[at:at + BLOCK_ROWS].sum(axis=0, dtype=np.int64).tolist(), strict=True)]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n]), pa.array([[Decimal(s) for s in sums]], pa.list_(pa.decimal128(38, 0)))], ["n", "sums"])

    parts = stage_table(rows.select("x").mapInArrow(add, "n long, sums array<decimal(38,0)>"), "moments")
    n = parts.agg(F.sum("n")).first()[0] or 0
    by_dim = parts.select(F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s")).collect()  # dim rows
    return Moments(n, [int(r.s) for r in sorted(by_dim, key=lambda r: r.k)])


def triangular_factor(rows: DataFrame, about: Moments) -> np.ndarray:
    """R of the QR factorisation of all centred rows."""
    dim = len(about.sums)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        r = np.zeros((0, dim))
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            for at in range(0, len(x), BLOCK_ROWS):
                r = np.linalg.qr(np.vstack([r, about.centred(x[at:at + BLOCK_ROWS])]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([r.tobytes()], pa.binary())], ["task", "r"])

    def merge(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(b).reshape(-1, dim) for b in found.sort_values("task", kind="stable")["r"]]
        return pd.DataFrame({"task": [key[0]], "r": [np.linalg.qr(np.vstack(parts), mode="r").tobytes()]})

    schema = "task long, r binary"
    parts = stage_table(rows.select("x").mapInArrow(reduce_rows, schema), "factors")
    left = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while left > 1:
        groups = parts.withColumn("group", F.floor(F.col("task") / FAN_IN)).groupBy("group")
        parts = stage_table(groups.applyInPandas(merge, schema), "factors")
        left = -(-left // FAN_IN)
    r = np.frombuffer(parts.first().r).reshape(-1, dim)
    return np.vstack([r, np.zeros((dim - len(r), dim))])


def _reflector(v: np.ndarray) -> tuple[np.ndarray, float]:
    """u with (I - 2uu') v = a * e1, and a; u is zero where v needs no reflection."""
    norm = float(np.linalg.norm(v))
    if norm == 0.0 or not v[1:].any():
        return np.zeros_like(v), float(v[0])
    a = -norm if v[0] > 0 else norm
    u = v.copy()
    u[0] -= a
    return u / np.linalg.norm(u), a


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of B, and V with r = U B V'."""
    b, n = r.astype(float), len(r)
    v = np.eye(n)
    for k in range(n):
        u, b[k, k] = _reflector(b[k:, k].copy())
        b[k:, k + 1:] -= 2 * np.outer(u, u @ b[k:, k + 1:])
        if k < n - 1:
            u, b[k, k + 1] = _reflector(b[k, k + 1:].copy())
            b[k + 1:, k + 1:] -= 2 * np.outer(b[k + 1:, k + 1:] @ u, u)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ u, u)
    return np.diag(b).copy(), np.diag(b, 1).copy(), v


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], int]:
    """One dqds transform; the last entry is the place of the first negative pivot (-1: none)."""
    n, d = len(q), q[0] - shift
    out_q, out_e = [0.0] * n, [0.0] * (n - 1)
    for k in range(n - 1):
        if d < 0:
            return out_q, out_e, k
        out_q[k] = d + e[k]
        t = q[k + 1] / out_q[k] if out_q[k] else 0.0
        out_e[k] = e[k] * t
        d = d * t - shift if out_q[k] else q[k + 1] - shift
    out_q[n - 1] = d
    return out_q, out_e, n - 1 if d < 0 else -1


def _shift(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two rows, as a guess of the smallest."""
    a, b, c = q[-2], q[-1], e[-1]
    half, det = (a + b + c) / 2, a * b
    root = half + max(0.0, half * half - det) ** 0.5
    return det / root if root else 0.0


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of an upper bidiagonal, falling."""
    scale = max(float(np.max(np.abs(diagonal), initial=0.0)), float(np.max(np.abs(above), initial=0.0)))
    if scale == 0.0:
        return np.zeros(len(diagonal))
    todo = [([float(x) ** 2 for x in diagonal / scale], [float(x) ** 2 for x in above / scale], 0.0)]
    tiny, found = (10 * EPS) ** 2, []
    while todo:
        q, e, total = todo.pop()
        while len(q) > 1:
            if e[-1] <= tiny * (total + q[-1]):  # the last value has converged
                found.append(total + q.pop())
                e.pop()
                continue
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= tiny * total or e[k] <= tiny * q[k]), None)
            if cut is not None and cut < len(e):
                todo.append((q[:cut + 1], e[:cut], total))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if 1.5 * q[0] < q[-1]:  # the smallest value should come out at the end: turn the order round
                q, e = _reversed(q, e)
            shift = _shift(q, e)
            for _ in range(6):
                next_q, next_e, bad = _step(q, e, shift)
                if bad < 0:
                    break
                shift = shift + next_q[-1] if bad == len(q) - 1 and 0 < -next_q[-1] < shift / 2 else shift / 4
            else:
                shift = 0.0
                next_q, next_e, _ = _step(q, e, 0.0)
            q, e, total = next_q, next_e, total + shift
        if q:
            found.append(total + q[0])
    return scale * np.sqrt(np.maximum(np.sort(np.array(found))[::-1], 0.0))


def _reversed(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The qd arrays of the same matrix read from its other corner."""
    return q[::-1], e[::-1]


class Twisted:
    """Factors of B'B - value*I from both ends, joined at the least pivot."""

    def __init__(self, diagonal: np.ndarray, above: np.ndarray, value: float):
        n = len(diagonal)
        d, low = diagonal ** 2, above / diagonal[:-1]
        floor = EPS * EPS * max(float(d.max()), 1e-300)
        away = lambda p: p if abs(p) > floor else floor
        self.down, self.pivot_down = np.zeros(max(n - 1, 0)), np.zeros(n)  # from the top
        self.up, self.pivot_up = np.zeros(max(n - 1, 0)), np.zeros(n)  # from the bottom
        s, p = np.zeros(n), np.zeros(n)
        s[0], p[n - 1] = -value, d[n - 1] - value
        for i in range(n - 1):
            self.pivot_down[i] = away(s[i] + d[i])
            self.down[i] = d[i] * low[i] / self.pivot_down[i]
            s[i + 1] = self.down[i] * low[i] * s[i] - value
        for i in range(n - 2, -1, -1):
            self.pivot_up[i + 1] = away(d[i] * low[i] ** 2 + p[i + 1])
            t = d[i] / self.pivot_up[i + 1]
            self.up[i] = low[i] * t
            p[i] = p[i + 1] * t - value
        pivots = s + p + value
        self.at = int(np.argmin(np.abs(pivots)))
        self.pivot = away(float(pivots[self.at]))

    def vector(self) -> np.ndarray:
        """The direction that the factors give for their value."""
        z = np.zeros(len(self.pivot_up))
        z[self.at] = 1.0
        self._spread(z)
        return z / np.linalg.norm(z)

    def _spread(self, x: np.ndarray) -> None:
        for i in range(self.at - 1, -1, -1):
            x[i] -= self.down[i] * x[i + 1]
        for i in range(self.at, len(x) - 1):
            x[i + 1] -= self.up[i] * x[i]

    def solve(self, rhs: np.ndarray) -> np.ndarray:
        x, k, n = rhs.copy(), self.at, len(rhs)
        for i in range(k):
            x[i + 1] -= self.down[i] * x[i]
        for i in range(n - 1, k, -1):
            x[i - 1] -= self.up[i - 1] * x[i]
        x[:k] /= self.pivot_down[:k, None]
        x[k] /= self.pivot
        x[k + 1:] /= self.pivot_up[k + 1:, None]
        self._spread(x)
        return x


def _cluster(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Directions of values that lie close together: inverse iterations on a block, and
    within the space they span the eigenvectors of B'B."""
    n, m = len(diagonal), len(values)
    x = np.random.default_rng(n * 1000 + m).standard_normal((n, m))
    factors = Twisted(diagonal, above, float(values.mean()) * (1 - 4 * EPS))
    for _ in range(4):
        x = np.linalg.qr(factors.solve(np.linalg.qr(x)[0]))[0]
    bx = diagonal[:, None] * x
    bx[:-1] += above[:, None] * x[1:]
    turned = np.linalg.eigh(bx.T @ bx)[1][:, ::-1]
    return x @ turned


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Right singular vectors of B of the ``k`` largest singular values, as columns; the
    largest is not zero."""
    diagonal, above, values = diagonal / values[0], above / values[0], values / values[0]
    diagonal = np.where(np.abs(diagonal) < EPS * EPS, EPS * EPS, diagonal)
    squares, out, at = values ** 2, [], 0
    while at < k:
        end = at + 1
        while end < len(values) and squares[end - 1] - squares[end] <= CLUSTER_GAP * squares[end - 1]:
            end += 1
        out.append(Twisted(diagonal, above, float(squares[at])).vector()[:, None] if end == at + 1
                   else _cluster(diagonal, above, squares[at:end]))
        at = end
    return np.hstack(out)[:, :k]


@dataclass
class Whitening:
    """Moments, directions (columns) and their singular values; ``squares`` is the sum of
    the squares of all singular values."""

    about: Moments
    directions: np.ndarray
    singular: np.ndarray
    squares: float

    def rank(self) -> int:
        """Components whose eigenvalue is not zero to rounding."""
        dim = len(self.about.sums)
        return int((self.singular > 8 * dim * EPS * max(self.squares ** 0.5, 1e-300)).sum())

    def explained(self) -> list[float | None]:
        return [float(s * s / self.squares) if self.squares else None for s in self.singular]


def _dimension(rows: DataFrame) -> int:
    first = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return first.d if first else 0


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of ``rows(x)``, at least one vector, all of length ``dim``."""
    about = moments(rows, dim)
    r = triangular_factor(rows, about)
    diagonal, above, v = bidiagonalise(r)
    values = dqds(diagonal, above)
    k = min(components, dim)
    directions = v @ right_vectors(diagonal, above, values, k) if values[0] > 0 else np.eye(dim)[:, :k]
    return Whitening(about, directions, values[:k], float((values ** 2).sum()))


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """``(vec_id, deviation, whitened)``; ``whitened`` is an array with a null for each
    component beyond the rank."""
    dim, k, rank = len(model.about.sums), model.directions.shape[1], model.rank()
    weights = model.directions[:, :rank] * (model.about.n ** 0.5 / model.singular[:rank])
    about = model.about

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            found = np.full((len(x), k), np.nan)
            found[:, :rank] = about.centred(x) @ weights
            flat = pa.array(found.ravel(), mask=np.isnan(found.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(about.deviations(x), pa.int64()), lists],
                                             ["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(apply, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(projected: DataFrame, rank: int) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    if not rank:
        return None
    w = [F.col("whitened")[i] for i in range(rank)]
    cells = projected.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i in range(rank) for j in range(i, rank)]).first()
    return max(abs(cells[f"c{i}_{j}"] - (i == j)) for i in range(rank) for j in range(i, rank))


RESULT = ("component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of every
    usable row and component (numbered from 1 by falling eigenvalue)."""
    rows = usable(vectors, id_col, vec_col)
    dim = _dimension(rows)
    if not dim:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, {RESULT}")
    rows = rows.where(F.size("x") == dim)
    model = fit(rows, dim, components)
    projected = stage_table(project(rows, model), "whitened")
    error = identity_error(projected, model.rank())
    explained = F.array(*[F.lit(e).cast("double") for e in model.explained()])
    return projected.select(
        "vec_id", F.lit(model.about.n).cast("long").alias("n"), "deviation", explained.alias("_e"),
        F.posexplode("whitened").alias("_k", "whitened")).select(
        "vec_id", (F.col("_k") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.col("_e")[F.col("_k")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
