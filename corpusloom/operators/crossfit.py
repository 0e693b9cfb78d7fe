"""Many linear models in one pass over the data: grid settings, folds and class pairs.

A model tells one class from another over a feature map, by the squared hinge loss
``|w|^2 / 2 + sum cost * max(0, 1 - y * margin)^2`` (a linear support vector machine with
a smooth loss), and may leave out one fold of the rows.  All models are fitted together:
an optimiser step is one job whose tasks add up losses and gradients of every model that
has not converged, so the number of jobs does not grow with settings, folds or classes.
Each model has its own L-BFGS state on the driver (``HISTORY`` pairs of weight vectors).

What reaches the driver is bounded by the models: one gradient for each, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HISTORY = 10
STEPS = 200
TOLERANCE = 1e-4


@dataclass(frozen=True)
class FeatureMap:
    """Random Fourier features ``sqrt(2 / D) * cos(x A + c)`` and a constant 1."""

    a: np.ndarray  # (d, D)
    c: np.ndarray  # (D,)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2.0 / len(self.c)) * np.cos(x @ self.a + self.c)
        return np.hstack([z, np.ones((len(x), 1))])


@dataclass(frozen=True)
class Model:
    """Class ``positive`` against ``negative`` over feature map number ``features``;
    rows of fold ``held`` are left out (-1: none)."""

    features: int
    held: int
    positive: int
    negative: int
    cost_positive: float
    cost_negative: float


class Lbfgs:
    """One minimisation that is told loss and gradient at ``trial`` from outside."""

    def __init__(self, size: int, tolerance: float = TOLERANCE):
        self.trial, self.tolerance = np.zeros(size), tolerance
        self.x: np.ndarray | None = None
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.step, self.tries, self.done = 1.0, 0, False

    def _direction(self) -> np.ndarray:
        q, alphas = self.gradient.copy(), []
        for s, y in reversed(self.pairs):
            alphas.append(float(s @ q) / float(s @ y))
            q -= alphas[-1] * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= float(s @ y) / float(y @ y)
        for (s, y), alpha in zip(self.pairs, reversed(alphas), strict=True):
            q += (alpha - float(y @ q) / float(s @ y)) * s
        return -q

    def tell(self, loss: float, gradient: np.ndarray) -> None:
        if self.x is not None:
            enough = loss <= self.loss + 1e-4 * self.step * self.slope
            if not enough and self.tries < 20:
                # the parabola through both losses and the slope, within bounds
                bend = loss - self.loss - self.step * self.slope
                best = -self.slope * self.step ** 2 / (2 * bend) if bend > 0 and np.isfinite(bend) else 0.0
                self.step = min(max(best, 0.1 * self.step), 0.5 * self.step)
                self.tries += 1
                self.trial = self.x + self.step * self.direction
                return
            if not enough:
                self.trial, self.done = self.x, True
                return
            s, y = self.trial - self.x, gradient - self.gradient
            if float(s @ y) > 1e-12 * float(y @ y):
                self.pairs = [*self.pairs, (s, y)][-HISTORY:]
        first = self.x is None
        self.x, self.loss, self.gradient = self.trial, loss, gradient
        size = float(np.linalg.norm(gradient))
        if first:
            self.start = size
        if size <= self.tolerance * self.start:
            self.done = True
            return
        self.direction = self._direction()
        self.slope = float(gradient @ self.direction)
        if self.slope >= 0:
            self.pairs, self.direction, self.slope = [], -gradient, -size * size
        self.step, self.tries = 1.0 if self.pairs else min(1.0, 1.0 / size), 0
        self.trial = self.x + self.step * self.direction


def minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int, steps: int = STEPS,
             tolerance: float = TOLERANCE) -> np.ndarray:
    """The same method for a function at hand (``value`` gives loss and gradient)."""
    state = Lbfgs(size, tolerance)
    for _ in range(steps):
        state.tell(*value(state.trial))
        if state.done:
            break
    return state.x if state.x is not None else state.trial


def _signs(models: Sequence[Model], y: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """+1, -1 or 0 (no row of this model) and the cost of each row (rows by models)."""
    positive, negative, held = (np.array([getattr(m, k) for m in models]) for k in ("positive", "negative", "held"))
    costs = np.array([[m.cost_positive, m.cost_negative] for m in models])
    is_positive = y[:, None] == positive
    sign = (is_positive.astype(float) - (y[:, None] == negative)) * (fold[:, None] != held)
    return sign, np.where(is_positive, costs[:, 0], costs[:, 1])


def batch_arrays(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return x, batch.column("y").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)


def long_sums(rows: DataFrame, compute: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all tasks of an array of fixed shape that each task makes of its
    rows: added up by cell in a shuffle, so no task or driver gets one array a task."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = compute(batches)
        if found is not None:
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found.ravel()[at], pa.float64())], ["cell", "v"])

    cells = rows.mapInArrow(task, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(int(np.prod(shape)))
    out[cells["cell"].to_numpy(np.int64)] = cells["v"].to_numpy(float)
    return out.reshape(shape)


def fit(rows: DataFrame, maps: Sequence[FeatureMap], models: Sequence[Model], steps: int = STEPS,
        tolerance: float = TOLERANCE) -> tuple[np.ndarray, int]:
    """Weights (one row a model, the intercept last) and the number of jobs run.
    ``rows`` holds ``x array<double>, y int, fold int``."""
    dim, width = len(maps[0].a), len(maps[0].c) + 1
    states = [Lbfgs(width, tolerance) for _ in models]
    jobs = 0
    while jobs < steps:
        live = [i for i, s in enumerate(states) if not s.done]
        if not live:
            break
        by_map: dict[int, list[int]] = {}
        for slot, i in enumerate(live):
            by_map.setdefault(models[i].features, []).append(slot)
        weights = np.array([states[i].trial for i in live])
        own = [models[i] for i in live]

        def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            total = None
            for batch in batches:
                x, y, fold = batch_arrays(batch, dim)
                total = np.zeros((len(own), width + 1)) if total is None else total
                for number, slots in by_map.items():
                    # rows that none of the map's models learns from need no features
                    held = {own[k].held for k in slots}
                    mine = fold != held.pop() if len(held) == 1 else np.ones(len(fold), bool)
                    z = maps[number](x[mine])
                    sign, cost = _signs([own[k] for k in slots], y[mine], fold[mine])
                    slack = np.maximum(0.0, 1.0 - sign * (z @ weights[slots].T)) * np.abs(sign)
                    total[slots, 0] += (cost * slack * slack).sum(axis=0)
                    total[slots, 1:] += (-2.0 * cost * slack * sign).T @ z
            return total

        sums = long_sums(rows, partial, (len(live), width + 1))
        jobs += 1
        for slot, i in enumerate(live):
            w = weights[slot].copy()
            w[-1] = 0.0  # the intercept is not held small
            states[i].tell(0.5 * float(w @ w) + float(sums[slot, 0]), w + sums[slot, 1:])
    return np.array([s.x if s.x is not None else s.trial for s in states]), jobs


def votes(margins: np.ndarray, pairs: Sequence[tuple[int, int]], n_classes: int) -> np.ndarray:
    """The class that wins most pairs (ties: the first); ``margins`` are rows by pairs."""
    count = np.zeros((len(margins), n_classes))
    for k, (a, b) in enumerate(pairs):
        won = margins[:, k] > 0
        count[won, a] += 1
        count[~won, b] += 1
    return count.argmax(axis=1)


@dataclass
class Sigmoids:
    """``1 / (1 + exp(a * margin + b))`` for each pair."""

    a: np.ndarray
    b: np.ndarray
    steps: int = field(default=0)

    def __call__(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(np.clip(self.a * margins + self.b, -500, 500)))


def fit_sigmoids(rows: DataFrame, pairs: Sequence[tuple[int, int]], margins: Callable, dim: int,
                 steps: int = 50) -> Sigmoids:
    """Sigmoids that turn out-of-fold margins into probabilities, by Newton steps on the
    cross entropy (targets are drawn in from 0 and 1 by the class sizes); each step is
    one job for all pairs.  ``margins(x, fold)`` gives the margins of rows by pairs."""
    n_pairs = len(pairs)
    first, second = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])

    def sizes(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros((n_pairs, 2))
        for batch in batches:
            _, y, _ = batch_arrays(batch, dim)
            total += np.column_stack([(y[:, None] == first).sum(axis=0), (y[:, None] == second).sum(axis=0)])
        return total

    n = long_sums(rows, sizes, (n_pairs, 2))
    high, low = (n[:, 0] + 1) / (n[:, 0] + 2), 1 / (n[:, 1] + 2)
    a, b = np.zeros(n_pairs), np.log((n[:, 1] + 1) / (n[:, 0] + 1))
    best, damp, old = np.full(n_pairs, np.inf), np.full(n_pairs, 1e-10), (a, b)
    moved = np.ones(n_pairs, bool)
    used = 0
    sums = np.zeros((n_pairs, 6))
    for used in range(1, steps + 1):  # noqa: B007
        at = Sigmoids(a, b)

        def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            total = np.zeros((n_pairs, 6))
            for batch in batches:
                x, y, fold = batch_arrays(batch, dim)
                f = margins(x, fold)
                mine = (y[:, None] == first) | (y[:, None] == second)
                target = np.where(y[:, None] == first, high, low)
                z = at.a * f + at.b
                p = at(f)
                loss = np.where(mine, target * z + np.logaddexp(0.0, -z), 0.0)
                d = np.where(mine, target - p, 0.0)
                h = np.where(mine, p * (1 - p), 0.0)
                total += np.column_stack([loss.sum(axis=0), (d * f).sum(axis=0), d.sum(axis=0),
                                          (h * f * f).sum(axis=0), (h * f).sum(axis=0), h.sum(axis=0)])
            return total

        found = long_sums(rows, partial, (n_pairs, 6))
        better = found[:, 0] <= best + 1e-12 * np.abs(np.where(np.isfinite(best), best, 0.0))
        # a pair that got worse goes back and takes a shorter (more damped) step
        a, b = np.where(better, a, old[0]), np.where(better, b, old[1])
        sums = np.where(better[:, None], found, sums)
        damp = np.where(better, np.maximum(damp / 10, 1e-10), np.maximum(damp * 100, 1e-6))
        best = np.where(better, found[:, 0], best)
        old = (a, b)
        haa, hab, hbb = sums[:, 3] + damp, sums[:, 4], sums[:, 5] + damp
        det = np.maximum(haa * hbb - hab * hab, 1e-300)
        da, db = (hbb * sums[:, 1] - hab * sums[:, 2]) / det, (haa * sums[:, 2] - hab * sums[:, 1]) / det
        moved = (np.abs(da) > 1e-8 * (1 + np.abs(a))) | (np.abs(db) > 1e-8 * (1 + np.abs(b)))
        if not moved.any():
            break
        a, b = a - da, b - db
    return Sigmoids(old[0], old[1], used)


def couple(pairwise: np.ndarray, pairs: Sequence[tuple[int, int]], n_classes: int) -> np.ndarray:
    """Class probabilities (rows by classes) that agree best with the probabilities of
    pairs: for each row they minimise the sum of ``(r_ba p_a - r_ab p_b)^2`` under sum 1."""
    n = len(pairwise)
    r = np.full((n, n_classes, n_classes), 0.5)
    for k, (a, b) in enumerate(pairs):
        p = np.clip(pairwise[:, k], 1e-7, 1 - 1e-7)
        r[:, a, b], r[:, b, a] = p, 1 - p
    if n_classes == 1 or not n:
        return np.ones((n, n_classes))
    system = np.ones((n, n_classes + 1, n_classes + 1))
    system[:, -1, -1] = 0.0
    q = -np.transpose(r, (0, 2, 1)) * r
    off = ~np.eye(n_classes, dtype=bool)
    q[:, ~off] = (np.transpose(r, (0, 2, 1)) ** 2 * off).sum(axis=2)
    system[:, :-1, :-1] = q
    right = np.zeros((n, n_classes + 1, 1))
    right[:, -1] = 1.0
    p = np.maximum(np.linalg.solve(system, right)[:, :-1, 0], 0.0)
    return p / p.sum(axis=1, keepdims=True)
