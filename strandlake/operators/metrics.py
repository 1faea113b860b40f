"""Distances of frames as searches use them, and searches that choose their plan from what a distance allows.

A metric names the arrays of a frame that it compares and its weights, and says whether it obeys the triangle
inequality. Where it does and an index has pivots for it (:mod:`pivots`), range and top-k searches are pruned by
them. What is left, or everything without pivots, is compared directly: a spectrum by an expression, a bend curve by
a cascade of lower bounds and an abandoned dynamic programme:

1. the end points, which every way passes, and a table over cells of (curvature, torsion) with the least distance of each cell
   to the query, looked up for every point of a frame: O(points);
2. the least distance of every point to the other curve, from the matrix of point distances;
3. the programme, left as soon as a whole line of it exceeds the limit.

The limit is the radius of a range search, or the k-th least distance that a task has found so far, so it tightens
as a task goes on, and within a batch frames come by their bound. Frames are skipped only where a bound, less a
slack for rounding, is above the limit, so answers and ties are those of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, AccumulatorParam, SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec as v
from . import curves

_SLACK = 1e-9
KAPPA_CELLS, TAU_CELLS = 24, 48
#: Frames of a batch whose programmes run together.
TOGETHER = 256


@dataclass(frozen=True)
class Metric:
    name: str
    arrays: tuple[str, ...]
    #: Whether d(a, c) <= d(a, b) + d(b, c) for all frames, or for all whose arrays are of one length.
    triangle: bool
    even: bool = False
    weights: tuple[float, float] = (1.0, 1.0)

    def of(self, row) -> tuple[np.ndarray, ...]:
        return tuple(np.array(row[a], float) for a in self.arrays)

    def size(self):
        """Column: what must be equal of two frames for the triangle inequality. Empty curves, at 0 from all others, are apart."""
        if self.even:
            return F.size(self.arrays[0])
        return F.when(F.least(*[F.size(a) for a in self.arrays]) > 0, 0).otherwise(-1)

    def length(self, one: tuple[np.ndarray, ...]) -> int:
        return len(one[0]) if self.even else 0 if min(map(len, one)) else -1

    def between(self, some: list[tuple], others: list[tuple]) -> np.ndarray:
        """Distances of two small sets of frames."""
        if self.name == "writhe":
            return np.array([[_rms(a[0], b[0]) for b in others] for a in some]).reshape(len(some), len(others))
        out = np.zeros((len(some), len(others)))
        for j, b in enumerate(others):
            sizes = np.array([min(map(len, a)) for a in some])
            for n in np.unique(sizes):
                use = np.flatnonzero(sizes == n)
                out[use, j] = full_warp(*(np.stack([some[i][k][:n] for i in use]) for k in (0, 1)), b, self)
        return out

    def column(self, df: DataFrame, name: str, query: tuple[np.ndarray, ...]) -> DataFrame:
        """``df`` with the distance of every frame to the query."""
        asked = [F.lit([float(x) for x in a]).cast("array<double>") for a in query]
        if self.name == "writhe":
            return df.withColumn(name, v.spectrum_distance(F.col("writhe"), asked[0]))
        names = [f"_q{k}" for k in range(len(asked))]
        return curves.distances(df.withColumns(dict(zip(names, asked, strict=True))), name, self.name, names, list(self.arrays), self.weights).drop(*names)


def metric(name: str, weights: tuple[float, float] = (1.0, 1.0)) -> Metric:
    """"writhe" (spectra), "frechet" or "time_warp" ((curvature, torsion) curves with weights of the two squares)."""
    if name == "writhe":
        return Metric(name, ("writhe",), True, even=True)
    if name not in ("frechet", "time_warp"):
        raise ValueError(f"no metric {name}")
    if min(weights) < 0:
        raise ValueError("weights are not negative")
    return Metric(name, ("kappa", "tau"), name == "frechet", weights=tuple(map(float, weights)))


def _rms(a: np.ndarray, b: np.ndarray) -> float:
    m = min(len(a), len(b))
    return float(np.sqrt(((a[:m] - b[:m]) ** 2).mean())) if m else 0.0


def _costs(kappa: np.ndarray, tau: np.ndarray, query: tuple, weights: tuple[float, float]) -> np.ndarray:
    """(frames, points of the query, points of a frame)."""
    m = min(map(len, query))
    t = np.abs(query[1][None, :m, None] - tau[:, None, :])
    t = np.where(t > np.pi, 2 * np.pi - t, t)
    return np.sqrt(weights[0] * (query[0][None, :m, None] - kappa[:, None, :]) ** 2 + weights[1] * t * t)


def full_warp(kappa: np.ndarray, tau: np.ndarray, query: tuple, of: Metric) -> np.ndarray:
    n, m = kappa.shape[1], min(map(len, query))
    if not n or not m:
        return np.zeros(len(kappa))
    total = of.name == "time_warp"
    return curves.warp(_costs(kappa, tau, query, of.weights), total) / ((n + m) if total else 1)


def cell_table(query: tuple, weights: tuple[float, float]) -> np.ndarray:
    """The least distance of any point of a (curvature, torsion) cell to the query's points, or less."""
    m = min(map(len, query))
    edge = np.linspace(0, np.pi, KAPPA_CELLS + 1)
    k = np.maximum(0, np.maximum(edge[:-1, None] - query[0][:m], query[0][:m] - edge[1:, None]))
    half = np.pi / TAU_CELLS
    mid = -np.pi + half * (1 + 2 * np.arange(TAU_CELLS))
    t = np.abs(mid[:, None] - query[1][:m])
    t = np.maximum(0, np.minimum(t, 2 * np.pi - t) - half)
    return np.sqrt((weights[0] * k[:, None, :] ** 2 + weights[1] * t[None, :, :] ** 2).min(2, initial=np.inf))


def first_bound(kappa: np.ndarray, tau: np.ndarray, query: tuple, of: Metric, table: np.ndarray) -> np.ndarray:
    """From the end points and the cell table."""
    n, m = kappa.shape[1], min(map(len, query))
    i = np.clip((kappa * (KAPPA_CELLS / np.pi)).astype(int), 0, KAPPA_CELLS - 1)
    j = np.clip(((tau + np.pi) * (TAU_CELLS / (2 * np.pi))).astype(int), 0, TAU_CELLS - 1)
    near = table[i, j]
    ends = [_costs(kappa[:, [p]], tau[:, [p]], tuple(q[:m][[p]] for q in query), of.weights)[:, 0, 0] for p in (0, -1)]
    if of.name == "frechet":
        return np.maximum(near.max(1), np.maximum(*ends))
    return np.maximum(near.sum(1), ends[0] + ends[1] if n + m > 2 else ends[0]) / (n + m)


def abandoned_warp(cost: np.ndarray, total: bool, limit: float) -> np.ndarray:
    """As :func:`curves.warp`, infinite where a whole line of the programme is above ``limit``."""
    rows, n, m = cost.shape
    out, live, before = np.full(rows, np.inf), np.arange(rows), None
    for i in range(n):
        line = np.empty((len(live), m))
        for j in range(m):
            way = [line[:, j - 1]] if j else []
            if i:
                way += [before[:, j], before[:, j - 1]] if j else [before[:, j]]
            best = np.minimum.reduce(way) if way else 0.0
            line[:, j] = best + cost[live, i, j] if total else np.maximum(best, cost[live, i, j])
        stays = line.min(1) <= limit
        if not stays.all():
            live, line = live[stays], line[stays]
            if not len(live):
                return out
        before = line
    out[live] = before[:, -1]
    return out


class _Sums(AccumulatorParam):
    def zero(self, value):
        return np.zeros_like(value)

    def addInPlace(self, a, b):  # noqa: N802
        return a + b


#: What a cascade counts: frames seen, left by the first bound, by the second, within the programme, and programmes run to their end.
STEPS = ("seen", "first", "second", "abandoned", "full")


def counter(sc: SparkContext) -> Accumulator:
    """For ``counts`` of the searches: sums of :data:`STEPS` (of tasks that ran twice, twice)."""
    return sc.accumulator(np.zeros(len(STEPS), np.int64), _Sums())


def _cascade(frames: DataFrame, query: tuple, of: Metric, k: int | None, radius: float, counts: Accumulator | None) -> DataFrame:
    """frame_id, distance: of each task the frames within the radius, or the k nearest of these."""
    table, total, m = cell_table(query, of.weights), of.name == "time_warp", min(map(len, query))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(STEPS), np.int64)
        ids, far = np.zeros(0, np.int64), np.zeros(0)

        def limit() -> float:
            return radius if k is None or len(far) < k else min(radius, float(far[-1]))

        def take(new_ids: np.ndarray, new_far: np.ndarray) -> None:
            nonlocal ids, far
            ids, far = np.concatenate([ids, new_ids]), np.concatenate([far, new_far])
            order = np.lexsort((ids, far))[:k]
            ids, far = ids[order], far[order]

        for b in batches:
            own = b.column(0).to_numpy()
            sides = [(x.values.to_numpy(zero_copy_only=False).astype(float), x.offsets.to_numpy()[:-1], x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) for x in (b.column(1), b.column(2))]
            size = np.minimum(sides[0][2], sides[1][2])
            seen[0] += len(own)
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                if not n or not m:
                    take(own[rows], np.zeros(len(rows)))
                    continue
                kappa, tau = (data[start[rows][:, None] + np.arange(n)] for data, start, _ in sides)
                low = first_bound(kappa, tau, query, of, table) * (1 - _SLACK) - _SLACK
                order = np.argsort(low, kind="stable")
                part = max(1, min(TOGETHER, curves.PAIR_BYTES // (8 * n * m)))
                for at in range(0, len(order), part):
                    use = order[at : at + part]
                    if low[use[0]] > limit():
                        seen[1] += len(order) - at
                        break
                    seen[1] += (low[use] > limit()).sum()
                    use = use[low[use] <= limit()]
                    cost = _costs(kappa[use], tau[use], query, of.weights)
                    side = [cost.min(axis) for axis in (1, 2)]
                    second = np.maximum(side[0].sum(1), side[1].sum(1)) / (n + m) if total else np.maximum(side[0].max(1), side[1].max(1))
                    go = second * (1 - _SLACK) - _SLACK <= limit()
                    seen[2] += (~go).sum()
                    scale = (n + m) if total else 1
                    got = abandoned_warp(cost[go], total, limit() * scale * (1 + _SLACK) + _SLACK) / scale
                    ended = np.isfinite(got)
                    seen[3] += (~ended).sum()
                    seen[4] += ended.sum()
                    good = ended & (got <= radius)
                    take(own[rows[use[go][good]]], got[good])
            if k is None and len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(far)], names=["frame_id", "distance"])
                ids, far = ids[:0], far[:0]
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(far)], names=["frame_id", "distance"])
        if counts is not None:
            counts.add(seen)

    return frames.select(F.col("frame_id").cast("long").alias("frame_id"), *[F.coalesce(a, F.array().cast("array<double>")).alias(a) for a in of.arrays]).mapInArrow(run, "frame_id long, distance double")


def _frames(index, query: tuple, of: Metric, radius: float | None) -> DataFrame:
    """The frames that may be within ``radius``: those that pivots leave, where the index has them for this metric."""
    from .pivots import PivotIndex

    if not isinstance(index, PivotIndex):
        return index
    return index.candidates(query, radius) if radius is not None and np.isfinite(radius) and of.triangle and index.metric == of else index.frames


def within(index, query, radius: float, of: Metric, counts: Accumulator | None = None) -> DataFrame:
    """frame_id, distance of the frames within ``radius`` of ``query``: a row with the metric's arrays, or a tuple of them."""
    query = query if isinstance(query, tuple) and not hasattr(query, "__fields__") else of.of(query)
    frames = _frames(index, query, of, radius)
    if of.name == "writhe":
        return of.column(frames, "distance", query).where(F.col("distance") <= radius).select("frame_id", "distance")
    return _cascade(frames, query, of, None, radius, counts)


def nearest(index, query, k: int, of: Metric, counts: Accumulator | None = None) -> DataFrame:
    """frame_id, distance of the k nearest, ties to smaller ids, in order."""
    from .pivots import PivotIndex

    query = query if isinstance(query, tuple) and not hasattr(query, "__fields__") else of.of(query)
    radius = index.radius(query, k) if isinstance(index, PivotIndex) and of.triangle and index.metric == of else float("inf")
    frames = _frames(index, query, of, radius)
    found = of.column(frames, "distance", query) if of.name == "writhe" else _cascade(frames, query, of, k, radius, counts)
    return found.select("frame_id", "distance").orderBy("distance", "frame_id").limit(k)
