"""Curves as arrays: one row for each frame, and NumPy kernels over batches of frames of one length.

Gathering takes one exchange by frame. The kernels need all segment pairs of a curve and run where its array is, so
that no pair becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Bytes of the segment pairs that a kernel holds at a time, for each of its some 30 arrays of them.
PAIR_BYTES = 4 << 20
_NEAR = 1e-12


def gathered(name: str) -> Column:
    """Aggregate: the non-null values of a column in the order of ``res``."""
    got = F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("res", name))))
    return F.transform(got, lambda s: s[name]).cast("array<double>").alias(name)


def gather(points: DataFrame, *more: Column) -> DataFrame:
    """frame_id, points (flat x, y, z in the order of res) and the aggregates ``more``."""
    got = F.array_sort(F.collect_list(F.struct("res", "x", "y", "z")))
    flat = F.flatten(F.transform(got, lambda p: F.array(p["x"], p["y"], p["z"])))
    return points.groupBy("frame_id").agg(flat.alias("points"), *[c.alias(f"more{k}") for k, c in enumerate(more)])


def by_length(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``batch`` by the length of their flat point arrays: row numbers and (rows, points, 3) coordinates, in bounded parts."""
    a = batch.column(column)
    size = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    data, start = a.values.to_numpy(zero_copy_only=False).astype(float), a.offsets.to_numpy()[:-1]
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        part = max(1, PAIR_BYTES // (8 * max(1, (n // 3) ** 2)))
        for k in range(0, len(rows), part):
            use = rows[k : k + part]
            yield use, data[start[use][:, None] + np.arange(n)].reshape(len(use), n // 3, 3)


def _solid(a, b, c):
    dot = lambda p, q: np.einsum("...i,...i->...", p, q)
    return 2 * np.arctan2(dot(a, np.cross(b, c)), 1 + dot(a, b) + dot(b, c) + dot(c, a))


def diagonals(p: np.ndarray, apart: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """d, w (frames, segments - d): writhe of segments i and i + d for d from 2 (to ``apart``); 0 where end points meet.

    Neighbouring diagonals are computed together as far as :data:`PAIR_BYTES` goes.
    """
    n = p.shape[1] - 1
    last = n - 1 if apart is None else min(apart, n - 1)
    d = 2
    while d <= last:
        many = max(1, PAIR_BYTES // (8 * max(1, len(p) * (n - d))))
        upto = min(last + 1, d + many)
        i = np.concatenate([np.arange(n - k) for k in range(d, upto)])
        j = i + np.repeat(np.arange(d, upto), [n - k for k in range(d, upto)])
        between = [p[:, j] - p[:, i], p[:, j + 1] - p[:, i], p[:, j + 1] - p[:, i + 1], p[:, j] - p[:, i + 1]]
        size = [np.linalg.norm(x, axis=-1) for x in between]
        meet = np.minimum.reduce(size) < _NEAR
        a, b, c, e = (x / np.where(s < _NEAR, 1.0, s)[..., None] for x, s in zip(between, size, strict=True))
        w = np.where(meet, 0.0, (_solid(a, b, c) + _solid(a, c, e)) / (4 * np.pi))
        at = 0
        for k in range(d, upto):
            yield k, w[:, at : at + n - k]
            at += n - k
        d = upto


def total_writhe(p: np.ndarray) -> np.ndarray:
    out = np.zeros(len(p))
    for _, w in diagonals(p):
        out += w.sum(1)
    return out


def window_writhe(p: np.ndarray, radius: int) -> np.ndarray:
    """(frames, points): sum over segment pairs within ``radius`` points of each point, clipped at the ends."""
    count = p.shape[1]
    out = np.zeros(p.shape[:2])
    centre = np.arange(count)
    for d, w in diagonals(p, 2 * radius - 1):
        total = np.concatenate([np.zeros((len(p), 1)), np.cumsum(w, 1)], 1)
        lo = np.minimum(np.maximum(centre - radius, 0), w.shape[1])
        hi = np.clip(centre + radius - d, lo, w.shape[1])
        out += total[:, hi] - total[:, lo]
    return out


def invariants(p: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool, bool]:
    """seg, kappa, tau (NaN where undefined), and whether a segment is degenerate or two are collinear."""
    d = np.diff(p, axis=1)
    seg = np.linalg.norm(d, axis=-1)
    short = seg < epsilon
    with np.errstate(invalid="ignore", divide="ignore"):
        t = d / np.where(short, np.nan, seg)[..., None]
        one, two = t[:, :-1], t[:, 1:]
        kappa = np.arccos(np.clip((one * two).sum(-1), -1, 1))
        b = np.cross(one, two) if p.shape[1] > 2 else np.zeros((len(p), 0, 3))
        size = np.linalg.norm(b, axis=-1)
        flat = size < epsilon
        b = b / np.where(flat, np.nan, size)[..., None]
        u, w = b[:, :-1], b[:, 1:]
        tau = np.arctan2((np.cross(u, w) * two[:, :-1]).sum(-1), np.clip((u * w).sum(-1), -1, 1)) if p.shape[1] > 3 else np.zeros((len(p), 0))
    return np.where(short, np.nan, seg), kappa, tau, bool(short.any()), bool(flat.any())


def warp(cost: np.ndarray, total: bool) -> np.ndarray:
    """Last cell of the dynamic programme over (rows, n, m) costs: largest cost of the best way, or its ``total``."""
    rows, n, m = cost.shape
    before = None
    for i in range(n):
        line = np.empty((rows, m))
        for j in range(m):
            way = [line[:, j - 1]] if j else []
            if i:
                way += [before[:, j], before[:, j - 1]] if j else [before[:, j]]
            best = np.minimum.reduce(way) if way else 0.0
            line[:, j] = best + cost[:, i, j] if total else np.maximum(best, cost[:, i, j])
        before = line
    return before[:, -1] if n and m else np.zeros(rows)


def chains(length: np.ndarray, kappa: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """(frames, segments + 1, 3) points of chains from their segment lengths, bends and twists, by turning a frame along each."""
    rows, n = length.shape
    p, t, b = np.zeros((rows, 3)), np.tile([1.0, 0, 0], (rows, 1)), np.tile([0, 0, 1.0], (rows, 1))
    out = np.zeros((rows, n + 1, 3))
    for i in range(n):
        p = p + length[:, i, None] * t
        out[:, i + 1] = p
        if i < kappa.shape[1]:
            if i and i - 1 < tau.shape[1]:
                b = np.cos(tau[:, i - 1, None]) * b + np.sin(tau[:, i - 1, None]) * np.cross(t, b)
            t = np.cos(kappa[:, i, None]) * t + np.sin(kappa[:, i, None]) * np.cross(b, t)
    return out


def chain(length: np.ndarray, kappa: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """Points of one chain."""
    return chains(*(np.asarray(a, float)[None] for a in (length, kappa, tau)))[0]


def _lists(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return a.values.to_numpy(zero_copy_only=False).astype(float), a.offsets.to_numpy()[:-1], size


def distances(df: DataFrame, name: str, metric: str, one: list[str], two: list[str], weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """``df`` with the distance of the array columns ``one`` and ``two``.

    Metrics: "frechet" and "time_warp" of (curvature, torsion) arrays with their ``weights``, over the common length of the two; "frechet_points" of
    flat x, y, z arrays. 0 where a side is empty or null; time warping is divided by the sum of the lengths.
    """
    keep = df.columns
    width = len(one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [[_lists(b.column(len(keep) + k)) for k in range(at, at + width)] for at in (0, width)]
            per = 3 if metric == "frechet_points" else 1
            sizes = [np.minimum.reduce([x[2] for x in side]) // per for side in sides]
            out = np.zeros(b.num_rows)
            for n, m in {*zip(sizes[0].tolist(), sizes[1].tolist(), strict=True)}:
                if not n or not m:
                    continue
                rows = np.flatnonzero((sizes[0] == n) & (sizes[1] == m))
                part = max(1, PAIR_BYTES // (8 * n * m))
                for k in range(0, len(rows), part):
                    use = rows[k : k + part]
                    a, c = ([data[start[use][:, None] + np.arange(per * size)] for data, start, _ in side] for side, size in zip(sides, (n, m), strict=True))
                    if metric == "frechet_points":
                        cost = np.linalg.norm(a[0].reshape(len(use), n, 1, 3) - c[0].reshape(len(use), 1, m, 3), axis=-1)
                    else:
                        t = np.abs(a[1][:, :, None] - c[1][:, None, :])
                        t = np.where(t > np.pi, 2 * np.pi - t, t)
                        cost = np.sqrt(weights[0] * (a[0][:, :, None] - c[0][:, None, :]) ** 2 + weights[1] * t * t)
                    got = warp(cost, metric == "time_warp")
                    out[use] = got / (n + m) if metric == "time_warp" else got
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(out)], names=[*plain, "out"])

    plain = [f"c{i}" for i in range(len(keep))]
    wide = df.select(*[F.col(c).alias(p) for c, p in zip(keep, plain, strict=True)], *[F.col(c).cast("array<double>").alias(f"a{i}") for i, c in enumerate([*one, *two])])
    schema = StructType([*[StructField(p, f.dataType) for p, f in zip(plain, df.schema, strict=True)], StructField("out", DoubleType())])
    return wide.mapInArrow(run, schema).select(*[F.col(p).alias(c) for c, p in zip(keep, plain, strict=True)], F.col("out").alias(name))


def kernel(curves: DataFrame, work: Callable, columns: dict[str, pa.DataType], ddl: str) -> DataFrame:
    """frame_id and ``columns`` from ``work(points, other columns)`` -> lists of NumPy arrays by column, for parts of equal length."""
    schema = pa.schema([("frame_id", pa.int64()), *columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            more = [b.column(k).to_numpy(zero_copy_only=False) for k in range(2, b.num_columns)]
            for rows, p in by_length(b):
                for of, values in work(p, *[m[rows] for m in more]):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows][of], pa.int64()), *[pa.array(x, t) for x, t in zip(values, columns.values(), strict=True)]], schema=schema)

    return curves.withColumn("frame_id", F.col("frame_id").cast("long")).mapInArrow(run, "frame_id long, " + ddl)
