"""Writhe of curves: sums over segment pairs in NumPy where a frame's curve is, or pairs as rows by a range self-join within a frame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec as v
from . import curves
from .geometry import EPSILON, _order

_NEAR = 1e-12


def solid_angle(a: v.Vec, b: v.Vec, c: v.Vec) -> Column:
    return 2 * F.atan2(v.dot(a, v.cross(b, c)), 1 + v.dot(a, b) + v.dot(b, c) + v.dot(c, a))


def segment_pairs(points: DataFrame, most_apart: int | None = None) -> DataFrame:
    """frame_id, i, j, w: writhe of segments i and j >= i + 2 (at most ``most_apart`` apart); 0 where end points meet."""
    w = _order()
    s = points.select("frame_id", "res", "x", "y", "z", *[F.lead(a).over(w).alias(f"{a}1") for a in "xyz"]).where("x1 IS NOT NULL")
    one = s.select("frame_id", F.col("res").alias("i"), *[F.col(f"{a}{k}").alias(f"a{a}{k}") for a in "xyz" for k in ("", "1")])
    two = s.select(F.col("frame_id").alias("_f"), F.col("res").alias("j"), *[F.col(f"{a}{k}").alias(f"b{a}{k}") for a in "xyz" for k in ("", "1")])
    on = (F.col("frame_id") == F.col("_f")) & (F.col("j") >= F.col("i") + 2)
    if most_apart is not None:
        on &= F.col("j") - F.col("i") <= most_apart
    p = one.join(two, on)
    r1, r2, r3, r4 = v.vec("a"), v.vec("a", "1"), v.vec("b"), v.vec("b", "1")
    d = {"p": v.sub(r3, r1), "q": v.sub(r4, r1), "r": v.sub(r4, r2), "s": v.sub(r3, r2)}
    p = p.select("frame_id", "i", "j", *[c.alias(f"d{k}{a}") for k, t in d.items() for a, c in zip("xyz", t, strict=True)])
    p = p.withColumns({f"n{k}": v.norm(v.vec(f"d{k}")) for k in d})
    u = {k: tuple(c / F.col(f"n{k}") for c in v.vec(f"d{k}")) for k in d}
    p = p.select("frame_id", "i", "j", F.least(*[F.col(f"n{k}") for k in d]).alias("near"), *[c.alias(f"u{k}{a}") for k, t in u.items() for a, c in zip("xyz", t, strict=True)])
    a, b, c, e = (v.vec(f"u{k}") for k in "pqrs")
    value = (solid_angle(a, b, c) + solid_angle(a, c, e)) / (4 * F.pi())
    return p.select("frame_id", "i", "j", F.when(F.col("near") < _NEAR, 0.0).otherwise(value).alias("w"))


def total_writhe(points: DataFrame) -> DataFrame:
    """frame_id, writhe of every curve of 4 points or more."""

    def work(p):
        if p.shape[1] >= 4:
            yield np.arange(len(p)), [curves.total_writhe(p)]

    return curves.kernel(curves.gather(points), work, {"writhe": pa.float64()}, "writhe double")


def standard_writhe(points: DataFrame) -> DataFrame:
    """Writhe in the usual sign and scale of Gauss's integral: -2 times :func:`total_writhe`."""
    return total_writhe(points).withColumn("writhe", -2 * F.col("writhe"))


def _by_point(points: DataFrame, radius: int | Column, name: str, work) -> DataFrame:
    """frame_id, res and ``name`` from ``work(points, radius)`` -> places and (frames, places) values."""

    def parts(p, first, radii):
        for r in np.unique(radii):
            of = np.flatnonzero(radii == r)
            places, value = work(p[of], int(r))
            if len(places):
                yield np.repeat(of, len(places)), [(first[of][:, None] + places).ravel(), value.ravel()]

    sized = points.select("frame_id", "res", "x", "y", "z", (F.lit(radius) if isinstance(radius, int) else radius).cast("int").alias("_radius"))
    return curves.kernel(curves.gather(sized, F.min("res").cast("int"), F.max("_radius")), parts, {"res": pa.int32(), name: pa.float64()}, f"res int, {name} double")


def local_writhe(points: DataFrame, radius: int | Column) -> DataFrame:
    """frame_id, res, writhe for centres with ``radius`` points (a number, or a column of one value for each curve) on both sides; 0 without segment pairs."""

    def work(p, r):
        n = p.shape[1]
        places = np.arange(r, n - r) if n >= 2 * r + 2 else np.zeros(0, int)
        return places, curves.window_writhe(p, r)[:, places] if len(places) else np.zeros((len(p), 0))

    return _by_point(points, radius, "writhe", work)


def compactness(points: DataFrame, radius: int) -> DataFrame:
    """frame_id, res, compactness: |local writhe| times mean inner curvature of the window, which the ends clip; 0 below 4 points."""

    def work(p, r):
        n = p.shape[1]
        places = np.arange(n)
        kappa = np.concatenate([np.full((len(p), 1), np.nan), curves.invariants(p, EPSILON)[1], np.full((len(p), 1), np.nan)], 1)[:, :n] if n > 2 else np.full(p.shape[:2], np.nan)
        known = ~np.isnan(kappa)
        sums, counts = (np.concatenate([np.zeros((len(p), 1)), np.cumsum(x, 1)], 1) for x in (np.where(known, kappa, 0.0), known.astype(float)))
        lo, hi = np.maximum(places - r + 1, 0), np.minimum(places + r, n)
        mean = (sums[:, hi] - sums[:, lo]) / np.maximum(counts[:, hi] - counts[:, lo], 1)
        size = np.minimum(places + r, n - 1) - np.maximum(places - r, 0) + 1
        return places, np.where(size >= 4, np.abs(curves.window_writhe(p, r)) * mean, 0.0)

    return _by_point(points, radius, "compactness", work)
