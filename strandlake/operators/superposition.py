"""Superposition on part of a curve: the rotation is fitted on the residues of a mask and applied to all points.

A frame's fit needs sums over its masked points only (centres and the 3 x 3 products with the reference), made
before the exchange; the rotations of a batch of frames come from one batched SVD. Points are then moved by
expressions, second strands with them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec as v

_R = [f"r{i}{j}" for i in range(3) for j in range(3)]
_FIT = "frame_id long, n long, " + ", ".join(f"{c} double" for c in [*_R, "ox", "oy", "oz", "rmsd"])


def _reference(points: DataFrame, reference: int | DataFrame) -> DataFrame:
    of = points.where(F.col("frame_id") == reference) if isinstance(reference, int) else reference
    return of.select(F.col("res").alias("_res"), *[F.col(c).alias(f"_r{c}") for c in "xyz"])


def fit(points: DataFrame, reference: int | DataFrame, mask: Column | None = None) -> DataFrame:
    """frame_id, n, r00 .. r22, ox, oy, oz, rmsd: rotation and shift of each frame's masked points on those of the reference.

    ``reference`` is a frame of ``points`` or rows res, x, y, z; only residues that both have count. ``mask`` is a condition on the
    columns of ``points``, by default all of them. With fewer than three points, or points on a line, the fit is one of several.
    """
    own = points if mask is None else points.where(mask)
    j = own.join(F.broadcast(_reference(points, reference)), F.col("res") == F.col("_res"))  # one frame's points
    sums = [F.sum(c).alias(f"s_{c}") for c in ("x", "y", "z", "_rx", "_ry", "_rz")]
    mixed = [F.sum(F.col(p) * F.col(f"_r{q}")).alias(f"m_{p}{q}") for p in "xyz" for q in "xyz"]
    norms = F.sum(v.dot(v.vec(""), v.vec("")) + v.dot(v.vec("_r"), v.vec("_r"))).alias("q")
    t = j.groupBy(F.col("frame_id").cast("long").alias("frame_id")).agg(F.count("*").alias("n"), *sums, *mixed, norms)

    def run(batches):
        for b in batches:
            c = [x.to_numpy(zero_copy_only=False) for x in b.columns]
            n = c[1].astype(float)
            s, r = np.stack(c[2:5], 1) / n[:, None], np.stack(c[5:8], 1) / n[:, None]
            h = np.stack(c[8:17], 1).reshape(-1, 3, 3) - n[:, None, None] * s[:, :, None] * r[:, None, :]
            u, d, vt = np.linalg.svd(h)
            sign = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)
            vt[:, 2] *= sign[:, None]
            d[:, 2] *= sign
            turn = np.einsum("nki,njk->nij", vt, u)  # V diag(1, 1, sign) U^T
            shift = r - np.einsum("nij,nj->ni", turn, s)
            rest = c[17] - n * ((s * s).sum(1) + (r * r).sum(1)) - 2 * d.sum(1)
            out = [*turn.reshape(-1, 9).T, *shift.T, np.sqrt(np.maximum(0, rest) / n)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x) for x in out]], names=["frame_id", "n", *_R, "ox", "oy", "oz", "rmsd"])

    return t.mapInArrow(run, _FIT)


def moved(points: DataFrame, fits: DataFrame, strands: tuple[str, ...] = ("",)) -> DataFrame:
    """``points`` with the coordinates of all ``strands`` (prefixes of x, y, z) moved by the fit of their frame; frames without one are left out."""
    f = fits.select(F.col("frame_id").alias("_frame"), *_R, "ox", "oy", "oz")
    j = points.join(f, F.col("frame_id") == F.col("_frame"))
    new = {}
    for p in strands:
        for i, c in enumerate("xyz"):
            new[f"{p}{c}"] = sum((F.col(f"r{i}{k}") * F.col(f"{p}{a}") for k, a in enumerate("xyz")), F.col(f"o{c}"))
    return j.withColumns(new).drop("_frame", *_R, "ox", "oy", "oz")


def superposed(points: DataFrame, reference: int | DataFrame, mask: Column | None = None) -> DataFrame:
    """``points`` on the reference by the masked residues, with a second strand cx, cy, cz if there is one."""
    return moved(points, fit(points, reference, mask), ("", "c") if "cx" in points.columns else ("",))


def rmsd(aligned: DataFrame, reference: int | DataFrame, mask: Column | None = None) -> DataFrame:
    """frame_id, rmsd of points as they stand to those of the reference, over the masked residues that both have."""
    j = aligned.join(F.broadcast(_reference(aligned, reference)), F.col("res") == F.col("_res"))  # one frame's points
    j = j if mask is None else j.where(mask)
    d = v.sub(v.vec(""), v.vec("_r"))
    return j.groupBy("frame_id").agg(F.sqrt(F.avg(v.dot(d, d))).alias("rmsd"))


def mean_structure(points: DataFrame, start: int, mask: Column | None = None, rounds: int = 5, tolerance: float = 1e-9) -> DataFrame:
    """res, x, y, z: the mean of all frames, each laid on the mean of the round before by its masked residues, from frame ``start`` on.

    Each round is one pass over the points; a curve's means come to the driver, and the rounds end when they move less than ``tolerance``.
    """
    spark, schema = points.sparkSession, "res int, x double, y double, z double"
    now = spark.createDataFrame(sorted((r["res"], r["x"], r["y"], r["z"]) for r in points.where(F.col("frame_id") == start).select("res", *"xyz").collect()), schema)
    before = None
    for _ in range(rounds):
        mean = superposed(points, now, mask).groupBy("res").agg(*[F.avg(c).alias(c) for c in "xyz"])
        rows = sorted((r["res"], r["x"], r["y"], r["z"]) for r in mean.collect())
        now = spark.createDataFrame(rows, schema)
        if before is not None and len(rows) == len(before) and np.abs(np.array(rows) - np.array(before)).max(initial=0) < tolerance:
            break
        before = rows
    return now
