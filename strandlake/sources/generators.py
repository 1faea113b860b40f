"""Made-up ensembles, one row for each point: frames are independent, so any number of them is made in parallel from a seed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.curves import chain


def _frames(spark: SparkSession, frames: int, make: Callable[[int, np.random.Generator], np.ndarray], seed: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for f in b.column(0).to_pylist():
                c = make(f, np.random.default_rng((seed, f)))
                yield pa.RecordBatch.from_pydict({"frame_id": pa.array([f] * len(c), pa.int64()), "res": pa.array(range(len(c)), pa.int32()), **{a: c[:, k].astype(float) for k, a in enumerate("xyz")}})

    return spark.range(frames).mapInArrow(run, "frame_id long, res int, x double, y double, z double")


def helix(points: int, radius: float = 2.3, turn: float = np.radians(100), rise: float = 1.5) -> np.ndarray:
    a = turn * np.arange(points)
    return np.stack([radius * np.cos(a), radius * np.sin(a), rise * np.arange(points)], 1)


def noisy_helices(spark: SparkSession, frames: int, points: int, noise: float = 0.05, decoys: int = 0, decoy_noise: float = 0.8, seed: int = 7) -> DataFrame:
    """Helices with Gaussian noise; the last ``decoys`` frames have more of it."""
    return _frames(spark, frames, lambda f, r: helix(points) + r.normal(0, decoy_noise if f >= frames - decoys else noise, (points, 3)), seed)


def two_state(spark: SparkSession, frames: int, points: int = 60, loop: tuple[int, int] = (25, 35), bend: float = 0.35, twist: float = 0.9, noise: float = 0.03, seed: int = 7) -> DataFrame:
    """Chains whose loop has one of two bends and twists, by turns of frames, with noise in every angle."""

    def make(f, r):
        kappa, tau = np.full(points - 2, 1.55), np.full(points - 3, 0.87)
        if f % 2:
            kappa[loop[0] : loop[1]] -= bend
            tau[loop[0] : loop[1]] += twist
        return chain(np.full(points - 1, 3.8), kappa + r.normal(0, noise, len(kappa)), tau + r.normal(0, noise, len(tau)))

    return _frames(spark, frames, make, seed)


def random_walks(spark: SparkSession, frames: int, points: int, step: float = 3.8, seed: int = 7) -> DataFrame:
    """Walks of equal steps that turn by angles whose cosine is evenly spread in (-0.8, 0.8)."""
    return _frames(spark, frames, lambda f, r: chain(np.full(points - 1, step), np.arccos(r.uniform(-0.8, 0.8, points - 2)), r.uniform(-np.pi, np.pi, points - 3)), seed)


def between(one: DataFrame, two: DataFrame, frames: int, noise: float = 0.0, seed: int = 7) -> DataFrame:
    """``frames`` steps from one curve (res, x, y, z) to another, the second left out, each with Gaussian noise."""
    b = two.select("res", *[F.col(c).alias(f"_{c}") for c in "xyz"])
    rows = one.join(b, "res").crossJoin(one.sparkSession.range(frames).withColumnRenamed("id", "frame_id"))  # a curve's points times the frames asked for
    at = F.col("frame_id") / frames
    return rows.select("frame_id", "res", *[((1 - at) * F.col(c) + at * F.col(f"_{c}") + (noise * F.randn(seed + k) if noise else 0.0)).alias(c) for k, c in enumerate("xyz")])
