"""Streams of frames: new files of curves go through per-frame geometry in micro-batches, and profiles are kept by merging moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import curves, states
from ..operators.ensemble import bimodality
from ..sources import dcd
from ..operators.geometry import EPSILON

CURVE = "frame_id long, curve array<struct<x:double,y:double,z:double>>"


def read_frames(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Stream of Parquet files of whole curves (frame_id, curve), at most ``files`` in a micro-batch."""
    return spark.readStream.schema(CURVE).option("maxFilesPerTrigger", files).parquet(path)


def window_means(frames: DataFrame, width: int) -> DataFrame:
    """frame_id, window_start, m_kappa, m_tau of every window of ``width`` points: a frame's own row holds all it needs, so no state is kept."""
    import numpy as np
    import pyarrow as pa

    if width < 4:
        raise ValueError("a window has four points or more")
    flat = frames.select("frame_id", F.flatten(F.transform("curve", lambda p: F.array(p["x"], p["y"], p["z"]))).alias("points"))

    def work(p):
        n = p.shape[1] - width + 1
        if n < 1:
            return
        _, kappa, tau, short, flat_ = curves.invariants(p, EPSILON)
        if short or flat_:
            raise ValueError("degenerate or collinear segments")
        mean = lambda x, size: np.lib.stride_tricks.sliding_window_view(x, size, 1).mean(-1)[:, :n]
        yield np.repeat(np.arange(len(p)), n), [np.tile(np.arange(n), len(p)), mean(kappa, width - 2).ravel(), mean(tau, width - 3).ravel()]

    return curves.kernel(flat, work, {"window_start": pa.int32(), "m_kappa": pa.float64(), "m_tau": pa.float64()}, "window_start int, m_kappa double, m_tau double")


def profile(frames: DataFrame, width: int) -> DataFrame:
    """window_start, frames, bc_kappa, bc_tau over all frames so far; the state is a few doubles for each window."""
    return window_means(frames, width).groupBy("window_start").agg(F.count("*").alias("frames"), bimodality("m_kappa").alias("bc_kappa"), bimodality("m_tau").alias("bc_tau"))


def keep_profile(frames: DataFrame, width: int, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the profile in the in-memory table ``name`` until all that is there is read."""
    q = profile(frames, width).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def trajectory(spark: SparkSession, path: str, atoms: list[int] | None = None) -> DataFrame:
    """Stream of the frames of trajectory files, in batches of what the files have grown by: path, frame_id (its number in the file), curve."""
    rows = dcd.stream_dcd(spark, path, atoms)
    point = F.transform(F.arrays_zip("x", "y", "z"), lambda p: F.struct(*[p[c].cast("double").alias(c) for c in "xyz"]))
    return rows.select("path", F.col("frame_idx").alias("frame_id"), point.alias("curve"))


STORED = f"window_start int, frames long, kappa {states.STATE}, tau {states.STATE}, batch long"


def kept_profile(frames: DataFrame, width: int, folder: str, checkpoint: str) -> DataFrame:
    """Take what is new of the stream, and give window_start, frames, bc_kappa, bc_tau of all frames so far.

    Each micro-batch is summed to one moment state for a window, kept in ``folder`` in a partition of its own, which a
    repeated batch replaces; the profile is merged from these states.
    """
    spark = frames.sparkSession
    spark.createDataFrame([], STORED).write.mode("append").partitionBy("batch").parquet(folder)

    def add(part: DataFrame, batch: int) -> None:
        got = window_means(part, width).groupBy("window_start").agg(F.count("*").alias("frames"), *[states.state(f"m_{x}").alias(x) for x in ("kappa", "tau")])
        got.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    frames.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    whole = spark.read.schema(STORED).parquet(folder).groupBy("window_start").agg(F.sum("frames").alias("frames"), *[states.merge(x).alias(x) for x in ("kappa", "tau")])
    return whole.select("window_start", "frames", *[states.summary(x)["bc"].alias(f"bc_{x}") for x in ("kappa", "tau")])
