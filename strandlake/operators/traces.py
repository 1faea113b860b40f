"""Traces as a whole: how long they are, single points, second strands put on and taken off, coordinates as arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import curves

STRAND = ("cx", "cy", "cz")


def describe(points: DataFrame) -> DataFrame:
    """frame_id, points, strand_points (0 without a second strand), has_strand (each point has one)."""
    strand = F.count_if(F.col("cx").isNotNull() & F.col("cy").isNotNull() & F.col("cz").isNotNull()) if "cx" in points.columns else F.lit(0)
    return points.groupBy("frame_id").agg(F.count("*").alias("points"), strand.cast("long").alias("strand_points")).withColumn("has_strand", F.col("points") == F.col("strand_points"))


def point(points: DataFrame, i: int) -> DataFrame:
    """Point ``i`` of every trace in the order of res, negative from the end; traces without it have no row."""
    order = F.col("res") if i >= 0 else F.col("res").desc()
    place = F.row_number().over(Window.partitionBy("frame_id").orderBy(order))
    return points.withColumn("_place", place).where(F.col("_place") == (i + 1 if i >= 0 else -i)).drop("_place")


def with_strand(points: DataFrame, strand: DataFrame) -> DataFrame:
    """``points`` with the second strand of rows frame_id, res, x, y, z, instead of one that is there.

    Fails where a trace and its strand differ in their points, as for a strand without a trace.
    """
    own = strand.select(F.col("frame_id").alias("_f"), F.col("res").alias("_r"), *[F.col(c).alias(f"_s{c}") for c in "xyz"])
    j = points.drop(*STRAND).join(own, (F.col("frame_id") == F.col("_f")) & (F.col("res") == F.col("_r")), "full")
    whole = F.col("frame_id").isNotNull() & F.col("_f").isNotNull()
    told = F.concat(F.lit("trace and strand differ at frame "), F.coalesce("frame_id", "_f").cast("string"), F.lit(", point "), F.coalesce("res", "_r").cast("string"))
    j = j.where(F.when(whole, True).otherwise(F.raise_error(told).cast("boolean")))
    return j.withColumns({s: F.col(f"_s{c}") for s, c in zip(STRAND, "xyz", strict=True)}).drop("_f", "_r", *[f"_s{c}" for c in "xyz"])


def backbone(ribbon: DataFrame) -> DataFrame:
    """The first strand alone; of nucleotides the P curve."""
    return ribbon.select("frame_id", "res", "x", "y", "z")


def ribbon(points: DataFrame) -> DataFrame:
    """``points`` as ribbons: fails where a trace has fewer than two points or one without its second strand."""
    d = describe(points)
    good = (F.col("points") >= 2) & F.col("has_strand")
    told = F.concat(F.lit("no ribbon: frame "), F.col("frame_id").cast("string"), F.lit(" has "), F.col("points").cast("string"), F.lit(" points and "), F.col("strand_points").cast("string"), F.lit(" of the second strand"))
    fine = d.where(F.when(good, True).otherwise(F.raise_error(told).cast("boolean"))).select(F.col("frame_id").alias("_f"))
    return points.join(fine, F.col("frame_id") == F.col("_f")).drop("_f")


def coordinates(points: DataFrame, frame_id: int, strand: bool = False) -> np.ndarray:
    """The (N, 3) coordinates of one trace, or of its second strand, at the driver."""
    own = points.where(F.col("frame_id") == frame_id)
    if strand:
        own = own.select("frame_id", "res", *[F.col(s).alias(c) for s, c in zip(STRAND, "xyz", strict=True)])
    got = curves.gather(own).head()
    if got is None:
        raise ValueError(f"there is no frame {frame_id}")
    return np.array(got["points"], float).reshape(-1, 3)
