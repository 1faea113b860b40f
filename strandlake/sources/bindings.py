"""Curves bound to general tables: embeddings as 21-point frames, events as one curve per user, lineitem as one per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _point(at, names: str = "xyz"):
    return [F.get("embedding", at * 3 + k).cast("double").alias(n) for k, n in enumerate(names)]


def frames(spark: SparkSession, sf_dir: str, points: int = 21) -> DataFrame:
    """frame_id, res, x, y, z: 21 points of every embedding."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return e.select(F.col("vec_id").alias("frame_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("res")).select("frame_id", "res", *_point(F.col("res")))


def ribbons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, res, x, y, z, cx, cy, cz: points 0-9 as the curve and 10-19 as its second strand."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    e = e.select(F.col("vec_id").alias("frame_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("res"))
    second = [F.get("embedding", (F.col("res") + 10) * 3 + k).cast("double").alias(n) for k, n in enumerate(("cx", "cy", "cz"))]
    return e.select("frame_id", "res", *_point(F.col("res")), *second)


def nucleotides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, res, x, y, z (P), ox, oy, oz (C1'), nx, ny, nz (N): seven nucleotides of every embedding."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    e = e.select(F.col("vec_id").alias("frame_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("res"))
    more = [F.get("embedding", (F.col("res") + s) * 3 + k).cast("double").alias(p + "xyz"[k]) for s, p in ((7, "o"), (14, "n")) for k in range(3)]
    return e.select("frame_id", "res", *_point(F.col("res")), *more)


def user_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id (user), res, x (hours), y (value), z (props.k) by time."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    res = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 - 473328.0
    return e.select(F.col("user_id").alias("frame_id"), res.cast("int").alias("res"), hours.alias("x"), F.col("value").alias("y"), F.get_json_object("props", "$.k").cast("double").alias("z"))


def order_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id (order), res (place by line number), x (quantity), y (price / 1000), z (100 discount)."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(F.col("l_orderkey").alias("frame_id"), (F.row_number().over(w) - 1).alias("res"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))


def to_arrays(points: DataFrame) -> DataFrame:
    """frame_id, curve: points gathered in order (one frame's points are bounded by its curve)."""
    return points.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("res", "x", "y", "z"))), lambda p: F.struct(p.x.alias("x"), p.y.alias("y"), p.z.alias("z"))).alias("curve"))


def to_points(frames_: DataFrame) -> DataFrame:
    """The inverse of :func:`to_arrays`."""
    return frames_.select("frame_id", F.posexplode("curve").alias("res", "p")).select("frame_id", "res", "p.x", "p.y", "p.z")
