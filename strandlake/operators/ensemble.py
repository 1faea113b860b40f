"""Statistics over frames: moments, bimodality profiles, density profiles, threshold islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .writhe import compactness

FLAT = 1e-14


def bimodality(x: str | Column) -> Column:
    """Bimodality coefficient as an aggregate: (skewness^2 + 1) / (excess kurtosis + 3 (n-1)^2 / ((n-2)(n-3))), in [0, 1].

    0 for fewer than four values or a variance of at most 1e-14. Built on mergeable central-moment aggregates.
    """
    x = F.col(x) if isinstance(x, str) else x
    n = F.count(x).cast("double")
    flat = F.coalesce(F.var_pop(x), F.lit(0.0)) <= FLAT
    low = F.coalesce(F.kurtosis(x), F.lit(0.0)) + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))
    s = F.coalesce(F.skewness(x), F.lit(0.0))
    return F.when((n < 4) | flat, 0.0).otherwise(F.when(low <= 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s * s + 1) / low))))


def moments(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, n, mean, variance (population), skewness, kurtosis (excess), bc; shape moments are 0 where undefined."""
    flat = F.coalesce(F.var_pop(x), F.lit(0.0)) <= FLAT
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.var_pop(x).alias("variance"),
        F.when(flat | (F.count(x) < 3), 0.0).otherwise(F.skewness(x)).alias("skewness"),
        F.when(flat | (F.count(x) < 4), 0.0).otherwise(F.kurtosis(x)).alias("kurtosis"),
        bimodality(x).alias("bc"),
    )


def _scores(means: DataFrame, features: list[str], width: int) -> DataFrame:
    got = means.groupBy("window_start").agg(F.count("*").alias("_f"), *[bimodality(f"m_{f}").alias(f"bc_{f}") for f in features]).where("_f >= 4")
    score = F.greatest(*[F.col(f"bc_{f}") for f in features]) if len(features) > 1 else F.col(f"bc_{features[0]}")
    return got.select("window_start", (F.col("window_start") + width - 1).cast("int").alias("window_end"), *[f"bc_{f}" for f in features], score.alias("score"))


def bimodality_profile(inv: DataFrame, width: int) -> DataFrame:
    """window_start, window_end, bc_*, score: bimodality over frames of each window's mean angles."""
    w = Window.partitionBy("frame_id").orderBy("res")
    features = [f for f in ("kappa", "tau", "theta") if f in inv.columns]
    reach = {"kappa": width - 3, "tau": width - 4, "theta": width - 3}
    last = F.max("res").over(Window.partitionBy("frame_id"))
    m = inv.select("frame_id", F.col("res").alias("window_start"), last.alias("last"), *[F.avg(f).over(w.rowsBetween(0, reach[f])).alias(f"m_{f}") for f in features])
    return _scores(m.where(F.col("window_start") + width - 1 <= F.col("last")) if width >= 4 else m.where(F.lit(False)), features, width)


def bimodality_profile_unwrapped(inv: DataFrame, width: int) -> DataFrame:
    """Profile over inner vertices, with tau and theta continued from the first frame's angle over the branch cut."""
    turns = [f for f in ("tau", "theta") if f in inv.columns]
    first = inv.groupBy(F.col("res").alias("_res")).agg(*[F.min_by(f, "frame_id").alias(f"_{f}") for f in turns])
    turned = inv.join(F.broadcast(first), F.col("res") == F.col("_res"))  # one row for each place on a curve
    for f in turns:
        turned = turned.withColumn(f, F.col(f"_{f}") + F.atan2(F.sin(F.col(f) - F.col(f"_{f}")), F.cos(F.col(f) - F.col(f"_{f}"))))
    w = Window.partitionBy("frame_id").orderBy("res").rowsBetween(0, width - 1)
    features = [f for f in ("kappa", "tau", "theta") if f in inv.columns]
    last = F.max("res").over(Window.partitionBy("frame_id"))
    m = turned.select("frame_id", F.col("res").alias("window_start"), last.alias("last"), *[F.avg(f).over(w).alias(f"m_{f}") for f in features])
    return _scores(m.where(F.col("window_start") + width <= F.col("last") - 1), features, width)


def density_profile(points: DataFrame, radius: int) -> DataFrame:
    """res, mean_density, std_density, z_score of the compactness over frames."""
    per = compactness(points, radius).groupBy("res").agg(F.avg("compactness").alias("mean_density"), F.coalesce(F.stddev_samp("compactness"), F.lit(0.0)).alias("std_density"))
    every = Window.partitionBy()
    dev = F.greatest(F.coalesce(F.stddev_samp("mean_density").over(every), F.lit(0.0)), F.lit(1e-12))
    return per.withColumn("z_score", (F.col("mean_density") - F.avg("mean_density").over(every)) / dev)


def islands(profile: DataFrame, index: str, keep: Column, gap: int) -> DataFrame:
    """Rows of ``profile`` that ``keep`` allows, with ``island``: rows whose indexes are at most gap + 1 apart share one."""
    w = Window.partitionBy().orderBy(index)  # one row for each index of a curve
    got = profile.where(keep).withColumn("_new", F.coalesce((F.col(index) - F.lag(index).over(w) > gap + 1).cast("int"), F.lit(1)))
    return got.withColumn("island", F.sum("_new").over(w)).drop("_new")


def candidates(profile: DataFrame, threshold: float, gap: int = 1, shift: tuple[int, int] = (0, 0)) -> DataFrame:
    """start_res, end_res, peak_start, score of runs of windows scoring ``threshold`` or more; the first highest window is the peak."""
    got = islands(profile, "window_start", F.col("score") >= threshold, gap)
    best = F.max(F.struct(F.col("score"), (-F.col("window_start")).alias("at")))
    return got.groupBy("island").agg(
        (F.min("window_start") + shift[0]).cast("int").alias("start_res"), (F.max("window_end") + shift[1]).cast("int").alias("end_res"), (-best["at"]).cast("int").alias("peak_start"), best["score"].alias("score")
    ).drop("island")


def motifs(profile: DataFrame, threshold: float, gap: int = 2) -> DataFrame:
    """start_res, end_res, peak_res, mean_compactness, peak_compactness, z_score of runs of residues with a high z score."""
    got = islands(profile, "res", F.col("z_score") >= threshold, gap)
    best = F.max(F.struct("mean_density", (-F.col("res")).alias("at"), "z_score"))
    return got.groupBy("island").agg(
        F.min("res").alias("start_res"), F.max("res").alias("end_res"), (-best["at"]).cast("int").alias("peak_res"), F.avg("mean_density").alias("mean_compactness"), best["mean_density"].alias("peak_compactness"), best["z_score"].alias("z_score")
    ).drop("island")


def domain_means(profile: DataFrame, value: str, bounds: list[tuple[str, int, int]], error: str | None = None) -> DataFrame:
    """domain, mean, peak_res, peak(, error): mean of ``value`` over the residues lo .. hi - 1 of each (name, lo, hi), the first largest, and the mean of ``error``."""
    name = F.array(*[F.when((F.col("res") >= lo) & (F.col("res") < hi), F.lit(n)) for n, lo, hi in bounds])
    more = [error] if error else []
    rows = profile.select("res", value, *more, F.explode(F.array_compact(name)).alias("domain"))
    best = F.max(F.struct(F.col(value), (-F.col("res")).alias("at")))
    return rows.groupBy("domain").agg(F.avg(value).alias("mean"), (-best["at"]).cast("int").alias("peak_res"), best[value].alias("peak"), *[F.avg(e).alias(e) for e in more])


def with_error(profile: DataFrame, frames: int, std: str = "std_density") -> DataFrame:
    """``profile`` with sem: the standard error of a mean over ``frames``."""
    return profile.withColumn("sem", F.col(std) / F.sqrt(F.lit(float(frames))))
