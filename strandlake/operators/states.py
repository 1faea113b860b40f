"""Moment states that merge: count, mean and the sums of the second to fourth powers of the distance from the mean.

A state is one struct of five numbers. It can be stored, and the states of any parts of the data merge to that of the
whole (Pebay's formulas), so a profile is kept up to date without the rows behind it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ensemble import FLAT

STATE = "struct<n:bigint,mean:double,m2:double,m3:double,m4:double>"


def _state(n, mean, m2, m3, m4) -> Column:
    return F.struct(n.cast("long").alias("n"), mean.alias("mean"), m2.alias("m2"), m3.alias("m3"), m4.alias("m4"))


def empty() -> Column:
    zero = F.lit(0.0)
    return _state(F.lit(0), zero, zero, zero, zero)


def state(x: str | Column) -> Column:
    """Aggregate: the state of the non-null values of ``x``; of no values it has zeros."""
    x = F.col(x) if isinstance(x, str) else x
    n, var, zero = F.count(x), F.coalesce(F.var_pop(x), F.lit(0.0)), F.lit(0.0)
    m2 = var * n
    shape = var > 0
    m3 = F.when(shape, F.skewness(x) * m2 * F.sqrt(var)).otherwise(zero)
    m4 = F.when(shape, (F.kurtosis(x) + 3) * m2 * var).otherwise(zero)
    return _state(n, F.coalesce(F.avg(x), zero), m2, m3, m4)


def merge_two(a: Column, b: Column) -> Column:
    """The state of all values behind two states."""
    na, nb = a["n"].cast("double"), b["n"].cast("double")
    n = na + nb
    d = b["mean"] - a["mean"]
    s = d / n
    mean = a["mean"] + s * nb
    m2 = a["m2"] + b["m2"] + d * s * na * nb
    m3 = a["m3"] + b["m3"] + d * s * s * na * nb * (na - nb) + 3 * s * (na * b["m2"] - nb * a["m2"])
    m4 = a["m4"] + b["m4"] + d * s * s * s * na * nb * (na * na - na * nb + nb * nb) + 6 * s * s * (na * na * b["m2"] + nb * nb * a["m2"]) + 4 * s * (na * b["m3"] - nb * a["m3"])
    return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(_state(a["n"] + b["n"], mean, m2, m3, m4)).cast(STATE)


def merge(states: str | Column) -> Column:
    """Aggregate: many states to one. They merge in their own order, so the result does not depend on the plan.

    A group gathers one small struct for each stored state, which are as many as parts were stored.
    """
    return F.aggregate(F.array_sort(F.collect_list(states)), empty().cast(STATE), merge_two)


def summary(s: str | Column) -> dict[str, Column]:
    """n, mean, variance (population), skewness, kurtosis (excess) and bc of a state, 0 where undefined."""
    s = F.col(s) if isinstance(s, str) else s
    n, zero = s["n"].cast("double"), F.lit(0.0)
    var = F.when(n > 0, s["m2"] / n).otherwise(zero)
    flat = var <= FLAT
    skew = F.when(flat | (n < 3), zero).otherwise(s["m3"] / n / (var * F.sqrt(var)))
    kurt = F.when(flat | (n < 4), zero).otherwise(s["m4"] / n / (var * var) - 3)
    low = kurt + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))
    bc = F.when((n < 4) | flat, zero).when(low <= 1e-12, zero).otherwise(F.greatest(zero, F.least(F.lit(1.0), (skew * skew + 1) / low)))
    return {"n": s["n"], "mean": s["mean"], "variance": var, "skewness": skew, "kurtosis": kurt, "bc": bc}
