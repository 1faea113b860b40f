"""Shared vector input rules of the two searches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows ``vec_id``, ``vec`` (doubles) of which neither is null and all components are finite."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec"))


def matrix(column) -> np.ndarray:
    """An Arrow list column as a row matrix; shorter vectors are filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(size) and (size == size[0]).all():
        return flat.reshape(len(size), int(size[0]))
    out = np.zeros((len(size), int(size.max(initial=0))))
    at = np.concatenate([[0], np.cumsum(size)])
    for i in range(len(size)):
        out[i, : size[i]] = flat[at[i] : at[i + 1]]
    return out


def widen(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))
