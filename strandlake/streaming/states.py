"""Moments of a stream as keyed state of five doubles in ``transformWithState``: each batch's values merge into it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

SHAPE = "n long, mean double, m2 double, m3 double, m4 double"


def of_values(x: np.ndarray) -> tuple[int, float, float, float, float]:
    if not len(x):
        return 0, 0.0, 0.0, 0.0, 0.0
    d = x - x.mean()
    return len(x), float(x.mean()), float((d**2).sum()), float((d**3).sum()), float((d**4).sum())


def merged(a: tuple, b: tuple) -> tuple:
    """Moments of two parts about the mean of both."""
    if not a[0] or not b[0]:
        return b if not a[0] else a
    n = a[0] + b[0]
    mean = (a[0] * a[1] + b[0] * b[1]) / n
    out = [0.0, 0.0, 0.0]
    for k, m, m2, m3, m4 in (a, b):
        d = m - mean
        out[0] += m2 + k * d**2
        out[1] += m3 + 3 * d * m2 + k * d**3
        out[2] += m4 + 4 * d * m3 + 6 * d**2 * m2 + k * d**4
    return n, mean, *out


class Moments(StatefulProcessor):
    """Keeps one state for each key, and gives it out whenever it changes. Nulls and NaNs are not counted."""

    def __init__(self, keys: list[str], value: str):
        self.keys, self.value = keys, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("moments", SHAPE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = tuple(self.kept.get()) if self.kept.exists() else of_values(np.zeros(0))
        for part in rows:
            now = merged(now, of_values(part[self.value].dropna().to_numpy(float)))
        self.kept.update(now)
        yield pd.DataFrame([[*key, *now]], columns=[*self.keys, "n", "mean", "m2", "m3", "m4"])

    def close(self) -> None:
        pass


def streaming_states(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys`` and the new state of every key that a micro-batch touches (output mode update; needs the RocksDB state store).

    Rows meet by key here. Where a key may hold very many rows of one batch, take the states of the batches instead
    (:mod:`strandlake.operators.states`), which are summed before they move.
    """
    kinds = StructType([stream.schema[k] for k in keys]).simpleString()[7:-1].replace(":", " ")
    return stream.select(*keys, value).groupBy(*keys).transformWithStateInPandas(Moments(keys, value), outputStructType=f"{kinds}, {SHAPE}", outputMode="Update", timeMode="None")
