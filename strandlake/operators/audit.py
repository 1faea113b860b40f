"""Second estimators of the same quantities, to hold the operators against."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import curves


def gauss_writhe(points: DataFrame, steps: int = 40) -> DataFrame:
    """frame_id, writhe: Gauss's double integral by the midpoint rule with ``steps`` nodes a segment; usual sign and scale."""
    t = (np.arange(steps) + 0.5) / steps

    def work(p):
        if p.shape[1] < 4:
            return
        d = np.diff(p, axis=1)
        out = np.zeros(len(p))
        for i in range(d.shape[1]):
            for j in range(i + 2, d.shape[1]):
                a = p[:, i, None] + t[None, :, None] * d[:, i, None]
                b = p[:, j, None] + t[None, :, None] * d[:, j, None]
                far = a[:, :, None] - b[:, None]
                turn = np.cross(d[:, i], d[:, j])
                out += 2 * (np.einsum("fk,fuvk->fuv", turn, far) / np.linalg.norm(far, axis=3) ** 3).sum((1, 2)) / steps**2
        yield np.arange(len(p)), [out / (4 * np.pi)]

    return curves.kernel(curves.gather(points), work, {"writhe": pa.float64()}, "writhe double")


def arc_writhe(points: DataFrame) -> DataFrame:
    """frame_id, writhe: the exact sum over segment pairs of spherical quadrangle areas by arc sines; usual sign and scale."""

    def work(p):
        n = p.shape[1] - 1
        if n < 3:
            return
        i, j = np.triu_indices(n, 2)
        out = np.zeros(len(p))
        part = max(1, curves.PAIR_BYTES // (8 * len(i)))
        for at in range(0, len(p), part):
            c = p[at : at + part]
            r13, r14, r23, r24 = c[:, j] - c[:, i], c[:, j + 1] - c[:, i], c[:, j] - c[:, i + 1], c[:, j + 1] - c[:, i + 1]
            sides = [np.cross(a, b) for a, b in ((r13, r14), (r14, r24), (r24, r23), (r23, r13))]
            units = [s / np.maximum(np.linalg.norm(s, axis=2), 1e-300)[..., None] for s in sides]
            area = sum(np.arcsin(np.clip((units[k] * units[(k + 1) % 4]).sum(2), -1, 1)) for k in range(4))
            sign = np.sign((np.cross(c[:, j + 1] - c[:, j], c[:, i + 1] - c[:, i]) * r13).sum(2))
            out[at : at + part] = (area * sign).sum(1) / (2 * np.pi)
        yield np.arange(len(p)), [out]

    return curves.kernel(curves.gather(points), work, {"writhe": pa.float64()}, "writhe double")


def bimodality_of(x: np.ndarray) -> float:
    """The bimodality coefficient of an array from its plain central moments."""
    x = np.asarray(x, float)
    n, d = len(x), x - x.mean() if len(x) else x
    m2 = (d**2).mean() if n else 0.0
    if n < 4 or m2 <= 1e-14:
        return 0.0
    low = (d**4).mean() / m2**2 - 3 + 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))
    return float(np.clip(((d**3).mean() ** 2 / m2**3 + 1) / low, 0, 1)) if low > 1e-12 else 0.0
