"""Three-component vector and scalar metric expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str, suffix: str = "") -> Vec:
    return tuple(F.col(f"{prefix}{a}{suffix}") for a in "xyz")


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def scale(a: Vec, k) -> Vec:
    return tuple(p * k for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec, least: float | None = None) -> Vec:
    """a / |a|; null where |a| is below ``least``."""
    n = norm(a)
    n = n if least is None else F.when(n >= least, n)
    return a[0] / n, a[1] / n, a[2] / n


def clamp(x: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))  # these skip nulls


def circle_distance(a: Column, b: Column) -> Column:
    """Distance of two angles on the circle."""
    d = F.abs(a - b)
    return F.when(d > F.pi(), 2 * F.pi() - d).otherwise(d)


def bend_distance(ka: Column, ta: Column, kb: Column, tb: Column, wk: float = 1.0, wt: float = 1.0) -> Column:
    """Distance of two (curvature, torsion) points, torsion on the circle."""
    t = circle_distance(ta, tb)
    return F.sqrt(wk * (ka - kb) * (ka - kb) + wt * t * t)


def spectrum_distance(a: Column, b: Column) -> Column:
    """Root mean square difference of two arrays over their common length; 0 if there is none."""
    m = F.least(F.size(a), F.size(b))
    total = F.aggregate(F.zip_with(F.slice(a, 1, m), F.slice(b, 1, m), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x)
    return F.when(m > 0, F.sqrt(total / m)).otherwise(0.0)


def _warp(n: Column, m: Column, cost, combine) -> Column:
    """Dynamic programme over an n x m grid; one row of states is carried along."""
    far = F.lit(float("inf"))

    def row(prev, i):
        def step(acc, j):
            left = F.when(j > 0, F.element_at(acc, j)).otherwise(far)
            up = F.element_at(prev, j + 1)
            diag = F.when(j > 0, F.element_at(prev, F.greatest(j, F.lit(1)))).otherwise(far)
            best = F.when((i == 0) & (j == 0), F.lit(0.0)).otherwise(F.least(F.coalesce(left, far), up, diag))
            return F.concat(acc, F.array(combine(best, cost(i, j))))

        return F.aggregate(F.sequence(F.lit(0), m - 1), F.array().cast("array<double>"), step)

    last = F.aggregate(F.sequence(F.lit(0), n - 1), F.array_repeat(far, m), row)
    return F.when((n > 0) & (m > 0), F.element_at(last, -1)).otherwise(0.0)


def _bends(ka: Column, ta: Column, kb: Column, tb: Column, combine, wk: float = 1.0, wt: float = 1.0):
    n, m = F.least(F.size(ka), F.size(ta)), F.least(F.size(kb), F.size(tb))
    cost = lambda i, j: bend_distance(F.get(ka, i), F.get(ta, i), F.get(kb, j), F.get(tb, j), wk, wt)
    return n, m, _warp(n, m, cost, combine)


def frechet(ka: Column, ta: Column, kb: Column, tb: Column, wk: float = 1.0, wt: float = 1.0) -> Column:
    """Discrete Frechet distance of two (curvature, torsion) curves; 0 if either is empty."""
    return _bends(ka, ta, kb, tb, lambda best, c: F.greatest(best, c), wk, wt)[2]


def time_warp(ka: Column, ta: Column, kb: Column, tb: Column, wk: float = 1.0, wt: float = 1.0) -> Column:
    """Dynamic time warping cost divided by the sum of the lengths; 0 if either is empty."""
    n, m, d = _bends(ka, ta, kb, tb, lambda best, c: best + c, wk, wt)
    return F.when((n > 0) & (m > 0), d / (n + m)).otherwise(0.0)


def frechet_points(a: Column, b: Column) -> Column:
    """Discrete Frechet distance of two arrays of (x, y, z) structs."""

    def cost(i, j):
        p, q = F.get(a, i), F.get(b, j)
        return norm(tuple(p[c] - q[c] for c in "xyz"))

    return _warp(F.size(a), F.size(b), cost, lambda best, c: F.greatest(best, c))


#: Distances of two curves by name; those of bends take the weights wk and wt.
METRICS = {"writhe": spectrum_distance, "frechet": frechet, "time_warp": time_warp, "frechet_points": frechet_points}
