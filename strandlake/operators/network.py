"""Residue correlation networks from mutual information of circularly centred features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ("kappa", "tau", "theta")
#: Bytes of the products of features of the frames that a task sums at a time.
PART_BYTES = 64 << 20


def centred_features(inv: DataFrame, chain: str | None = None) -> DataFrame:
    """frame_id, res (inner residue), u: features as residuals on the circle from each residue's circular mean.

    The last inner residue takes the torsion before it; a missing theta is 0.
    """
    names = [f for f in FEATURES if f in inv.columns]
    w = Window.partitionBy("frame_id").orderBy("res")
    rows = inv.where("kappa IS NOT NULL") if "tau" not in names else inv.withColumn("tau", F.coalesce("tau", F.lag("tau").over(w))).where("kappa IS NOT NULL")
    means = rows.groupBy("res").agg(*[F.atan2(F.sum(F.sin(f)), F.sum(F.cos(f))).alias(f"mu_{f}") for f in names], F.count("*").alias("frames"))
    rows = rows.join(F.broadcast(means), "res")  # one row for each place on a curve
    d = {f: F.coalesce(F.col(f), F.lit(0.0)) - F.col(f"mu_{f}") for f in names}
    return rows.select("frame_id", (F.col("res") + 1).alias("res"), F.array(*[F.atan2(F.sin(x), F.cos(x)) for x in d.values()]).alias("u"), "frames")


def _width(inv: DataFrame) -> int:
    return sum(f in inv.columns for f in FEATURES)


def _by_frame(features: DataFrame) -> DataFrame:
    """frame_id, res, frames, u (flat, in the order of res): one row for each frame."""
    got = F.array_sort(F.collect_list(F.struct("res", "frames", "u")))
    return features.groupBy("frame_id").agg(got.alias("_g")).select("frame_id", F.col("_g.res").cast("array<int>").alias("res"), F.col("_g.frames").cast("array<long>").alias("frames"), F.flatten("_g.u").alias("u"))


def _dense(batch: pa.RecordBatch, at: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, their frame counts, the (frames, places, n) features of a batch, 0 where a frame lacks a place, and which it has."""
    res, frames, u = (batch.column(at + k) for k in range(3))
    size = res.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(res)), size)
    flat = res.flatten().to_numpy(zero_copy_only=False)
    place, of = np.unique(flat, return_inverse=True)
    count = np.zeros(len(place), np.int64)
    count[of] = frames.flatten().to_numpy(zero_copy_only=False)
    x, has = np.zeros((len(res), len(place), n)), np.zeros((len(res), len(place)))
    has[row, of] = 1.0
    x[row, of] = u.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return place, count, x, has


def _pairs(a: DataFrame, b: DataFrame | None, n: int, m: int) -> DataFrame:
    """Second moments of all feature pairs (n and m features a residue) of residue pairs; without ``b``, pairs i < j of ``a``.

    Each batch of frames gives one row of sums for each pair, so that what is shuffled follows the pairs and not the frames.
    """
    one = _by_frame(a)
    both = one if b is None else one.join(_by_frame(b).toDF("_f", "res2", "frames2", "u2"), F.col("frame_id") == F.col("_f")).drop("_f")
    names = [f"{t}{r}{c}" for t, p_, q_ in (("a", n, n), ("b", m, m), ("c", n, m)) for r in range(p_) for c in range(q_) if t == "c" or r <= c]

    alone = b is None

    def parts(batches):
        """Batches in parts whose products stay within ``PART_BYTES``."""
        for batch in batches:
            longest = max(pc.max(batch.column(at).value_lengths()).as_py() or 1 for at in ((1,) if alone else (1, 4)))
            step = max(1, PART_BYTES // (16 * longest * max(n, m) ** 2))
            for k in range(0, batch.num_rows, step):
                yield batch.slice(k, step)

    def run(batches):
        for batch in parts(batches):
            place, count, x, has = _dense(batch, 1, n)
            other, _, y, has2 = (place, count, x, has) if alone else _dense(batch, 4, m)
            left, right = np.einsum("fir,fic->firc", x, x), np.einsum("fjr,fjc->fjrc", y, y)
            for i in range(len(place)):
                j = np.arange(i + 1, len(place)) if alone else np.arange(len(other))
                if not len(j):
                    continue
                sums = {"a": np.tensordot(has2[:, j], left[:, i], (0, 0)), "b": np.tensordot(has[:, i], right[:, j], (0, 0)), "c": np.tensordot(x[:, i], y[:, j], (0, 0)).transpose(1, 0, 2)}
                values = [np.ascontiguousarray(sums[k[0]][:, int(k[1]), int(k[2])]) for k in names]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), place[i], np.int32)), pa.array(other[j].astype(np.int32)), pa.array(np.full(len(j), count[i])), *[pa.array(z) for z in values]], names=["i", "j", "frames", *names])

    sums = both.mapInArrow(run, "i int, j int, frames long, " + ", ".join(f"{k} double" for k in names))
    return sums.groupBy("i", "j").agg(F.max("frames").alias("frames"), *[F.sum(k).alias(k) for k in names])


def _correlation(moments: DataFrame, n: int, m: int, eps: float, twice: bool) -> DataFrame:
    """i, j, r: sqrt(1 - exp(-2 MI)) from log-determinants of the regularised covariances, in batches."""
    cols = [c for c in moments.columns if c not in ("i", "j", "frames")]

    def run(batches):
        for b in batches:
            f = b.column(2).to_numpy().astype(float)[:, None, None] - 1
            v = {c: b.column(3 + k).to_numpy() for k, c in enumerate(cols)}
            full = np.zeros((b.num_rows, n + m, n + m))
            for r in range(n):
                for c in range(n):
                    full[:, r, c] = v[f"a{min(r, c)}{max(r, c)}"]
                for c in range(m):
                    full[:, r, n + c] = full[:, n + c, r] = v[f"c{r}{c}"]
            for r in range(m):
                for c in range(m):
                    full[:, n + r, n + c] = v[f"b{min(r, c)}{max(r, c)}"]
            full = full / f + eps * np.eye(n + m)
            det = [log_det(x) for x in (full[:, :n, :n], full[:, n:, n:], full + (eps if twice else 0.0) * np.eye(n + m))]
            mi = np.maximum(0, -0.5 * (det[2] - det[0] - det[1]))
            r = np.sqrt(np.clip(1 - np.exp(-2 * mi), 0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(r)], names=["i", "j", "r"])

    return moments.select(F.col("i").cast("int"), F.col("j").cast("int"), "frames", *cols).mapInArrow(run, "i int, j int, r double")


def log_det(a: np.ndarray) -> np.ndarray:
    """Log-determinants of symmetric matrices; where one isn't positive it is tried with 1e-4 on the diagonal, else 0."""
    sign, value = np.linalg.slogdet(a)
    bad = (sign <= 0) | (value <= np.log(1e-30))
    if bad.any():
        s, v = np.linalg.slogdet(a[bad] + 1e-4 * np.eye(a.shape[-1]))
        value[bad] = np.where(s > 0, v, 0.0)
    return value


def network(inv: DataFrame, eps: float = 1e-6, twice: bool = True) -> DataFrame:
    """i < j, r over inner residues of one chain. ``twice`` keeps the joint covariance's second regulariser."""
    u, n = centred_features(inv), _width(inv)
    return _correlation(_pairs(u, None, n, n), n, n, eps, twice)


def inter_network(one: DataFrame, two: DataFrame, eps: float = 1e-6, twice: bool = True) -> DataFrame:
    """i, j, r between inner residues of two chains with the same frames."""
    n, m = _width(one), _width(two)
    return _correlation(_pairs(centred_features(one), centred_features(two), n, m), n, m, eps, twice)


def full_matrix(edges: DataFrame, residues: int) -> DataFrame:
    """The dense symmetric matrix as rows i, j, r: diagonal 1, end residues 0."""
    spark = edges.sparkSession
    r = spark.range(residues)
    grid = r.select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(residues - 1))).alias("j"))
    both = edges.unionAll(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    return grid.join(both, ["i", "j"], "left").select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.coalesce("r", F.lit(0.0))).alias("r"))


def cooperativity(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: mean r over the listed (i, j) that the network has; repeats count; 0 if none."""
    e = edges.unionAll(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    return pairs.join(e, ["i", "j"]).agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("cooperativity"))


def centrality(edges: DataFrame, apart: int = 4) -> DataFrame:
    """res, centrality: sum of r to residues at least ``apart`` away."""
    e = edges.where(F.abs(F.col("i") - F.col("j")) >= apart)
    e = e.select(F.col("i").alias("res"), "r").unionAll(e.select("j", "r"))
    return e.groupBy("res").agg(F.sum("r").alias("centrality"))


def top_pairs(edges: DataFrame, k: int, apart: int = 8) -> DataFrame:
    """The k strongest pairs at least ``apart`` residues apart, ties to smaller i, j."""
    return edges.where(F.col("j") - F.col("i") >= apart).orderBy(F.col("r").desc(), "i", "j").limit(k)
