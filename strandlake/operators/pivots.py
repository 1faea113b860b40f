"""A saved index for searches by writhe spectrum, or by Frechet distance, that reads only what can be near.

A few pivot frames are chosen from a bounded sample; every frame is stored with its distances to them. By the triangle
inequality a frame within r of a query has each of these distances within r of the query's own, so a search is a
filter on plain Parquet columns first: files are cut by ranges of the first pivot's distance and ordered by it, and
the filter reaches the scan. Only what passes all pivots reaches the spectrum or curve. A search for the k nearest first finds
a radius that holds k frames, in a narrow range of the first distance, and then asks for that radius.

The distance of spectra is the root mean square difference over the common length, a metric among spectra of one length. Frames
whose spectra have another length than most are kept apart and always scanned; a query of such a length scans all.
The Frechet distance is a metric of curves of any lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vec as v
from . import curves
from .metrics import Metric
from .metrics import metric as named

PIVOTS = 8
#: Frames of the sample that pivots come from, those of smallest hash.
SAMPLE = 2048
#: Frames of a cell of the first distance, the most cells, about how many frames of a cell give a first radius, and those of a part of a join.
CELL_ROWS, CELLS, SEEDS, PART_ROWS = 2048, 1024, 256, 65536
ROW_GROUP = 1 << 20
_SLACK = 1e-9
_BROADCAST = 16 << 20


def _spectra(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, ((a[:, None, :] - b[None]) ** 2).mean(2))) if a.shape[1] else np.zeros((len(a), len(b)))


def _cell(distance: Column, cuts: list[float]) -> Column:
    """How many cuts are at most ``distance``: a cell's number, without Python workers beside those of the searches."""
    return F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c <= distance))


def choose(sample: list[tuple], count: int, of: Metric) -> list[tuple]:
    """Frames far from each other: the one farthest from the sample's first, then always that farthest from those chosen."""
    at = [int(of.between(sample, sample[:1]).ravel().argmax())]
    near = of.between(sample, [sample[at[0]]]).ravel()
    while len(at) < min(count, len(sample)) and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, of.between(sample, [sample[at[-1]]]).ravel())
    return [sample[i] for i in at]


def build(index: DataFrame, path: str, pivots: int = PIVOTS, sample: int = SAMPLE, cell_rows: int = CELL_ROWS, written: bool = False, metric: Metric | None = None) -> PivotIndex:
    """Write the table of :func:`search.build_index` with its pivots below ``path``, replacing what is there, and open it.

    The table is read several times, so it is written first, unless it is ``written`` already.
    """
    spark, frames, of = index.sparkSession, index, metric or named("writhe")
    if not of.triangle:
        raise ValueError(f"{of.name} does not obey the triangle inequality")
    if not written:
        index.write.mode("overwrite").parquet(f"{path}/frames")
        frames = spark.read.schema(index.schema).parquet(f"{path}/frames")
    sizes = frames.groupBy(of.size().alias("m")).count().orderBy(F.col("count").desc(), "m").limit(1).collect()
    length = sizes[0]["m"] if sizes else 0
    even = of.size() == length
    few = frames.where(even).select(*of.arrays, F.xxhash64("frame_id").alias("h"), "frame_id").orderBy("h", "frame_id").limit(sample).collect()
    chosen = choose([of.of(r) for r in few], pivots, of) if few else [tuple(np.zeros(length) for _ in of.arrays)]
    names = [f"p{k}" for k in range(len(chosen))]
    kept = frames
    for n, p in zip(names, chosen, strict=True):
        kept = of.column(kept, n, p)
    kept = kept.withColumn("even", even).withColumns({n: F.when(F.col("even"), F.col(n)) for n in names})
    if of.name != "writhe":  # programmes that should not run again for each pass below
        kept.write.mode("overwrite").parquet(f"{path}/distances")
        kept = spark.read.schema(kept.schema).parquet(f"{path}/distances")
    n = frames.count()
    cells = max(1, min(CELLS, n // cell_rows))
    marks = kept.where("even").agg(F.percentile_approx("p0", F.lit([i / cells for i in range(1, cells)]), 20000)).head()[0] if cells > 1 else []
    cuts = sorted(set(marks or []))

    kept = kept.withColumn("cell", F.when(F.col("even"), _cell(F.col("p0"), cuts)))
    # of each cell about SEEDS frames by a hash, or all: a share that follows from how many it has, so no frames of a cell meet for it
    sizes = F.broadcast(kept.where("even").groupBy(F.col("cell").alias("_of")).agg(F.count("*").alias("_n")))  # at most CELLS rows
    drawn = F.pmod(F.xxhash64("frame_id"), F.lit(1 << 20)) * F.col("_n") < SEEDS << 20
    kept = kept.join(sizes, F.col("cell") == F.col("_of"), "left").withColumn("seed", F.col("even") & F.coalesce(drawn, F.lit(False))).drop("_of", "_n")
    kept = kept.repartitionByRange(max(1, n // (16 * cell_rows) + 1), "p0", *names[1:2], "frame_id").sortWithinPartitions("even", "p0", "frame_id")
    kept.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).partitionBy("even").parquet(f"{path}/pivoted")
    spark.createDataFrame([(k, [a.tolist() for a in p]) for k, p in enumerate(chosen)], "k int, arrays array<array<double>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "even")
    spark.createDataFrame([(length, [float(c) for c in cuts], f"{kinds}, even boolean", of.name, list(of.weights))], "length int, cuts array<double>, kinds string, metric string, weights array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return PivotIndex.open(spark, path)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    a = column.combine_chunks()
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(a), -1) if len(a) else np.zeros((0, 0))


def _near_pairs(k: int, pivots: int):
    """For queries and frames that meet: of each query's frames that pass all pivots, the k nearest within its limit."""

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if q.num_rows and x.num_rows:
            a, b = _matrix(q.column("q_writhe")), _matrix(x.column("writhe"))
            own, there = (np.stack([t.column(f"{n}{p}").to_numpy() for p in range(pivots)], 1) for t, n in ((q, "q"), (x, "p")))
            ids, asked, reach, limit = x.column("frame_id").to_numpy(), q.column("query_id").to_numpy(), q.column("reach").to_numpy(), q.column("limit").to_numpy()
            step = max(1, curves.PAIR_BYTES // (8 * len(b)))
            for i in range(0, len(a), step):
                near = asked[i : i + step, None] != ids[None, :]
                for p in range(pivots):
                    near &= np.abs(own[i : i + step, p, None] - there[None, :, p]) <= reach[i : i + step, None]
                r, c = np.nonzero(near)
                for at in range(0, len(r), 1 << 18):  # few of these pairs stay, so their differences are made in parts
                    rr, cc = r[at : at + (1 << 18)], c[at : at + (1 << 18)]
                    d = np.sqrt(((a[i + rr] - b[cc]) ** 2).mean(1)) if a.shape[1] else np.zeros(len(rr))
                    good = d <= limit[i + rr]
                    rr, cc, d = rr[good], cc[good], d[good]
                    order = np.lexsort((ids[cc], d, rr))
                    rr, cc, d = rr[order], cc[order], d[order]
                    head = np.flatnonzero(np.r_[True, rr[1:] != rr[:-1]]) if len(rr) else np.zeros(0, int)
                    place = np.arange(len(rr)) - np.repeat(head, np.diff(np.r_[head, len(rr)]))
                    use = place < k
                    found.append((asked[i + rr[use]], ids[cc[use]], d[use]))
        cols = [np.concatenate([f[j] for f in found]) if found else np.zeros(0) for j in range(3)]
        made = pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "frame_id", "writhe_distance"), cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)})
        if made.num_rows > k:  # a query's pairs may have come in several parts
            made = made.sort_by([("query_id", "ascending"), ("writhe_distance", "ascending"), ("frame_id", "ascending")])
            own = made.column("query_id").to_numpy()
            head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            place = np.arange(len(own)) - np.repeat(head, np.diff(np.r_[head, len(own)]))
            made = made.filter(pa.array(place < k))
        return made

    return run


@dataclass
class PivotIndex:
    """Queries are the arrays of the index's metric as a tuple; of a spectrum also the array alone."""

    spark: SparkSession
    frames: DataFrame
    pivots: list[tuple]
    length: int
    cuts: list[float]
    metric: Metric

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PivotIndex:
        about = spark.read.parquet(f"{path}/about").head()
        rows = spark.read.parquet(f"{path}/pivots").orderBy("k").collect()  # a few pivots
        of = named(about["metric"], tuple(about["weights"]))
        return cls(spark, spark.read.schema(about["kinds"]).parquet(f"{path}/pivoted"), [tuple(np.array(a, float) for a in r["arrays"]) for r in rows], about["length"], about["cuts"], of)

    @property
    def names(self) -> list[str]:
        return [f"p{k}" for k in range(len(self.pivots))]

    def item(self, frame_id: int) -> tuple[np.ndarray, ...]:
        """The arrays of a frame that the metric compares."""
        got = self.frames.where(F.col("frame_id") == frame_id).select(*self.metric.arrays).head()
        if got is None:
            raise ValueError(f"the index has no frame {frame_id}")
        return self.metric.of(got)

    def spectrum(self, frame_id: int) -> np.ndarray:
        return self.item(frame_id)[0]

    def _own(self, query) -> tuple[tuple, np.ndarray | None]:
        """The query as a tuple, and its distances to the pivots if these tell something of it."""
        query = query if isinstance(query, tuple) else (np.asarray(query, float),)
        return query, self.metric.between([query], self.pivots)[0] if self.metric.length(query) == self.length else None

    def candidates(self, query, radius: float) -> DataFrame:
        """Frames that the pivots cannot tell to be farther than ``radius``; those of other lengths too."""
        query, own = self._own(query)
        if own is None:
            return self.frames
        slack = radius + _SLACK * (1 + radius + own.max(initial=0))
        near = F.col("even")
        for name, d in zip(self.names, own, strict=True):
            near &= F.col(name).between(float(d - slack), float(d + slack))
        return self.frames.where(near | ~F.col("even")) if self.uneven() else self.frames.where(near)

    def uneven(self) -> bool:
        """Whether there are frames of other lengths (their files are a partition of their own)."""
        return bool(self.frames.where("NOT even").select("frame_id").head(1))

    def _far(self, frames: DataFrame, query: tuple) -> DataFrame:
        return self.metric.column(frames, self.distance, query)

    @property
    def distance(self) -> str:
        return f"{self.metric.name}_distance"

    def within(self, query, radius: float) -> DataFrame:
        """All columns and the distance (``writhe_distance`` or ``frechet_distance``) of the frames within ``radius``."""
        query, _ = self._own(query)
        return self._far(self.candidates(query, radius), query).where(F.col(self.distance) <= radius)

    def radius(self, query, k: int) -> float:
        """A distance within which k frames are, or infinity if there are fewer: from cells around the query's, more of them until there are k."""
        query, own = self._own(query)
        if own is None:
            return float("inf")
        at = int(np.searchsorted(self.cuts, own[0], side="right"))
        step = 1
        while True:
            lo, hi = at - step, at + step
            near = self.frames.where(F.col("even") & F.col("cell").between(lo, hi))
            got = self._far(near, query).select(self.distance).orderBy(self.distance).limit(k).collect()  # k numbers
            if len(got) == k:
                return got[-1][0]
            if lo <= 0 and hi >= len(self.cuts):
                return float("inf")
            step *= 4

    def nearest(self, query, k: int) -> DataFrame:
        """frame_id and distance of the k nearest, ties to smaller ids: the same as a scan of all frames."""
        query, _ = self._own(query)
        r = self.radius(query, k)
        found = self.within(query, r) if np.isfinite(r) else self._far(self.frames, query)
        return found.orderBy(self.distance, "frame_id").limit(k).select("frame_id", self.distance)

    def conformers(self, spectrum: np.ndarray, kappa: list[float], tau: list[float], k: int, coarse_radius: float = 0.5) -> DataFrame:
        """As :func:`search.nearest`: least Frechet distance among those within ``coarse_radius``, or among the 3 k nearest if these are fewer than k."""
        near = self.within(spectrum, coarse_radius)
        if len(near.select("frame_id").head(k)) < k:
            r = self.radius(spectrum, 3 * k)
            near = self.within(spectrum, r) if np.isfinite(r) else self._far(self.frames, (np.asarray(spectrum, float),))
            near = near.orderBy("writhe_distance", "frame_id").limit(3 * k)
        asked = [F.lit([float(x) for x in a]).cast("array<double>").alias(n) for n, a in (("q_kappa", kappa), ("q_tau", tau))]
        near = curves.distances(near.select("frame_id", "writhe_distance", "kappa", "tau", *asked), "frechet", "frechet", ["q_kappa", "q_tau"], ["kappa", "tau"])
        return near.orderBy("frechet", "writhe_distance", "frame_id").limit(k).select("frame_id", "frechet", "writhe_distance")

    def nearest_of(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rank, frame_id, writhe_distance: the k nearest frames other than itself of each row (query_id, writhe) of ``queries``.

        Queries meet the seeds of their cell, which gives each a radius; then the cells within that radius. A cell of many
        frames or queries is cut into parts by hashes of their ids, and all parts of one meet all of the other; of each such
        meeting at most k frames a query go on. Queries without a radius meet all cells, and those of another length than the
        index's all frames.
        """
        if self.metric.name != "writhe":
            raise ValueError("many queries are asked by spectra")
        names, cuts, length = self.names, self.cuts, self.length
        pivots = np.stack([p[0] for p in self.pivots])
        kinds = ", ".join([*(f"q{k} double" for k in range(len(pivots))), "q_cell int"])

        def placed(batches):
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    d = b.slice(at, 1024)
                    own = _spectra(d.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(d.num_rows, -1), pivots)
                    cell = np.searchsorted(cuts, own[:, 0], side="right").astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*d.columns, *map(pa.array, own.T.copy()), pa.array(cell)], names=[*d.schema.names, *(f"q{k}" for k in range(len(pivots))), "q_cell"])

        asked = queries.select("query_id", F.col("writhe").alias("q_writhe"))
        even = asked.where(F.size("q_writhe") == length)
        q = even.mapInArrow(placed, f"query_id long, q_writhe array<double>, {kinds}")
        seeds = self.frames.where("even AND seed").select("cell", "frame_id", "writhe", *names)
        wide = q.withColumns({"reach": F.lit(float("inf")), "limit": F.lit(float("inf"))})
        pair, out = _near_pairs(k, len(pivots)), "query_id long, frame_id long, writhe_distance double"
        first = wide.groupBy("q_cell").cogroup(seeds.groupBy("cell")).applyInArrow(pair, out)
        first = first.groupBy("query_id").agg(F.max("writhe_distance").alias("r"), F.count("*").alias("have")).where(F.col("have") == k)
        q = q.join(first.select(F.col("query_id").alias("_q"), "r"), F.col("query_id") == F.col("_q"), "left").drop("_q")

        reach = F.col("r") + _SLACK * (1 + F.col("r") + F.greatest(F.lit(0.0), *[F.col(f"q{k}") for k in range(len(pivots))]))
        q = q.withColumns({"reach": F.coalesce(reach, F.lit(float("inf"))), "limit": F.coalesce("r", F.lit(float("inf")))})
        ends = q.withColumn("lo", _cell(F.col("q0") - F.col("reach"), cuts)).withColumn("hi", _cell(F.col("q0") + F.col("reach"), cuts))
        parts = self.frames.where("even").groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
        parts = F.broadcast(parts.select(F.col("cell").alias("of"), "parts"))  # at most CELLS rows
        spread = ends.withColumn("at", F.explode(F.sequence("lo", "hi"))).join(parts, F.col("at") == F.col("of")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("of")
        rows = self.frames.where("even").join(parts, F.col("cell") == F.col("of")).withColumn("part", F.pmod(F.xxhash64("frame_id"), F.col("parts")).cast("int"))
        rows = rows.select("cell", "part", "frame_id", "writhe", *names)
        # queries of a cell go in parts as well, each to all parts of the frames
        many = F.broadcast(spread.groupBy(F.col("at").alias("of")).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("q_parts")))
        spread = spread.join(many, F.col("at") == F.col("of")).withColumn("q_part", F.pmod(F.xxhash64("query_id"), F.col("q_parts")).cast("int")).drop("of")
        many = F.broadcast(many.toDF("x_of", "x_parts"))
        rows = rows.join(many, F.col("cell") == F.col("x_of")).select(*rows.columns, F.explode(F.sequence(F.lit(0), F.col("x_parts") - 1)).alias("q_part"))
        found = spread.groupBy("at", "part", "q_part").cogroup(rows.groupBy("cell", "part", "q_part")).applyInArrow(pair, out)
        if self.uneven():
            found = found.unionAll(self._scanned(even, self.frames.where("NOT even")))
        if asked.where(F.size("q_writhe") != length).head(1):
            found = found.unionAll(self._scanned(asked.where(F.size("q_writhe") != length), self.frames))
        order = Window.partitionBy("query_id").orderBy("writhe_distance", "frame_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "frame_id", "writhe_distance")

    @staticmethod
    def _scanned(asked: DataFrame, rows: DataFrame) -> DataFrame:
        """All pairs of the odd lengths, met through 64 x 64 blocks of both sides, so that neither is held whole."""
        side = F.sequence(F.lit(0), F.lit(63))
        a = asked.withColumn("_i", F.pmod(F.xxhash64("query_id"), F.lit(64)).cast("int")).withColumn("_j", F.explode(side))
        b = rows.select("frame_id", "writhe", F.pmod(F.xxhash64("frame_id"), F.lit(64)).cast("int").alias("_j")).withColumn("_i", F.explode(side))
        return a.join(b, ["_i", "_j"]).where(F.col("frame_id") != F.col("query_id")).select("query_id", "frame_id", v.spectrum_distance(F.col("writhe"), F.col("q_writhe")).alias("writhe_distance"))
