"""Approximate nearest neighbours with shifted space-filling curves.

For each of several curves the vectors are projected on a few seeded random directions, shifted, cut to a grid
and given their place on the Hilbert curve of that grid. As far as the width goes, the directions of neighbouring
curves are at right angles, so that curves repeat less of each other. A curve's order is cut into key ranges that hold about
the same number of rows; a query looks at the rows of its own range and of the two neighbouring ones, and
what it finds on all curves is merged and ranked by the exact inner product of the original vectors.

Curves order by direction alone, so rows are first cut into bands of norms, each ``BAND`` times the next at most, with
curves and range cuts of their own. Within a band rows get one more component, sqrt(M^2 - |x|^2) with M the band's
largest norm, and queries a zero there: all its rows are then of one length, and the largest inner product is the
nearest direction. Since norms of a band are alike, that component is small and rows stay spread. The bands of the
longest rows are searched first; a band whose M times the query's norm is below the k-th score found there is skipped,
which loses nothing.

The range cuts come from Spark's quantile sketch over all rows (bands x curves x ranges numbers on the driver, a fixed
bound). Rows are dealt by (band, curve, range, part of the rows, part of the queries): a range of more than ``PART_ROWS``
rows or ``PART_QUERIES`` queries has more parts, so that no task holds all of a range. Of rows with one and the same
vector only the k + 1 of smallest ids are dealt, since no other of them can be among k. Every other row is on every
curve. Vectors of single precision are moved as such. A band whose windows would come to as many pairs as all its rows
(few rows, or very many with one key) is searched whole instead, once and not by curves: no query is ever
scored against more rows than there are.

Recall rests on the share of rows that a query looks at. Uniformly random directions in 64 dimensions, which the
synthetic table holds, are the worst case for any index; the defaults are set for them. Data with structure
needs fewer curves and ranges that are a smaller share. Norms that spread over all bands make as many looks of a query
as there are bands which it cannot skip.

Defined cases: vectors that are null, all zero or hold null or non-finite components take no part; vectors of
different lengths are filled up with zeros; no row with the query's id is its candidate; repeated rows are
candidates each, but a repeated (id, vector) counts once; an empty table or query set gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .runtime import Scratch
from .textops import as_bytes, mix
from .vectors import matrix, usable, widen

CURVES = 40
DIMS = 9
BITS = 6
RANGES = 160
#: Ranges hold at least this many rows.
LEAST_ROWS = 64
#: Rows and queries of a range dealt to one part.
PART_ROWS = 16384
PART_QUERIES = 65536
#: Largest over smallest norm of a band, the most bands (all shorter rows are in the last), and the rows whose bands are searched first.
BAND = 1.25
BANDS = 24
FIRST_ROWS = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of grid cells (Skilling's transposed form), as integers of dims * bits bits."""
    x = cells.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@lru_cache(maxsize=4)
def directions(width: int, count: int, seed: int) -> np.ndarray:
    """(width, count) directions of length sqrt(width): sets of up to ``width`` at right angles, each turned at random."""
    r, sets = np.random.default_rng(seed), []
    for at in range(0, count, width):
        sets.append(np.linalg.qr(r.standard_normal((width, min(width, count - at))))[0])
    return np.concatenate(sets, 1) * width**0.5


def curve_keys(vecs: np.ndarray, curve: int, curves: int, dims: int, bits: int, seed: int, most: np.ndarray | float | None = None) -> np.ndarray:
    """Keys of vectors (taken at unit length) on one of ``curves`` curves: its own directions and shift.

    With ``most``, the largest norm of their band, the vectors are first made that long by one more component.
    """
    r = np.random.default_rng([seed, curve])
    way = directions(vecs.shape[1], curves * dims, seed)[:, curve * dims : (curve + 1) * dims]
    shift = r.random(dims)
    norm = np.sqrt((vecs * vecs).sum(1, keepdims=True))
    norm[norm == 0] = 1.0
    flat = (vecs / norm) @ way
    if most is not None:
        share = np.minimum(1.0, norm / most)
        flat = flat * share + np.sqrt(1 - share * share) * r.standard_normal(dims)
    grid = np.clip((flat / 8.0 + 0.5 + (shift - 0.5) / 4) * (1 << bits), 0, (1 << bits) - 1)
    return hilbert_keys(grid.astype(np.int64), bits)


def _vectors(column, kind: str, width: int) -> np.ndarray:
    """A column of packed vectors as a matrix of doubles."""
    data, offs = as_bytes(column)
    flat, size = np.frombuffer(data.tobytes(), kind).astype(np.float64), np.diff(offs) // np.dtype(kind).itemsize
    if (size == size[0]).all():
        return widen(flat.reshape(len(size), -1), width)
    out = np.zeros((len(size), max(width, int(size.max()))))
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def _search(q: pa.Table, x: pa.Table, k: int, kinds: tuple[str, str]) -> pa.Table:
    """The k best of the rows ``x`` for each query of ``q``; ties go to smaller ids."""
    own, found, score = [], [], []
    if q.num_rows and x.num_rows:
        a, b = _vectors(q.column("vec"), kinds[0], 1), _vectors(x.column("vec"), kinds[1], 1)
        width = max(a.shape[1], b.shape[1])
        a, b, ids, qid = widen(a, width), widen(b, width), x.column("vec_id").to_numpy(), q.column("vec_id").to_numpy()
        for i in range(0, len(a), 256):
            s = a[i : i + 256] @ b.T
            s[qid[i : i + 256, None] == ids[None, :]] = -np.inf
            # ties must fall to smaller ids: take all at or above the k-th value, then order
            m = min(k, s.shape[1])
            least = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
            r, c = np.nonzero((s >= least[:, None]) & np.isfinite(s))
            order = np.lexsort((ids[c], -s[r, c], r))
            r, c = r[order], c[order]
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
            place = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
            r, c = r[place < k], c[place < k]
            own.append(qid[i + r])
            found.append(ids[c])
            # one summation order for a pair of vectors, whichever block it is found in
            score.append(np.einsum("ij,ij->i", a[i + r], b[c]))
    join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
    return pa.table({"query_id": join(own, pa.int64()), "vec_id": join(found, pa.int64()), "score": join(score, pa.float64())})


def nearest(
    df: DataFrame,
    queries: DataFrame,
    *,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    curves: int = CURVES,
    dims: int = DIMS,
    bits: int = BITS,
    ranges: int = RANGES,
    seed: int = 11,
    part_rows: int = PART_ROWS,
    part_queries: int = PART_QUERIES,
    shares: list | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: about the k rows of largest inner product for each query.

    ``shares`` gets the pairs scored and the pairs there are, for each of the (one or two) steps of bands.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "ann")
    nonzero = F.exists("vec", lambda x: x != 0)
    kinds = tuple("f4" if isinstance(getattr(d.schema[vec_col].dataType, "elementType", None), FloatType) else "f8" for d in (queries, df))

    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    most, wide = usable(df, id_col, vec_col).where(nonzero).agg(F.max(length), F.max(F.size("vec"))).head()
    if not wide:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    band = F.when(F.col("norm") > 0, F.floor(F.log(F.lit(most) / F.col("norm")) / float(np.log(BAND)))).otherwise(BANDS - 1)
    once = usable(df, id_col, vec_col).where(nonzero).dropDuplicates(["vec_id", "vec"])
    equal = Window.partitionBy("vec").orderBy("vec_id")
    once = once.withColumn("place", F.row_number().over(equal)).where(F.col("place") <= k + 1).withColumn("norm", length)
    once = scratch.save(once.select("vec_id", "vec", "norm", F.greatest(F.lit(0), F.least(F.lit(BANDS - 1), band)).cast("int").alias("band")), "once")
    # one row for each band
    sizes = {r["band"]: (r["n"], r["top"]) for r in once.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}
    bands = sorted(sizes)

    def keyed(d: DataFrame, name: str, kind: str, lifted: bool) -> DataFrame:
        def place(batches):
            for b in batches:
                x, of = matrix(b.column(1)), b.column(2).to_numpy()
                for i in range(0, len(x), 4096):
                    part = x[i : i + 4096]
                    cut = np.ascontiguousarray(widen(part, wide)[:, :wide])  # what a query has beyond the rows' width counts nowhere
                    tops = np.array([sizes[o][1] for o in of[i : i + 4096]])[:, None] if lifted else None
                    keys = np.stack([curve_keys(cut, c, curves, dims, bits, seed, tops) for c in range(curves)], 1)
                    yield pa.RecordBatch.from_pydict(
                        {"vec_id": b.column(0).slice(i, len(part)), "vec": [v.tobytes() for v in part.astype(kind)], "keys": list(keys), "band": b.column(2).slice(i, len(part)), "norm": b.column(3).slice(i, len(part))},
                        schema=pa.schema([("vec_id", pa.int64()), ("vec", pa.binary()), ("keys", pa.list_(pa.int64())), ("band", pa.int32()), ("norm", pa.float64())]),
                    )

        return scratch.save(d.mapInArrow(place, "vec_id long, vec binary, keys array<long>, band int, norm double"), name)

    rows = keyed(once.select("vec_id", "vec", "band", "norm"), "rows", kinds[1], True)
    scratch.drop("once")
    asked = usable(queries, id_col, vec_col).where(nonzero).dropDuplicates(["vec_id", "vec"])
    asked = keyed(asked.select("vec_id", "vec", F.lit(0).alias("band"), length.alias("norm")), "queries", kinds[0], False)

    pieces = {o: max(1, min(ranges, n // LEAST_ROWS)) for o, (n, _) in sizes.items()}
    pieces = {o: 1 if 3 * curves >= p else p for o, p in pieces.items()}
    cuts = {o: [np.zeros(0, np.int64)] * curves for o in bands}
    for count in {p for p in pieces.values() if p > 1}:
        at = ", ".join(f"{i / count!r}D" for i in range(1, count))
        of = [o for o in bands if pieces[o] == count]
        for r in rows.where(F.col("band").isin(of)).groupBy("band").agg(*[F.expr(f"percentile_approx(keys[{c}], array({at}), 20000)").alias(f"c{c}") for c in range(curves)]).collect():
            cuts[r["band"]] = [np.array(r[f"c{c}"], np.int64) for c in range(curves)]

    def search(use: list[int], asked: DataFrame) -> DataFrame:
        """query_id, vec_id, score found in the bands ``use``; of ``asked`` those rows look at a band that can reach their score ``least``."""
        start = dict(zip(use, np.cumsum([0, *(curves * pieces[o] for o in use)])[:-1], strict=True))
        total = sum(curves * pieces[o] for o in use)

        def places(batch, step: int):
            """Rows of a batch that have a place in each range of each curve of their bands, and that place; with ``step`` also the neighbouring ones.

            A band in one piece has no curves: one place holds it all.
            """
            keys = batch.column("keys").flatten().to_numpy().reshape(batch.num_rows, curves)
            own, norm = batch.column("band").to_numpy(), batch.column("norm").to_numpy()
            for o in use:
                if step:
                    there = np.flatnonzero(norm * sizes[o][1] * (1 + 1e-9) >= batch.column("least").to_numpy(zero_copy_only=False))
                else:
                    there = np.flatnonzero(own == o)
                if not len(there):
                    continue
                if pieces[o] == 1:
                    yield there, np.full(len(there), start[o])
                    continue
                for c in range(curves):
                    place = np.searchsorted(cuts[o][c], keys[there, c], side="right")
                    for d in range(-step, step + 1):
                        fits = (place + d >= 0) & (place + d < pieces[o])
                        yield there[fits], start[o] + c * pieces[o] + place[fits] + d

        def counted(d: DataFrame, step: int) -> np.ndarray:
            """How many rows each place has; at most bands x curves x ranges numbers come to the driver."""

            def run(batches):
                got = np.zeros(total, np.int64)
                for b in batches:
                    for _, cell in places(b, step):
                        got += np.bincount(cell, minlength=total)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(np.flatnonzero(got), pa.int64()), "n": pa.array(got[got > 0], pa.int64())})

            out = np.zeros(total, np.int64)
            for r in d.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
                out[r["cell"]] = r["n"]
            return out

        here = rows.where(F.col("band").isin(use))
        each = [counted(here, 0), counted(asked, 1)]
        whole = []
        for o in use:
            span = slice(start[o], start[o] + curves * pieces[o])
            looks = each[1][span].sum() / curves / 3 if pieces[o] > 1 else each[1][span].sum()
            if pieces[o] > 1 and (each[0][span] * each[1][span]).sum() > sizes[o][0] * looks:
                whole.append(o)
        if whole:
            for o in whole:
                pieces[o] = 1
            return search(use, asked)
        if shares is not None:
            shares.append((int((each[0] * each[1]).sum()), sum(n for n, _ in sizes.values()) * asked.count()))
        parts = [np.maximum(1, -(-each[0] // part_rows)), np.maximum(1, -(-each[1] // part_queries))]

        def deal(step: int, own: np.ndarray, other: np.ndarray, names: tuple[str, str]):
            """A row for each place and each part of the other side there; its own part follows from its id."""

            def run(batches):
                for b in batches:
                    code = mix(b.column("vec_id").to_numpy().view(np.uint64))
                    for use, cell in places(b, step):
                        mine = (code[use] % own[cell].astype(np.uint64)).astype(np.int32)
                        times = other[cell]
                        theirs = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        use, cell, mine = np.repeat(use, times), np.repeat(cell, times), np.repeat(mine, times)
                        for i in range(0, len(use), 4096):
                            part, cols = slice(i, i + 4096), {}
                            cols["cell"] = pa.array(cell[part], pa.int64())
                            cols[names[0]], cols[names[1]] = pa.array(mine[part], pa.int32()), pa.array(theirs[part], pa.int32())
                            cols["vec_id"], cols["vec"] = b.column("vec_id").take(pa.array(use[part])), b.column("vec").take(pa.array(use[part]))
                            yield pa.RecordBatch.from_pydict({c: cols[c] for c in ("cell", "row_part", "query_part", "vec_id", "vec")})

            return run

        schema, by = "cell long, row_part int, query_part int, vec_id long, vec binary", ("cell", "row_part", "query_part")
        cells = here.mapInArrow(deal(0, parts[0], parts[1], ("row_part", "query_part")), schema)
        looks = asked.mapInArrow(deal(1, parts[1], parts[0], ("query_part", "row_part")), schema)
        found = looks.groupBy(*by).cogroup(cells.groupBy(*by)).applyInArrow(lambda q, x: _search(q, x, k, kinds), "query_id long, vec_id long, score double")
        return found.groupBy("query_id", "vec_id", "score").agg(F.lit(1).alias("one")).drop("one")

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = lambda d: d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    upto = next(i for i, n in enumerate(np.cumsum([sizes[o][0] for o in bands])) if n >= FIRST_ROWS or i == len(bands) - 1) + 1
    first, rest = bands[:upto], bands[upto:]
    asked = asked.withColumn("least", F.lit(float("-inf")))
    found = search(first, asked)
    if rest:
        found = scratch.save(best(found).drop("rank"), "first")
        least = found.groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("have")).where(F.col("have") >= k)
        asked = asked.drop("least").join(least.select("query_id", "worst"), F.col("vec_id") == F.col("query_id"), "left")
        asked = scratch.save(asked.select("vec_id", "vec", "keys", "band", "norm", F.coalesce("worst", F.lit(float("-inf"))).alias("least")), "asked")
        found = found.unionByName(search(rest, asked)).dropDuplicates(["query_id", "vec_id", "score"])
    return best(found).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
