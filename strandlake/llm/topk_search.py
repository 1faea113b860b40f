"""Exact top-k search by distributed histogram selection.

All rows are scored against all queries in blocks. In each round every task counts its scores in equal bins of
each query's open range; the summed counts (queries x bins rows, reduced in each task first) tell in which bin
the k-th largest score lies, and that bin is the next round's range. When a query's bin holds few enough
scores, or is one score wide, its bound is known. A last pass keeps scores at or above the bound, of which each
task needs at most its own k best in the final order, and a ranking over these breaks ties by id.

Queries are dealt to blocks of about ``query_block`` (twice that at most) by a hash of their ids, each a folder of the
written query table; a block and its bounds (a few hundred bytes a query) are what the driver and the tasks hold. The
passes over the rows, each a job over all of them, are as many as blocks times rounds.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors of different
lengths are filled up with zeros; repeated ids are rows of their own, though no row with the query's id is its
candidate; an empty table or one without queries gives no rows; fewer than k candidates give all of them.
Scores are exact integers: where a block's norms allow more than 2**53 they are computed in integers of 64 bits, and
beyond 2**61 in Python's; what is larger than that in size counts as 2**61 with its sign, and a scaled component
beyond 64 bits as the largest integer of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch
from .vectors import matrix, usable, widen

BINS = 512
QUERY_BLOCK = 2048
#: Scores held at a time in a task.
CELLS = 1 << 20
#: Scores of more than this count as this.
MOST = 1 << 61


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products (queries x rows) of integers held as doubles."""
    bound = np.sqrt((q * q).sum(1).max(initial=0)) * np.sqrt((x * x).sum(1).max(initial=0))
    if bound < 2**53:
        return np.rint(q @ x.T).astype(np.int64)
    out = np.empty((len(q), len(x)), np.int64)
    big = np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum(1).max(initial=0))  # rows by what their scores can come to
    for use, kind in ((big < 2**53, None), ((big >= 2**53) & (big < MOST), np.int64), (~(big < MOST), object)):
        rows = x[use]
        if not len(rows):
            continue
        if kind is None:
            out[:, use] = np.rint(q @ rows.T).astype(np.int64)
        elif kind is np.int64:
            out[:, use] = np.clip(q, -MOST, MOST).astype(np.int64) @ rows.astype(np.int64).T
        else:
            whole = lambda a: np.array([[int(v) for v in r] for r in a], object).reshape(a.shape)
            got = whole(q) @ whole(rows).T
            out[:, use] = np.clip(got, -MOST, MOST).astype(np.int64)
    return out


def _scored(batches: Iterator[pa.RecordBatch], q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and the block of integer scores (queries x rows) of every slice of rows."""
    step = max(1, CELLS // max(1, len(q)))
    for b in batches:
        ids, x = b.column(0).to_numpy(), matrix(b.column(1))
        width = max(x.shape[1], q.shape[1])
        own, rows = widen(q, width), widen(x, width)
        for i in range(0, len(ids), step):
            yield ids[i : i + step], _products(own, rows[i : i + step])


def exact_top_k(df: DataFrame, queries: DataFrame, *, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, bins: int = BINS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of ``df`` of largest integer inner product for each query.

    Components count as ``floor(scale * x)``. Ties go to the smaller id. A row is no candidate of a query with the same id.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    scaled = lambda d: usable(d, id_col, vec_col).select("vec_id", F.transform("vec", lambda x: F.floor(x * scale).cast("double")).alias("vec"))
    rows = scaled(df)
    # blocks follow from the ids alone, so their number is that of the queries, however these are stored
    counted = scratch.save(scaled(queries), "counted")
    blocks = -(-counted.count() // query_block)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("block").orderBy("vec_id")) - 1
    asked = counted.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    # queries of one id are one block by the hash: what is beyond a block's size goes on to further ones
    asked = asked.withColumn("more", F.floor(place / (2 * query_block)).cast("int")) if blocks > 1 else asked.withColumn("more", F.lit(0))
    asked.write.mode("overwrite").partitionBy("more", "block").parquet(f"{scratch.base}/queries")
    asked = spark.read.schema("vec_id long, vec array<double>, more int, block int").parquet(f"{scratch.base}/queries")
    scratch.drop("counted")
    groups = sorted(tuple(r) for r in asked.select("more", "block").distinct().collect())  # from the folders' names
    bound_of_rows = rows.select(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("n")).agg(F.max("n")).head()[0]
    out = None
    for k_, (more, block) in enumerate(groups):
        held = [(r["vec_id"], r["vec"]) for r in asked.where((F.col("more") == more) & (F.col("block") == block)).select("vec_id", "vec").collect()]
        found = scratch.save(_group(rows, held, float(bound_of_rows or 0.0), k, bins), f"found-{k_}")
        out = found if out is None else out.unionAll(found)
    return out


def _group(rows: DataFrame, asked: list, row_norm: float, k: int, bins: int) -> DataFrame:
    spark = rows.sparkSession
    qid = np.array([a for a, _ in asked], np.int64)
    q = np.zeros((len(asked), max((len(v) for _, v in asked), default=0)))
    for i, (_, v) in enumerate(asked):
        q[i, : len(v)] = v
    most = np.sqrt((q * q).sum(1)) * row_norm
    most = np.nan_to_num(most, nan=0.0)  # a zero vector against an endless one
    low = -np.ceil(np.minimum(most * (1 + 1e-9), MOST)).astype(np.int64) - 1  # a query's open range is [low, low + width * bins)
    width = np.maximum(1, -(-(1 - 2 * low) // bins))
    end = low + width * bins  # exclusive; a refined range ends with the bin it came from, even if its bins reach further
    above = np.zeros(len(qid), np.int64)  # scores at or beyond the end
    bound = low.copy()
    open_ = np.ones(len(qid), bool)
    n = len(qid)
    while open_.any():
        at = np.flatnonzero(open_)
        shared = spark.sparkContext.broadcast((qid[at], q[at], low[at], end[at], width[at]))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vecs, lo, hi, wide = shared.value
            total = np.zeros(len(ids) * bins, np.int64)
            base = (np.arange(len(ids)) * bins)[:, None]
            for own, s in _scored(batches, vecs):
                slot = (s - lo[:, None]) // wide[:, None]
                use = (s >= lo[:, None]) & (s < hi[:, None]) & (ids[:, None] != own[None, :])
                total += np.bincount((slot + base)[use], minlength=len(total))
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(full, pa.int64()), "n": pa.array(total[full], pa.int64())})

        cells = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        table = np.zeros((len(at), bins), np.int64)
        table.reshape(-1)[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
        shared.unpersist()
        down = np.cumsum(table[:, ::-1], axis=1)[:, ::-1]  # scores in this bin or a higher one
        for j, i in enumerate(at):
            need = k - above[i]
            reach = np.flatnonzero(down[j] >= need)
            if not len(reach):  # fewer candidates than k
                bound[i], open_[i] = low[i], False
                continue
            b = int(reach[-1])
            bound[i] = low[i] + b * width[i]
            if width[i] == 1 or above[i] + down[j, b] <= 4 * k:
                open_[i] = False
                continue
            above[i] += down[j, b + 1] if b + 1 < bins else 0
            low[i], end[i] = bound[i], bound[i] + width[i]
            width[i] = max(1, -(-width[i] // bins))
    shared = spark.sparkContext.broadcast((qid, q, bound))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, least = shared.value
        have = [np.zeros(0, np.int64)] * 3
        for own, s in _scored(batches, vecs):
            i, j = np.nonzero((s >= least[:, None]) & (ids[:, None] != own[None, :]))
            have = [np.concatenate(x) for x in zip(have, (i, own[j], s[i, j]), strict=True)]
            if len(have[0]) > 4 * k * len(ids):
                have = _best(have, k)
        have = _best(have, k)
        yield pa.RecordBatch.from_pydict({"query_id": ids[have[0]], "vec_id": have[1], "score": have[2], "row": pa.array(have[0].astype(np.int64))})

    found = rows.mapInArrow(keep, "query_id long, vec_id long, score long, row long")
    by = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _best(have: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best (largest score, then smallest id) of each query."""
    if not len(have[0]):
        return have
    order = np.lexsort((have[1], -have[2], have[0]))
    row = have[0][order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    order = order[place < k]
    return [x[order] for x in have]


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
