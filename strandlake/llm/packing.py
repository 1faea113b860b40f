"""Variable-capacity best-fit packing of documents into training sequences.

Lengths are words. A document longer than the longest permitted sequence is cut into pieces of that length and a
rest; every other document stays whole. Only ids and sizes are dealt out: rows of one id and size are counted before
they move, and go to shards of about ``shard_rows`` by a hash of both, copies to one shard after the other. So a
shard's rows are bounded at any input size and with any copies (of a single document's pieces a shard holds all), and reruns agree. In a shard pieces go from long
to short, each into the open sequence that it fills best. Where none has room, a new one is opened: for every
permitted length the sequence is filled on trial from the lengths that are left, and the length with the least
cost for each word it would hold is taken. At the end each sequence is cut down to the smallest permitted length
that holds its contents. The cost of a sequence of n words, ``n + n * n / (4 * longest)``, stands for the linear
and the quadratic part of a training step.

Defined cases: a null or empty text has one row with length 0 and no sequence; repeated rows are packed each; ids may
be null and are given back bit for bit; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mixing import size_of
from .runtime import Scratch

CAPACITIES = (512, 1024, 2048, 4096)
SHARD_ROWS = 20000
SCHEMA = "doc_id long, piece int, start long, length long, shard long, sequence long, capacity int, offset int"


def cost(n: int, longest: int) -> float:
    return n + n * n / (4 * longest)


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces of lengths 1 .. max(capacities): each one's sequence and offset, and the sequences' capacities."""
    caps = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    distinct, counts = np.unique(lengths, return_counts=True)
    distinct, counts = distinct.tolist(), counts.tolist()
    seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: dict[int, list[int]] = {}  # open sequences by what is left in them
    rooms: list[int] = []
    used: list[int] = []
    cap: list[int] = []

    def trial(c: int, first: int, at: int) -> float:
        """Words that a sequence of capacity c would hold if filled with the longest pieces that are left and fit."""
        left, hi, own = c - first, at + 1, counts[at] - 1
        while left and hi:
            j = bisect_right(distinct, left, 0, hi) - 1
            if j < 0:
                break
            have = own if j == at else counts[j]
            left -= min(have, left // distinct[j]) * distinct[j]
            hi = j
        return c - left

    at = len(distinct) - 1
    for i in order.tolist():
        n = int(lengths[i])
        while distinct[at] != n:
            at -= 1
        k = bisect_left(rooms, n)
        if k < len(rooms):
            left = rooms[k]
            stack = room[left]
            s = stack.pop()
            if not stack:
                del room[left], rooms[k]
        else:
            s, left = len(used), min((c for c in caps if c >= n), key=lambda c: (cost(c, caps[-1]) / trial(c, n, at), c))
            used.append(0)
            cap.append(left)
        counts[at] -= 1
        seq[i], off[i] = s, used[s]
        used[s] += n
        left -= n
        if left:
            if left not in room:
                rooms.insert(bisect_left(rooms, left), left)
                room[left] = []
            room[left].append(s)
    fitted = np.array(caps, np.int64)[np.searchsorted(caps, used)] if used else np.zeros(0, np.int64)
    return seq, off, fitted


def pack(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each piece: doc_id, piece, start (word of the document), length, shard, sequence, capacity, offset."""
    longest = max(capacities)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), size_of(F.col(text_col)).alias("size")).groupBy("doc_id", "size").agg(F.count("*").alias("n"))
    rows = Scratch(df.sparkSession, "pack").save(rows, "sizes")
    shards = max(1, -(-(rows.agg(F.sum("n")).head()[0] or 0) // shard_rows))
    # copies take turns: shard k of the row's own order gets a copy of every `shards`
    turn = F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(shards)) - 1))
    rows = rows.select("doc_id", "size", "n", F.pmod(F.xxhash64("doc_id", "size"), F.lit(shards)).alias("first"), turn.alias("k"))
    rows = rows.select("doc_id", "size", ((F.col("n") - F.col("k") + shards - 1) / shards).cast("long").alias("copies"), F.pmod(F.col("first") + F.col("k"), F.lit(shards)).alias("shard"))

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        copies = np.repeat(np.arange(part.num_rows), part.column("copies").to_numpy())
        ids, size = part.column("doc_id").combine_chunks().take(pa.array(copies)), part.column("size").to_numpy()[copies]
        order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), -size))
        ids, size = ids.take(pa.array(order)), size[order]
        pieces = np.maximum(1, -(-size // longest))
        row = np.repeat(np.arange(len(size)), pieces)
        number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = number * longest
        length = np.minimum(longest, size[row] - start)
        real = length > 0
        seq, off, cap = best_fit(length[real], capacities)
        s, c, o = (np.zeros(len(row), np.int64) for _ in range(3))
        s[real], c[real], o[real] = seq, cap[seq] if len(seq) else seq, off
        placed = lambda x, kind: pa.array(x, kind, mask=~real)
        return pa.table({"doc_id": ids.take(pa.array(row)), "piece": pa.array(number, pa.int32()), "start": start, "length": length, "shard": pa.array(np.full(len(row), key[0].as_py()), pa.int64()), "sequence": placed(s, pa.int64()), "capacity": placed(c, pa.int32()), "offset": placed(o, pa.int32())})

    return rows.groupBy("shard").applyInArrow(run, SCHEMA)


def coverage(packed: DataFrame, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """doc_id, words, pieces, valid of a packing: what each document has in it, and whether all of its pieces are where they may be.

    A piece is valid if it begins where the piece before it in its sequence ends, the sequence's capacity is the smallest that holds its
    pieces, and the document's pieces follow each other from its first word on. Rows of one id count together, in the order of their pieces.
    """
    caps = F.array(*[F.lit(c) for c in sorted(capacities)])
    inside = Window.partitionBy("shard", "sequence").orderBy("offset", "length").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("shard", "sequence")
    placed = packed.where("sequence IS NOT NULL").withColumn("_at", F.coalesce(F.sum("length").over(inside), F.lit(0))).withColumn("_used", F.sum("length").over(whole))
    fits = (F.col("offset") == F.col("_at")) & (F.col("capacity") == F.array_min(F.filter(caps, lambda c: c >= F.col("_used"))))
    rows = placed.select("doc_id", "piece", "start", "length", fits.alias("fits")).unionByName(packed.where("sequence IS NULL").select("doc_id", "piece", "start", "length", (F.col("length") == 0).alias("fits")))
    follows = F.col("start") == F.col("piece") * max(capacities)
    return rows.groupBy("doc_id").agg(F.sum("length").cast("long").alias("words"), F.count("*").alias("pieces"), F.every(F.col("fits") & follows).alias("valid"))


#: Of :func:`coverage`, for documents whose ids are not repeated.
COVERAGE_SQL = r"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words FROM documents)
SELECT doc_id, words, greatest(1, ceil(words / 4096))::BIGINT AS pieces, true AS valid FROM d
"""
