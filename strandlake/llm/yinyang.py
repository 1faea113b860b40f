"""Vector code compression: product codebooks by Lloyd's rounds, with Yinyang bounds that skip what cannot win.

Vectors become integers floor(scale * x) and are cut into equal consecutive parts, each with a codebook of its own
that starts as that part of the first rows. A round assigns every part to its nearest entry and moves every entry to
the floored mean of its parts. Rows stay on the executors; the driver holds the codebooks alone (parts x entries x
width integers, whatever the table's size) and adds up sums that each task has made of its rows.

An assignment does not look at all entries. The entries of a codebook are put into groups once; a row carries, for
each part and group, a lower bound of its distance to the entries of that group other than its own. When entries
move, the bound falls by the largest move in the group. A group is scanned only where its bound does not exceed the
distance to the row's own entry, which is always computed; all others would lose. Bounds are single precision rounded
down, compared with a margin, and whoever comes within it is scanned. What is scanned is compared as exact squared
integers, ties to the lower index, so rounding can cost a scan and never an answer. Sums follow by differences:
only parts that changed their entry are taken out of one sum and added to another.

Distances are exact in double precision while width * (2 * largest)^2 stays below 2^53, and in 64-bit integers
beyond; where even these could overflow a ValueError tells so, since then the errors have no long value either.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; vectors of other lengths
are filled up with zeros to the longest, and that to a multiple of the parts; with fewer rows than entries a codebook
has as many entries as rows; equal identifiers are ordered by vector, null ones come last and stay; repeated rows count
each; an entry without parts stays; null labels are one label; an empty table gives no rows. Other columns are kept out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, small
from .vectors import matrix, widen

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
GROUPS = 16
MARGIN = 1e-6


@dataclass
class Book:
    """The codebook of one part, its groups and how far entries moved since the round before."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray

    def moved(self, entries: np.ndarray) -> Book:
        gap = (entries - self.entries).astype(np.float64)
        far = np.sqrt((gap * gap).sum(1)) * (1 + MARGIN)
        drift = np.array([far[self.group == g].max(initial=0) for g in range(len(self.drift))])
        return Book(entries, self.group, drift)


def grouped(entries: np.ndarray, groups: int) -> Book:
    """A codebook whose entries are put into groups by a few rounds of plain Lloyd over the entries themselves."""
    x = entries.astype(np.float64)
    groups = max(1, min(groups, len(x)))
    mid = x[np.linspace(0, len(x) - 1, groups).astype(int)]
    for _ in range(5):
        d = (x * x).sum(1)[:, None] - 2 * x @ mid.T + (mid * mid).sum(1)
        of = d.argmin(1)
        mid = np.array([x[of == g].mean(0) if (of == g).any() else mid[g] for g in range(groups)])
    return Book(entries, of, np.zeros(groups))


def squared(x: np.ndarray, y: np.ndarray, exact: bool) -> np.ndarray:
    """Squared distances of all rows of x and y as integers: by doubles that are exact, or by 64-bit integers."""
    if exact:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(y)), np.int64)
    for j, e in enumerate(y):
        gap = x - e
        out[:, j] = (gap * gap).sum(1)
    return out


def assign(x: np.ndarray, old: np.ndarray | None, bound: np.ndarray, book: Book, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New entries, their squared distances, new bounds, and how many distances were computed.

    ``bound`` has a row's lower bound for each group; without ``old`` entries all are looked at.
    """
    n, groups = len(x), len(book.drift)
    most = np.iinfo(np.int64).max
    if old is None:
        bound, own, best, at = np.zeros((n, groups)), np.full(n, np.inf), np.full(n, most), np.zeros(n, np.int64)
        looked = 0
    else:
        gap = x - book.entries[old]
        best, at = (gap * gap).sum(1), old.copy()
        own = np.sqrt(best.astype(np.float64)) * (1 + MARGIN)
        bound = np.maximum(0, bound.astype(np.float64) - book.drift)
        looked = n
    start = best.copy()
    new = bound.copy()
    firsts = []
    for g in range(groups):
        members = np.flatnonzero(book.group == g)
        rows = np.flatnonzero(bound[:, g] <= own)
        if not len(members):
            new[:, g] = np.inf
            continue
        if not len(rows):
            continue
        d = squared(x[rows], book.entries[members], exact)
        looked += d.size
        near = d.argmin(1)  # members ascend, so the first of equals has the lowest index
        low = d[np.arange(len(rows)), near]
        d[np.arange(len(rows)), near] = most
        second = d.min(1)
        entry = members[near]
        wins = (low < best[rows]) | ((low == best[rows]) & (entry < at[rows]))
        best[rows] = np.where(wins, low, best[rows])
        at[rows] = np.where(wins, entry, at[rows])
        firsts.append((g, rows, entry, low, second))
    down = lambda d: np.where(d == most, np.inf, np.sqrt(d.astype(np.float64)) * (1 - MARGIN))
    for g, rows, entry, low, second in firsts:
        new[rows, g] = down(np.where(entry == at[rows], second, low))
    if old is not None:  # the entry that a row left now counts in its group
        left = np.flatnonzero(at != old)
        g = book.group[old[left]]
        new[left, g] = np.minimum(new[left, g], down(start[left]))
    return at, best, np.nextafter(new.astype(np.float32), np.float32(0)), looked


def whole_numbers(df: DataFrame, id_col: str, vec_col: str, label_col: str | None, scale: int) -> DataFrame:
    """``vec_id, label, v``: rows whose components are all finite, as floored multiples."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit(True))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    return df.where(v.isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"))


STATE = pa.schema([("at", pa.binary()), ("bound", pa.binary()), ("was", pa.binary()), ("error", pa.int64()), ("looked", pa.int64())])


def compress(
    df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256, looked`` for every usable row.

    ``looked`` counts the distances computed for a row over all rounds; a plain search has parts x entries x (rounds + 1).
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    spark = df.sparkSession
    scratch = Scratch(spark, "yinyang")
    rows = scratch.save(whole_numbers(df, id_col, vec_col, label_col, scale), "rows")
    n, wide, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).head()
    label = rows.schema["label"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string, looked long")
    width = -(-max(1, wide) // parts)
    reach = width * parts * (2 * ((largest or 0) + 1)) ** 2
    if reach >= 2**63:
        raise ValueError(f"components up to {largest} have squared distances beyond 64 bits")
    exact = reach < 2**53
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    first = np.zeros((len(start), width * parts), np.int64)
    for i, r in enumerate(start):
        first[i, : len(r.v)] = np.array(r.v, np.float64).astype(np.int64)
    books = [grouped(first[:, p * width : (p + 1) * width], groups) for p in range(parts)]

    def cut(column) -> np.ndarray:
        return widen(matrix(column), width * parts).astype(np.int64)

    def step(books: list[Book], again: bool):
        def run(batches):
            for b in batches:
                x, k = cut(b.column("v")), b.num_rows
                if not k:
                    continue
                codes, error, looked, bounds = np.zeros((k, parts), np.uint8), np.zeros(k, np.int64), 0, []
                if again:
                    was = np.frombuffer(b"".join(b.column("at").to_pylist()), np.uint8).reshape(k, parts)
                    bound = np.frombuffer(b"".join(b.column("bound").to_pylist()), np.float32).reshape(k, -1)
                    edge = np.cumsum([0, *(len(o.drift) for o in books)])
                for p, book in enumerate(books):
                    old, low = (was[:, p].astype(np.int64), bound[:, edge[p] : edge[p + 1]]) if again else (None, np.zeros((k, 0)))
                    at, best, low, seen = assign(x[:, p * width : (p + 1) * width], old, low, book, exact)
                    codes[:, p], error, looked = at, error + best, looked + seen
                    bounds.append(low)
                low = np.concatenate(bounds, 1)
                cols = {"at": [c.tobytes() for c in codes], "bound": [r.tobytes() for r in low], "was": [c.tobytes() for c in was] if again else [None] * k, "error": error, "looked": np.full(k, looked // k) + (b.column("looked").to_numpy() if again else 0)}
                made = [pa.array(cols[f.name], f.type) for f in STATE]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), *made], names=["vec_id", "label", "v", *STATE.names])

        return run

    def gains(batches):
        """What the parts that changed their entry add to sums and counts, by part and entry."""
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, new = cut(b.column("v")), np.frombuffer(b"".join(b.column("at").to_pylist()), np.uint8).reshape(-1, parts)
            past = b.column("was").to_pylist()
            old = np.array([np.frombuffer(w, np.uint8) if w is not None else np.zeros(parts, np.uint8) for w in past])
            had = np.array([w is not None for w in past])
            for p in range(parts):
                own, change = x[:, p * width : (p + 1) * width], ~had | (old[:, p] != new[:, p])
                np.add.at(total[p], new[change, p], own[change])
                np.add.at(count[p], new[change, p], 1)
                np.subtract.at(total[p], old[change & had, p], own[change & had])
                np.subtract.at(count[p], old[change & had, p], 1)
        p, e = np.nonzero(count | (total != 0).any(2))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e], pa.int64()), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    schema = f"vec_id long, label {label}, v array<double>, at binary, bound binary, was binary, error long, looked long"
    total, count = np.zeros((parts, entries, width), object), np.zeros((parts, entries), object)
    state = rows
    for r in range(rounds + 1):
        state = scratch.save(state.mapInArrow(step(books, r > 0), schema), f"state-{r}")
        scratch.drop(f"state-{r - 1}" if r else "rows")
        if r == rounds:
            break
        moved = state if r == 0 else state.where("at <> was")
        change = moved.select("v", "at", "was").mapInArrow(gains, "part int, entry int, n long, total array<long>")
        for g in change.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total")).collect():
            total[g["part"], g["entry"]] += np.array(g["total"], object)
            count[g["part"], g["entry"]] += g["n"]
        for p, book in enumerate(books):
            mean = book.entries.copy()
            for e in range(len(mean)):
                if count[p, e]:
                    mean[e] = [int(s) // int(count[p, e]) for s in total[p, e]]
            books[p] = book.moved(mean)
    digest = hashlib.sha256(",".join(str(i) for book in books for entry in book.entries for i in entry.tolist()).encode()).hexdigest()
    coded = state.select("vec_id", "label", F.lower(F.hex("at")).alias("code"), "error", "looked")
    by = scratch.save(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    coded = coded.join(small(by, by.count(), 48), F.col("label").eqNullSafe(F.col("of")))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "looked")


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same by plain rounds over all entries, for DuckDB."""
    text = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, v) AS id, vec_id, label, v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
cut AS MATERIALIZED (SELECT id, p, v[(p * (len(v) // {parts}) + 1)::BIGINT : ((p + 1) * (len(v) // {parts}))::BIGINT] AS x FROM kept, range({parts}) t(p)),
c0 AS MATERIALIZED (SELECT p, id - 1 AS e, x AS c FROM cut WHERE id <= {entries})"""
    for r in range(rounds + 1):
        text += f""",
a{r} AS MATERIALIZED (
  SELECT id, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (
    SELECT id, p, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM cut JOIN c{r} USING (p))
  GROUP BY id, p)"""
        if r < rounds:
            text += f""",
c{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT p, e, list(floor(s / n) ORDER BY i) AS c FROM (
      SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{r} JOIN cut USING (id, p)) GROUP BY p, e, i)
    GROUP BY p, e) m USING (p, e))"""
    return text + f""",
told AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM kept JOIN told USING (id)
"""


SQL = sql()
