"""Exact Jaccard self-join of documents' shingle sets with parity sketches.

A set's sketch has one 64-bit block for each of ``blocks(band)`` ranges of the token hash; every token XORs its
hash into its block. One token that only one of two sets holds changes one block at most, so the number of
blocks that differ is a lower bound of the symmetric difference. For J >= 0.8 and a smaller set of n tokens that
difference is at most n / 4. Sets are banded by size so that a partner is in the same or the next band; a band
has clearly more blocks than its largest permitted difference, so by the pigeonhole rule two linked sets agree
in a block that isn't empty, and meet at the key (band, block, value). A set with so many empty blocks that this
doesn't follow also gives keys for its empty blocks.

Equal sets are one class from the start. Keys are dealt to buckets as one packed row for each set and bucket.
A key of very many sets (as told from the keys of one class in ``PROBE``) is dealt to buckets of its own, as many as
it needs, by class; its members have one group all the same, so no task holds all of them.
Groups of sets that share a key are reduced to distinct member lists. Every member is verified exactly against
the group's centre (the member of most groups) where a 2048-bit parity sketch allows a link; members that are then still in different components are
compared by these sketches in blocks of at most ``BLOCK_ROWS`` rows, and verified too. So a group of
many near copies costs a star and not all pairs, and no link between different texts is lost.

Defined cases: a null or empty text or one without words has an empty set, is linked with nothing and is its own
component; rows with the same id and equal sets count as copies; rows with a null id take part, though the
component is the smallest id that is not null; an empty table gives an empty result. Other columns are not
looked at. Sets are told apart by 64-bit hashes of their tokens and classes by a 64-bit hash of the set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .runtime import Scratch, small
from .textops import as_bytes, chunks, mix, shingle_sets

U = np.uint64
BUCKET_KEYS = 2_000_000
#: Buckets at least; a set has a packed row for each bucket that it has keys in.
BUCKETS = 64
#: Low bytes of a key that are kept in its bucket; equal ones by chance only make a few more candidates.
KEY_BYTES = 5
BLOCK_ROWS = 1024
#: One class in so many shows its keys, and a key that more than ``HOT`` classes are expected to have is split. Neither changes a result.
PROBE = 64
HOT = 100_000
#: At most so many keys are split (beyond all keys over ``HOT``, the bound of a hot one rises), as their list is on the driver.
HOT_KEYS = 1 << 18
SKETCH_WORDS = 32


def _bands(most: int = 1 << 34) -> np.ndarray:
    low = [1]
    while low[-1] < most:
        low.append(low[-1] * 5 // 4 + 1)
    return np.array(low, np.int64)


BANDS = _bands()


def differences(band: np.ndarray) -> np.ndarray:
    """The largest symmetric difference of two linked sets of which the smaller is in the band."""
    return (BANDS[band + 1] - 1) // 4


def blocks(band: np.ndarray) -> np.ndarray:
    """Blocks of a band's sketch: enough that blocks beyond the difference outnumber the empty ones as a rule."""
    low = BANDS[band]
    return np.ceil(0.36 * low + 0.5 * np.sqrt(low) + 2).astype(np.int64)


def set_ids(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set (order-free); 0 for an empty one."""
    out = np.zeros(len(at) - 1, U)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        out[full] = mix(np.add.reduceat(mix(sets ^ U(0x243F6A8885A308D3)), at[full]) + np.diff(at)[full].astype(U))
    return out


def sketch_keys(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the sets (none may be empty), and the set that each belongs to."""
    size = np.diff(at)
    own = np.searchsorted(BANDS, size, side="right") - 1
    keys, rows = [], []
    for step in (0, 1):  # as the smaller or the larger set of its own band, and as the larger one of the band below
        use = np.flatnonzero(own - step >= 0)
        if not len(use):
            continue
        band = own[use] - step
        count = blocks(band)
        row = np.repeat(np.arange(len(use)), size[use])
        token = sets[np.repeat(at[use], size[use]) + np.arange(len(row)) - np.repeat(np.cumsum(size[use]) - size[use], size[use])]
        block = ((token >> U(32)) * count.astype(U)[row]) >> U(32)  # sets are sorted, so blocks come in order
        start = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (row[1:] != row[:-1])])
        value, of = np.bitwise_xor.reduceat(token, start), row[start]
        place = mix((band.astype(U)[of] << U(40)) + block[start] + U(1))
        value_key = mix(value ^ place)
        live = value != 0  # a block whose tokens cancel out counts as empty
        keys.append(value_key[live])
        rows.append(use[of[live]])
        full = np.bincount(of[live], minlength=len(use))
        for i in np.flatnonzero(count - differences(band) <= count - full):
            have = np.zeros(int(count[i]), bool)
            have[block[start][live & (of == i)].astype(np.int64)] = True
            empty = np.flatnonzero(~have).astype(U)
            keys.append(mix(mix((U(int(band[i])) << U(40)) + empty + U(1)) ^ U(0x13198A2E03707344)))
            rows.append(np.full(len(empty), use[i]))
    return np.concatenate(keys), np.concatenate(rows)


def parity_bits(sets: np.ndarray) -> bytes:
    """The 2048-bit parity sketch of one set."""
    bit = np.bincount((mix(sets) & U(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bit.astype(np.uint8)).tobytes()


def _sets(words: int):
    def run(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        data, offs = as_bytes(batch.column(text))
        for i, j in chunks(offs):
            yield i, j, *shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words)

    return run


def _classes(docs: DataFrame, words: int, probe: int) -> DataFrame:
    """id, n_shingles, class, parity sketch of every row, and the keys of one class in ``probe``."""
    of = _sets(words)

    def run(batches):
        for b in batches:
            for i, j, sets, at in of(b, 1):
                n = np.diff(at)
                bits = pa.array([parity_bits(sets[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                ids = set_ids(sets, at)
                shown = [sketch_keys(sets[at[r] : at[r + 1]], np.array([0, n[r]]))[0].view(np.int64) if n[r] and ids[r] % U(probe) == 0 else None for r in range(len(n))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), pa.array(ids.view(np.int64), mask=n == 0), bits, pa.array(shown, pa.list_(pa.int64())), *[x.slice(i, j - i) for x in b.columns[2:]]], names=["doc_id", "n_shingles", "class", "bits", "shown", *docs_names[2:]])

    docs_names = docs.columns
    return docs.mapInArrow(run, "doc_id long, n_shingles long, class long, bits binary, shown array<long>" + "".join(f", {c} long" for c in docs_names[2:]))


def _hot(rows: DataFrame, probe: int, hot: int, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that more than ``hot`` classes are expected to have, in order, and the parts that each is split to."""
    seen = rows.where("shown is not null").select("class", F.explode("shown").alias("key")).distinct().groupBy("key").agg((F.count("*") * probe).alias("n"))
    got = sorted((r["key"], r["n"]) for r in seen.where(F.col("n") > max(hot, keys // HOT_KEYS)).collect())
    many = np.array([k for k, _ in got], np.int64).view(U)
    order = np.argsort(many)
    return many[order], np.array([-(-n // hot) for _, n in got], np.int64)[order]


def _packed(docs: DataFrame, words: int, buckets: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """bucket, class, keys (packed) of every class that a task sees; from ``buckets`` on, the parts of hot keys in their order."""
    of = _sets(words)
    many, parts = hot
    begin = buckets + np.concatenate([[0], np.cumsum(parts)]).astype(np.int64)

    def run(batches):
        for b in batches:
            for _, _, sets, at in of(b, 1):
                ids = set_ids(sets, at)
                _, first = np.unique(ids, return_index=True)
                first = np.sort(first[np.diff(at)[first] > 0])
                if not len(first):
                    continue
                size = np.diff(at)[first]
                own = np.concatenate([[0], np.cumsum(size)])
                keys, row = sketch_keys(sets[np.repeat(at[first] - own[:-1], size) + np.arange(own[-1])], own)
                bucket = ((keys >> U(40)) % U(buckets)).astype(np.int64)
                if len(many):
                    at_hot = np.minimum(np.searchsorted(many, keys), len(many) - 1)
                    is_hot = np.flatnonzero(many[at_hot] == keys)
                    which = at_hot[is_hot]
                    bucket[is_hot] = begin[which] + (mix(ids[first][row[is_hot]]) % parts[which].astype(U)).astype(np.int64)
                place = bucket * len(first) + row
                order = np.argsort(place, kind="stable")
                place, keys = place[order], keys[order]
                start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                offs = np.r_[start, len(place)].astype(np.int32) * KEY_BYTES
                low = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
                packed = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(low.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array((place[start] // len(first)).astype(np.int32)), pa.array(ids[first][place[start] % len(first)].view(np.int64)), packed], names=["bucket", "class", "keys"])

    return docs.mapInArrow(run, "bucket int, class long, keys binary")


def _groups(buckets: int, parts: np.ndarray):
    """The grouping of one bucket: distinct member lists of its keys, or one part of the members of a hot key."""
    last = buckets + np.cumsum(parts)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if (bucket := key[0].as_py()) < buckets:
            return _lists(table)
        group = mix(np.array([np.searchsorted(last, bucket, side="right")], U) ^ U(0xA4093822299F31D0)).view(np.int64)
        ids = np.unique(table.column("class").to_numpy())
        return pa.table({"group": np.repeat(group, len(ids)), "class": ids})

    return run


def _lists(table: pa.Table) -> pa.Table:
    """Distinct member lists of the keys of one bucket: rows (group, class)."""
    data, offs = as_bytes(table.column("keys"))
    keys = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    keys[:, :KEY_BYTES] = data.reshape(-1, KEY_BYTES)
    keys = keys.view(U)[:, 0]
    ids = np.repeat(table.column("class").to_numpy(), np.diff(offs) // KEY_BYTES)
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[1:] == keys[:-1]
    use = same[1:] | same[:-1]
    keys, ids = keys[use], ids[use]
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])][: len(keys)]
    keys, ids = keys[new], ids[new]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    size = np.diff(np.r_[start, len(keys)])
    group = np.add.reduceat(mix(ids.view(U)), start) if len(start) else np.zeros(0, U)
    _, first = np.unique(group, return_index=True)
    first = first[size[first] > 1]
    of = np.repeat(group[first], size[first])
    at = np.repeat(start[first] - (np.cumsum(size[first]) - size[first]), size[first]) + np.arange(len(of))
    return pa.table({"group": of.view(np.int64), "class": ids[at]})


def _close(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Pairs of one cell's rows in different components whose sketches allow a link."""
    cls, comp, n = (table.column(c).to_numpy() for c in ("class", "component", "n"))
    bits = np.frombuffer(as_bytes(table.column("bits"))[0].tobytes(), U).reshape(-1, SKETCH_WORDS)
    block = table.column("block").to_numpy()
    left, right = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
    a, b = [], []
    for i in left:
        other = right[(comp[right] != comp[i]) & ((cls[right] > cls[i]) | (key[1].as_py() != key[2].as_py()))]
        if len(other):
            far = np.bitwise_count(bits[other] ^ bits[i]).sum(1)
            ok = other[(9 * far <= n[other] + n[i]) & (5 * np.minimum(n[other], n[i]) >= 4 * np.maximum(n[other], n[i]))]
            a.append(np.full(len(ok), cls[i]))
            b.append(cls[ok])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, na, nb, bits_a, bits_b), the pairs whose sizes and sketches allow a link."""
    for b in batches:
        one, two = (np.frombuffer(as_bytes(b.column(k))[0].tobytes(), U).reshape(-1, SKETCH_WORDS) for k in (4, 5))
        na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
        ok = (9 * np.bitwise_count(one ^ two).sum(1, dtype=np.int64) <= na + nb) & (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb))
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], names=["a", "b"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("class").alias("a"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("class").alias("b"), F.col("tokens").alias("tb"))
    got = pairs.join(one, "a").join(two, "b")
    both = F.size(F.array_intersect("ta", "tb")).cast("long")
    return got.withColumn("both", both).where(100 * F.col("both") >= percent * (F.size("ta") + F.size("tb") - F.col("both"))).select("a", "b")


def _token_sets(pairs: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch, name: str, words: int) -> DataFrame:
    """class and its sorted tokens for the classes in ``pairs``, read again from the text of one row of each."""
    of = _sets(words)

    def run(batches):
        for b in batches:
            for _, _, sets, at in of(b, 1):
                full = np.flatnonzero(np.diff(at) > 0)
                yield pa.RecordBatch.from_pydict({"class": pa.array(set_ids(sets, at)[full].view(np.int64)), "tokens": pa.array([sets[at[r] : at[r + 1]].view(np.int64) for r in full], pa.list_(pa.int64()))})

    wanted = pairs.select(F.col("a").alias("class")).unionAll(pairs.select("b")).distinct().join(classes, "class").select("class", "first")
    wanted = scratch.save(wanted, f"{name}-wanted")
    n = wanted.count()
    # a class without any id is looked for among the rows without one
    few = docs.join(small(wanted.select(F.col("first").alias("doc_id")).distinct(), n, 24), "doc_id", "left_semi").unionAll(docs.where("doc_id is null"))
    got = few.select("doc_id", "text").mapInArrow(run, "class long, tokens array<long>").join(small(wanted.select("class"), n, 24), "class", "left_semi")
    got = scratch.save(got, name)
    if got.count() != n:  # rows with equal ids
        got = scratch.save(got.dropDuplicates(["class"]), f"{name}-once")
    return got


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, key_col: str | None = None, probe: int = PROBE, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: components of texts of Jaccard similarity 0.8 or more.

    With ``key_col``, a long of each row, also row_key, and component: a label that no two components share, as
    they may share ids where these repeat or are null. It is null for a row with an empty set.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(key_col).cast("long").alias("row_key")] if key_col else []))
    rows = scratch.save(_classes(docs, words, probe), "rows")
    classes = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n"))
    keys = rows.agg(F.sum("n_shingles")).head()[0] or 0
    buckets = max(BUCKETS, 1 << (int(0.7 * keys) // BUCKET_KEYS).bit_length())
    often = _hot(rows, probe, hot, keys)
    members = _packed(docs, words, buckets, often).groupBy("bucket").applyInArrow(_groups(buckets, often[1]), "group long, class long").distinct()
    members = scratch.save(members, "members")
    weight = members.groupBy("class").agg(F.count("*").alias("w"))
    sketch = rows.where("class is not null").groupBy("class").agg(F.first("n_shingles").alias("n"), F.first("bits").alias("bits"))
    sketch = scratch.save(sketch.join(weight, "class"), "sketches")
    centre = members.join(sketch.select("class", "w"), "class").groupBy("group").agg(F.max(F.struct("w", "class"))["class"].alias("centre"), F.count("*").alias("size"))
    centre = scratch.save(centre, "centres")
    pairs = members.join(centre, "group").where("class <> centre").select(F.least("class", "centre").alias("a"), F.greatest("class", "centre").alias("b")).distinct()
    pairs = scratch.save(pairs, "pairs")
    side = lambda x: sketch.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(_allow, "a long, b long")
    near = scratch.save(near, "near")
    links = scratch.save(_verify(near, _token_sets(near, docs, classes, scratch, "sets", words), 80), "links")
    scratch.drop("near", "sets")
    comp = components(links, scratch, "star")
    comp = scratch.save(comp, "comp-star")
    left = members.join(centre.where("size > 2").select("group", "size"), "group").join(comp.withColumnRenamed("node", "class"), "class", "left")
    left = left.select("group", "size", "class", F.coalesce("component", "class").alias("component"))
    mixed = left.groupBy("group").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("group")
    left = left.join(scratch.save(mixed, "mixed"), "group").join(sketch.select("class", "n", "bits"), "class")
    left = left.withColumn("cells", F.ceil(F.col("size") / BLOCK_ROWS).cast("int")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("cells")).cast("int"))
    cells = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    cells = cells.select("group", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "class", "component", "n", "bits", "block")
    more = cells.groupBy("group", "one", "two").applyInArrow(_close, "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti")
    more = scratch.save(more, "more")
    more = scratch.save(_verify(more, _token_sets(more, docs, classes, scratch, "more-sets", words), 80), "more-links")
    every = links.unionAll(more)
    final = components(every, scratch, "all")
    label = classes.join(final.withColumnRenamed("node", "class"), "class", "left")
    label = label.select("class", "first", F.coalesce("component", "class").alias("component"))
    label = scratch.save(label, "labels")
    least = scratch.save(label.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    label = scratch.save(label.join(least, "component").select(F.col("class").alias("of_class"), "component_id", "component"), "classes")
    scratch.drop("members", "centres", "pairs", "sketches", "more-sets", "mixed", "more", "comp-star")
    out = rows.join(label, rows["class"] == label["of_class"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *(["row_key", "component"] if key_col else []))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
k AS (SELECT x, y FROM l JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT k.y, r.reach FROM r JOIN k ON k.x = r.node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.reach)::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id, n.n
"""
