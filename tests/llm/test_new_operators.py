"""Streaming exact deduplication and Yinyang codebooks against brute force, with edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import exact_dedup, yinyang

DOCS = "doc_id long, text string, digest string, n long, first string, `_metadata` string"


def groups(rows):
    """Keeper id, size and digest for each (id, text), by brute force; which of equal rows stays is left open."""
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    by = {}
    for i, t in rows:
        by.setdefault(norm(t), []).append(i)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted(((i, least(by[norm(t)]), len(by[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=repr)


def told(df):
    rows = df.collect()
    for g in {r.text_sha256 for r in rows}:  # one row of each group stays, and it has the group's id
        kept = [r for r in rows if r.text_sha256 == g and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    texts = ["one  two", "one two", "one\ttwo", "one\n\x0b two ", None, "", " ", "\r\n", "é " * 400, "a b", "a b", "x" * 2_000_000, "x" * 2_000_000 + " ", "One two"]
    out = [(50 - i, t) for i, t in enumerate(texts)]
    out += [(None, "null id"), (None, "null id"), (None, "one two"), (7, "again"), (7, "again"), (7, "other")]
    return out + [(1000 + i, f"hot  {'text' if i % 3 else i}") for i in range(300)] + [(3000 + i, f"w{r.randrange(40)} z") for i in range(200)]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, rows, weak):
    """Also with a digest of four values, where nearly every group is a collision that the texts must settle."""
    df = spark.createDataFrame([(i, t, "d", 1, "f", "m") for i, t in rows], DOCS).repartition(3)
    options = {"digest": lambda t: F.substring(F.md5(t.cast("binary")), 1, 1).cast("binary")} if weak else {}
    assert told(exact_dedup.exact_duplicates_of(df, **options)) == groups(rows)


def test_exact_dedup_takes_only_what_is_new(spark, rows, tmp_path):
    table, before = f"{tmp_path}/t", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    work = exact_dedup.ExactDedup(spark, f"{tmp_path}/known")
    for k in range(3):
        spark.createDataFrame(rows[k::3], "doc_id long, text string").write.mode("append").parquet(table)
        work.take(table)
        work.take(table)  # nothing new
        assert told(work.result(table)) == groups([x for i in range(k + 1) for x in rows[i::3]])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_exact_dedup_of_nothing(spark):
    got = exact_dedup.exact_duplicates_of(spark.createDataFrame([], DOCS))
    assert got.collect() == [] and got.columns[:5] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def lloyd(vectors, parts=4, entries=256, rounds=4):
    """Plain rounds with Python integers' rules: codes, errors, codebooks."""
    width = -(-max(map(len, vectors)) // parts)
    x = np.zeros((len(vectors), width * parts), np.int64)
    for i, v in enumerate(vectors):
        x[i, : len(v)] = np.floor(1024 * np.array(v, np.float64)).astype(np.int64)
    codes, error, books = [], 0, []
    for p in range(parts):
        own = x[:, p * width : (p + 1) * width]
        book = own[:entries].copy()
        near = lambda: ((own[:, None, :] - book[None]) ** 2).sum(2)  # noqa: B023, E731
        for _ in range(rounds):
            at = near().argmin(1)
            for e in range(len(book)):
                if (at == e).any():
                    book[e] = own[at == e].sum(0) // (at == e).sum()
        codes.append(near().argmin(1))
        error = error + near().min(1)
        books.append(book)
    return ["".join(f"{c[i]:02x}" for c in codes) for i in range(len(x))], error, hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int, v string, at string"


@pytest.mark.parametrize("kind", ["random", "ties", "large", "ragged", "few"])
def test_codes_against_plain_rounds(spark, kind):
    r = np.random.default_rng(5)
    n = 9 if kind == "few" else 700
    vecs = r.standard_normal((n, 16)) / 4
    if kind == "ties":  # few values and many equal rows and entries, so that distances are equal
        vecs = r.integers(-1, 2, (n, 16)) / 1024
    if kind == "large":  # beyond doubles' exact squares
        vecs = vecs * 300_000
    vecs = [np.float32(v).tolist() for v in vecs]
    if kind == "ragged":
        vecs = [v[: 16 - i % 5] for i, v in enumerate(vecs)]
    rows = [(i // 2 * 2 if kind == "ties" else i, v, [None, 0, 1][i % 3], "x", "y") for i, v in enumerate(vecs)]
    bad = [(2000, None, 0, "x", "y"), (-1, [1.0, None], 0, "x", "y"), (-2, [float("nan")] * 16, 1, "x", "y"), (-3, [float("inf")] * 16, None, "x", "y")]
    if kind == "few":  # missing ids come last in the order of the first entries, and stay
        rows = [(None if i in (2, 5) else i, *x[1:]) for i, x in enumerate(rows)]
    got = yinyang.compress(spark.createDataFrame(rows + bad, VECTORS).repartition(3)).collect()
    rows.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    codes, error, digest = lloyd([x[1] for x in rows])
    labels = {k: sum(int(e) for e, x in zip(error, rows, strict=True) if x[2] == k) for k in (None, 0, 1)}
    want = sorted(((x[0], c, int(e), labels[x[2]], digest) for x, c, e in zip(rows, codes, error, strict=True)), key=repr)
    assert sorted(((g.vec_id, g.code, g.error, g.label_error, g.codebooks_sha256) for g in got), key=repr) == want


def test_bounds_skip_entries(spark):
    """Clustered vectors: most distances are never computed."""
    r = np.random.default_rng(1)
    mids = r.standard_normal((400, 64)) * 4
    vecs = np.float32(mids[r.integers(0, 400, 4000)] + r.standard_normal((4000, 64)) / 20)
    got = yinyang.compress(spark.createDataFrame([(i, v.tolist(), 0, "", "") for i, v in enumerate(vecs)], VECTORS))
    assert got.agg(F.avg("looked")).head()[0] < 0.45 * 4 * 256 * 5


def test_codes_of_nothing_and_of_too_much(spark):
    none = spark.createDataFrame([], VECTORS)
    assert yinyang.compress(none).collect() == []
    with pytest.raises(ValueError, match="64 bits"):
        yinyang.compress(spark.createDataFrame([(1, [1e30, 0.0], 0, "", "")], VECTORS))

