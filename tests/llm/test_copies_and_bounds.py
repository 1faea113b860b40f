"""Copies of one row do not meet in one place or at the driver; packing against a plain quadratic best fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import language_id, mixing, packing, quality, suffix_dedup, topk_search

DOCS = "doc_id long, text string, lang string, source string, size long, key string, n long"


def plain_best_fit(lengths, capacities):
    """Long to short, each into the open bin with the least room that holds it (of equal ones that which got this room last); a new bin by trial of each capacity."""
    caps, out, bins = sorted(capacities), [], []
    left = sorted(lengths, reverse=True)
    for at, n in enumerate(left):
        fits = [b for b in bins if b["room"] >= n]
        if fits:
            b = min(fits, key=lambda b: (b["room"], -b["when"]))
        else:
            def filled(c, at=at, n=n):
                room = c - n
                for m in left[at + 1 :]:  # greedily, from the longest that is left
                    if m <= room:
                        room -= m
                return c - room

            c = min((c for c in caps if c >= n), key=lambda c: (packing.cost(c, caps[-1]) / filled(c), c))
            b = {"room": c, "used": 0, "when": at, "id": len(bins)}
            bins.append(b)
        b["used"] += n
        b["room"] -= n
        b["when"] = at
        out.append((n, b["id"]))
    return out, [min(c for c in caps if c >= b["used"]) for b in bins]


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_the_plain_one(seed):
    r = np.random.default_rng(seed)
    caps = [(64, 128, 256), (100,), (10, 37, 256)][seed % 3]
    n = r.integers(1, max(caps) + 1, 400) if seed % 2 else np.minimum(max(caps), 1 + r.geometric(0.05, 400))
    seq, off, cap = packing.best_fit(n, caps)
    placed, want = plain_best_fit(n.tolist(), caps)
    assert cap.tolist() == want
    order = np.argsort(-n, kind="stable")
    assert [(int(n[i]), int(seq[i])) for i in order] == placed
    for s in range(len(cap)):
        own = np.flatnonzero(seq == s)
        own = own[np.argsort(off[own])]
        assert np.array_equal(off[own], np.concatenate([[0], np.cumsum(n[own])[:-1]]))


def test_coverage_tells_what_is_wrong(spark):
    rows = [(1, 0, 0, 60, 0, 0, 64, 0), (2, 0, 0, 4, 0, 0, 64, 60), (3, 0, 0, 128, 0, 1, 128, 0), (3, 1, 128, 5, 0, 2, 64, 0), (4, 0, 0, 0, 0, None, None, None)]
    schema = "doc_id long, piece int, start long, length long, shard long, sequence long, capacity int, offset int"
    told = lambda r: sorted(map(tuple, packing.coverage(spark.createDataFrame(r, schema), (64, 128)).collect()))
    assert told(rows) == [(1, 60, 1, True), (2, 4, 1, True), (3, 133, 2, True), (4, 0, 1, True)]
    for k, place, value, bad in ((1, 7, 61, {2}), (0, 6, 128, {1}), (3, 2, 127, {3}), (0, 3, 61, {1, 2})):
        wrong = [list(r) for r in rows]
        wrong[k][place] = value
        assert {r[0] for r in told([tuple(r) for r in wrong]) if not r[3]} == bad


def test_copies_of_a_row_go_to_all_shards(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.expr("if(id % 3 = 0, 'a b c', repeat('w ', int(id % 50)))").alias("text"))
    got = packing.pack(df, capacities=(64, 128), shard_rows=100)
    per = [r["n"] for r in got.where("doc_id = 7 AND length = 3").groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(per) == 30 and sum(per) == 1000 and max(per) - min(per) <= 1
    assert max(r["count"] for r in got.groupBy("shard").count().collect()) < 200


def test_mixing_copies_and_missing_ids(spark, monkeypatch):
    """A third of all rows is one row, a third has no id: each source's words come to its target, whatever parts copies go in."""
    rows = [(None if i % 3 == 1 else 5 if i % 3 == 0 else i, "one two three" if i % 3 == 0 else " ".join(["w"] * (i % 17)), "en", ["a", "b", None][i % 5 % 3], 0, "", 1) for i in range(900)]
    df = spark.createDataFrame(rows, DOCS)
    counted = lambda d: sorted((tuple(r) for r in d.groupBy("doc_id", "size", "source_size", "target", "taken").count().collect()), key=repr)
    want = counted(mixing.mix_sources(df))
    monkeypatch.setattr(mixing, "COPIES", 7)
    assert counted(mixing.mix_sources(df)) == want and sum(x[-1] for x in want) == 900
    by = {}
    for doc, size, source_size, target, taken, n in want:
        assert 0 <= taken <= 2 * size
        by[source_size, target] = by.get((source_size, target), 0) + taken * n
    assert all(got == int(target) for (_, target), got in by.items())
    assert len(mixing.mix_sources(df.where("doc_id IS NULL")).collect()) == 300


def test_samples_are_rows_not_ids(spark, monkeypatch):
    """Very many rows of one id, alike and unlike, leave what comes to the driver at its bound."""
    many = spark.range(20000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text number "), (F.col("id") % 4000).cast("string")).alias("text"), F.lit("en").alias("lang"))
    others = spark.createDataFrame([(i, f"der Text Nummer {i} hier", "de") for i in range(2, 40)], "doc_id long, text string, lang string")
    seen = {}
    monkeypatch.setattr(language_id.ByteTagger, "train", lambda self, x, used, y, steps: seen.update(bytes=np.bincount(y, used)))
    model = language_id.fit(many.unionByName(others), per_lang=30)
    assert model.langs == ["de", "en"] and seen["bytes"][1] < 30 * 20
    model = language_id.fit(many.unionByName(others), most_bytes=100)
    assert seen["bytes"].max() <= 100
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    monkeypatch.setattr(quality.BagModel, "train", lambda self, x, at, y: seen.update(labels=len(y), passages=len(x)))
    quality.fit(many.unionByName(others.select("doc_id", "text", "lang")), labels, max_labels=50)
    assert seen["labels"] == 50
    quality.fit(many, labels, max_bytes=200)
    assert 0 < seen["labels"] <= 200 // len("text number 1")


def test_language_learns_from_whole_texts(spark, monkeypatch):
    long = "x" * 5000
    df = spark.createDataFrame([(1, long, "a"), (2, "y" * 300, "b"), (3, "z" * 10, "b")], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language_id.ByteTagger, "gradients", lambda self, ids, size, y: (seen.extend(zip(size.tolist(), y.tolist(), strict=True)), {k: np.zeros_like(v) for k, v in self.w.items()})[1])
    language_id.fit(df, steps=1)
    full = [s for s, y in seen if y == 0]
    assert sum(full[: -(-5000 // language_id.WINDOW)]) == 5000  # each window before any comes again


def test_query_blocks_do_not_follow_partitions(spark, monkeypatch):
    r = np.random.default_rng(0)
    df = spark.createDataFrame([(i // 2 if i % 4 == 0 else i, r.standard_normal(8).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    runs, plain = [], topk_search._group
    for parts in (1, 40):
        calls = []
        monkeypatch.setattr(topk_search, "_group", lambda rows, asked, *a, calls=calls: (calls.append(len(asked)), plain(rows, asked, *a))[1])
        got = topk_search.exact_top_k(df.repartition(3), df.repartition(parts), k=3, query_block=50).collect()
        runs.append((sorted(calls), sorted(map(tuple, got))))
    assert runs[0] == runs[1] and sum(runs[0][0]) == 200 and max(runs[0][0]) <= 100


def test_copies_of_a_row_are_in_many_buckets(spark, monkeypatch):
    """Removal of repeats: a third of all rows is one row, and no bucket of the written table has all of it."""
    text = "".join(chr(97 + i * i % 26) for i in range(300))
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(text)).otherwise(F.concat(F.lit("own "), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    seen, plain = {}, suffix_dedup.Scratch.bucketed

    def bucketed(self, d, name, *by):
        got = plain(self, d, name, *by)
        seen[name] = [r["n"] for r in got.where("c0 IS NULL").groupBy(*by).agg(F.count("*").alias("n")).collect()]
        return got

    monkeypatch.setattr(suffix_dedup.Scratch, "bucketed", bucketed)
    got = suffix_dedup.remove_repeats(df).collect()
    assert sum(seen["rows"]) == 300 and max(seen["rows"]) <= 20
    assert sum(r.n_removed for r in got if r.doc_id is None) == 300 * 300 and all(r.n_removed == 0 for r in got if r.doc_id is not None)
