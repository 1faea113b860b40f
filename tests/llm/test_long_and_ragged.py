"""Very long texts and vectors of unequal lengths against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import ann, exact_dedup, jaccard_join, language_id, mixing, packing, quality, suffix_dedup, textops, topk_search


@pytest.fixture(scope="module")
def long_texts():
    """Texts of some 150,000 to 1,200,000 bytes, beyond every block, with passages, near copies and copies among them, and short ones."""
    r = random.Random(8)
    words = [f"w{k}" + "é" * (k % 3) for k in range(3000)]
    one = r.choices(words, k=24_000)
    near = list(one)
    near[12_000] = "changed"
    far = [w if i % 9 else "x" for i, w in enumerate(one)]
    other = r.choices(words, k=160_000)
    passage = " ".join(r.choices(words, k=70))
    texts = [" ".join(one), " ".join(near), " ".join(far), "  ".join(one), " ".join(other), " ".join(other[:40_000]) + " " + passage + " tail", "short " + passage, passage[:190], "ab" * 90_000, None]
    assert max(len(t or "") for t in texts) > 1 << 20
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def table(spark, long_texts):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in long_texts], "doc_id long, text string, lang string, source string").repartition(3)


def test_repeats_of_long_texts(table, long_texts):
    assert max(len((t or "").encode()) for _, t in long_texts) > 10 * suffix_dedup.CHUNK
    seen = {}
    data = [(i, (t or "").encode()) for i, t in long_texts]
    for _, b in data:
        for k in range(len(b) - 199):
            h = hash(b[k : k + 200])
            seen[h] = seen.get(h, 0) + 1
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(table).collect()}
    for i, b in data:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 199):
            if seen[hash(b[k : k + 200])] > 1:
                gone[k] += 1
                gone[min(len(b), k + 200)] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(b), int(gone.sum()), hashlib.sha256(kept).hexdigest())


def test_near_copies_of_long_texts(table, long_texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in long_texts]
    least = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                least = [min(least[i], least[j]) if x in (least[i], least[j]) else x for x in least]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(table).collect()}
    assert got == {i: (len(sets[i]), least[i]) for i in range(len(sets))}


def test_sizes_packing_and_copies_of_long_texts(table, long_texts):
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in long_texts}
    assert {r.doc_id: r["size"] for r in mixing.mix_sources(table).collect()} == words
    covered = {r.doc_id: (r.words, r.pieces, r.valid) for r in packing.coverage(packing.pack(table)).collect()}
    assert covered == {i: (n, max(1, -(-n // 4096)), True) for i, n in words.items()}
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates_of(table).collect()}
    assert got[3] == got[0] == (0, 2) and all(got[i] == (i, 1) for i in got if i not in (0, 3))


def test_models_see_long_texts_whole(spark, table, long_texts):
    """A prediction is that of the model on all of the text at once."""
    long = dict(long_texts)
    model = language_id.ByteTagger(["a", "b", "c"], seed=2)
    got = {r.doc_id: r for r in language_id.predict(table, model).collect()}
    for i in (4, 8):
        data = np.frombuffer(long[i].encode(), np.uint8)
        x, used, _ = language_id.windows(data, np.array([0, len(data)]), language_id.WINDOW)
        mean = sum(model.probs(x[k : k + 4096], used[k : k + 4096]).sum(0) for k in range(0, len(x), 4096)) / len(data)
        assert got[i].lang_pred == model.langs[int(mean.argmax())] and got[i].score == pytest.approx(mean.max(), rel=1e-4)
    bags = quality.BagModel(seed=1)
    scored = {r.doc_id: r.score for r in quality.score(table, bags).collect()}
    for i in (2, 4):
        data, offs = textops.as_bytes(__import__("pyarrow").array([long[i]]))
        x, at = quality.passage_features(data, offs)
        assert len(x) == -(-len(re.findall(r"[^\x20\x09-\x0D]+", long[i])) // quality.PASSAGE)
        assert scored[i] == pytest.approx(float(bags.scores(x, at)[0]), rel=1e-9)


def test_vectors_of_unequal_lengths(spark):
    """Shorter vectors count as if filled up with zeros, in queries and rows, in both searches."""
    r = np.random.default_rng(4)
    rows = [(i, r.standard_normal(int(r.integers(1, 13))).tolist()) for i in range(500)] + [(900, []), (901, [0.0] * 20 + [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    wide = np.zeros((len(rows), 21))
    for k, (_, v) in enumerate(rows):
        wide[k, : len(v)] = v
    ids = np.array([i for i, _ in rows])
    asked = df.where("vec_id % 50 = 0 OR vec_id > 899")
    whole = np.floor(256 * wide).astype(np.int64)
    got = {(t.query_id, t.rank): (t.vec_id, t.score) for t in topk_search.exact_top_k(df, asked, k=5).collect()}
    near = {}
    for t in ann.nearest(df, asked, k=5).collect():
        near[t.query_id, t.rank] = (t.vec_id, t.score)
    for k in np.flatnonzero((ids % 50 == 0) | (ids > 899)):
        score = whole @ whole[k]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[k]][:5]
        assert [got[ids[k], n + 1] for n in range(5)] == [(ids[j], score[j]) for j in order]
        flat = np.round(wide @ wide[k], 12)
        order = [j for j in np.lexsort((ids, -flat)) if ids[j] != ids[k] and ids[j] != 900][:5]
        if ids[k] == 900:
            assert (900, 1) not in near  # a zero vector takes no part
        else:
            assert [near[ids[k], n + 1][0] for n in range(5)] == [ids[j] for j in order]
    assert df.where(F.size("embedding") == 0).count() == 1
