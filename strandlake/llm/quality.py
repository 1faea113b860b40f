"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of ``PASSAGE`` words. A passage is described by shares and counts of its bytes,
words and repeats (see ``FEATURES``) and by its words themselves, of which each counts in one of ``WORD_BINS`` bins by
its hash (square roots of the bins' shares), encoded by a tanh layer, weighed against the document's other passages by
gated attention, and the weighted sum is scored by a logistic unit. Encoder, attention and scorer are trained
together from document labels by gradient descent in numpy, on at most ``max_labels`` labelled rows with ``max_bytes``
of text, those with the smallest hashes of their ids; of these the whole texts are used.

Defined cases: a null or empty text is one passage without words and gets a score like any other; labels that
are null take no part; of different labels of a document each counts, equal rows count once; without labels of both kinds every score is
the share of label 1 (0.5 without any labels). Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .runtime import fresh, ship
from .textops import as_bytes, chunks, mix, word_hashes, word_spans

PASSAGE = 64
MAX_LABELS = 4000
MAX_BYTES = 64 << 20
THRESHOLD = 0.7
FEATURES = ("words", "word_bytes", "upper", "digit", "stop_mark", "symbol", "wide", "again", "again_2", "distinct", "seen_before", "marked_words", "short_words", "empty")
WORD_BINS = 64
#: Standard deviation at which the word bins reach the encoder, beside 1 of the other features; chosen on an inner
#: split of the training rows (weights 0.25 and more lost accuracy there).
WORD_WEIGHT = 0.1
WIDTH = len(FEATURES) + WORD_BINS

_CLASS = {
    "upper": [*range(65, 91)],
    "digit": [*range(48, 58)],
    "stop_mark": [ord(c) for c in ".,;:"],
    "symbol": [c for c in [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)] if chr(c) not in ".,;:'-"],
    "wide": [*range(128, 256)],
}


def passage_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (float32) and each row's first passage index (with an end)."""
    starts, ends, first = word_spans(data, offs)
    hashes, _ = word_hashes(data, offs)
    count = np.diff(first)
    bags = np.maximum(1, -(-count // PASSAGE))
    bag_at = np.concatenate([[0], np.cumsum(bags)])
    out = np.zeros((int(bag_at[-1]), WIDTH), np.float32)
    col = {f: i for i, f in enumerate(FEATURES)}
    out[bag_at[:-1][count == 0], col["empty"]] = 1
    if not len(starts):
        return out, bag_at
    row = np.repeat(np.arange(len(count)), count)
    inner = np.arange(len(starts)) - first[row]
    bag = bag_at[row] + inner // PASSAGE
    begin = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
    which = bag[begin]
    total = lambda x: np.add.reduceat(x, begin).astype(np.float32)
    size = (ends - starts).astype(np.float32)
    n, chars = np.diff(np.r_[begin, len(bag)]).astype(np.float32), total(size)
    out[which, col["words"]] = n / PASSAGE
    out[which, col["word_bytes"]] = chars / n / 10
    bins = np.bincount(bag * WORD_BINS + (hashes % np.uint64(WORD_BINS)).astype(np.int64), minlength=len(out) * WORD_BINS).reshape(-1, WORD_BINS)
    out[which, len(FEATURES) :] = np.sqrt(bins[which] / n[:, None])
    symbols = None
    for name, codes in _CLASS.items():
        hit = np.zeros(256, np.uint8)
        hit[codes] = 1
        run = np.concatenate([[0], np.cumsum(hit[data], dtype=np.int32)])
        of = run[ends] - run[starts]
        if name == "symbol":
            symbols = of
        out[which, col[name]] = total(of) / chars
    same = np.zeros(len(hashes), np.int32)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    out[which, col["again"]] = total(same) / n
    same[:] = 0
    same[2:] = (hashes[2:] == hashes[:-2]) & (row[2:] == row[:-2])
    out[which, col["again_2"]] = total(same) / n
    key = np.sort((bag.astype(np.uint64) << np.uint64(36)) | (hashes >> np.uint64(28)))
    fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    got, times = np.unique((key[fresh] >> np.uint64(36)).astype(np.int64), return_counts=True)
    out[got, col["distinct"]] = times
    out[which, col["distinct"]] /= n
    tri = hashes.copy()
    tri[2:] = mix(hashes[2:] + hashes[1:-1] * np.uint64(3) + hashes[:-2] * np.uint64(5))
    tri ^= mix(row.astype(np.uint64))
    order = np.argsort(tri, kind="stable")
    again = np.zeros(len(tri), np.int32)
    again[order[1:]] = tri[order[1:]] == tri[order[:-1]]
    again[first[:-1][count > 0]] = 0
    out[which, col["seen_before"]] = total(again) / n
    out[which, col["marked_words"]] = total((symbols > 0).astype(np.int32)) / n
    out[which, col["short_words"]] = total((size <= 1).astype(np.int32)) / n
    return out, bag_at


class BagModel:
    """Gated-attention bag classifier; forward and backward passes in numpy."""

    def __init__(self, seed: int = 5, hidden: int = 16, gate: int = 8):
        r, d = np.random.default_rng(seed), WIDTH
        self.mean, self.dev, self.flat = np.zeros(d), np.ones(d), None
        self.w = {"W": r.normal(0, d**-0.5, (d, hidden)), "b": np.zeros(hidden), "V": r.normal(0, hidden**-0.5, (hidden, gate)), "U": r.normal(0, hidden**-0.5, (hidden, gate)), "a": r.normal(0, gate**-0.5, gate), "o": r.normal(0, hidden**-0.5, hidden), "c": np.zeros(1)}

    def forward(self, x: np.ndarray, at: np.ndarray):
        w = self.w
        h = np.tanh(x @ w["W"] + w["b"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (v * u) @ w["a"]
        size = np.diff(at)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at[:-1]), size))
        att = e / np.repeat(np.add.reduceat(e, at[:-1]), size)
        z = np.add.reduceat(att[:, None] * h, at[:-1])
        p = 1 / (1 + np.exp(-np.clip(z @ w["o"] + w["c"], -30, 30)))
        return p, (h, v, u, att, z)

    def gradients(self, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of the bags' labels."""
        w, size = self.w, np.diff(at)
        p, (h, v, u, att, z) = self.forward(x, at)
        dl = (p - y) / len(y)
        g = {"o": z.T @ dl, "c": np.array([dl.sum()])}
        dz = np.repeat(dl[:, None] * w["o"], size, 0)
        datt = (dz * h).sum(1)
        de = att * (datt - np.repeat(np.add.reduceat(att * datt, at[:-1]), size))
        g["a"] = (v * u).T @ de
        dv, du = de[:, None] * w["a"] * u * (1 - v * v), de[:, None] * w["a"] * v * u * (1 - u)
        g["V"], g["U"] = h.T @ dv, h.T @ du
        dh = (att[:, None] * dz + dv @ w["V"].T + du @ w["U"].T) * (1 - h * h)
        return g | {"W": x.T @ dh, "b": dh.sum(0)}

    def scores(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(at) - 1, self.flat)
        return self.forward((x - self.mean) / self.dev, at)[0] if len(at) > 1 else np.zeros(0)

    def train(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 6) -> None:
        if not len(y) or y.min() == y.max():
            self.flat = float(y.mean()) if len(y) else 0.5
            return
        self.mean, self.dev = x.mean(0), x.std(0) + 1e-6
        self.dev[len(FEATURES) :] /= WORD_WEIGHT
        x = (x - self.mean) / self.dev
        r, w = np.random.default_rng(seed), self.w
        m, s = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
        kinds = [np.flatnonzero(y == 0), np.flatnonzero(y == 1)]
        for t in range(1, steps + 1):
            # both labels are drawn by the square root of their number, so that a rare one is seen often enough
            share = np.sqrt([len(k) for k in kinds])
            pick = np.concatenate([r.choice(k, max(1, int(batch * q))) for k, q in zip(kinds, share / share.sum(), strict=True)])
            size = np.diff(at)[pick]
            own = np.concatenate([[0], np.cumsum(size)])
            xb = x[np.repeat(at[pick] - own[:-1], size) + np.arange(own[-1])]
            g = self.gradients(xb, own, y[pick])
            for k in w:
                d = g[k] + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                s[k] = 0.999 * s[k] + 0.001 * d * d
                w[k] = w[k] - rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)


def fold(id_: Column, of: int) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % of


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = MAX_LABELS, max_bytes: int = MAX_BYTES) -> BagModel:
    """Train on at most ``max_labels`` labelled rows with ``max_bytes`` of text; their passages' features go to the driver.

    A row is an id, a label and a text, so repeated rows are one. The sample is chosen from these keys in the order of a
    hash; its texts are learned from whole.
    """
    spark = docs.sparkSession
    ship(spark)
    few = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).distinct()
    digest = F.md5(F.col("_id").cast("string").cast("binary"))
    few = few.orderBy(digest, "_id", "_y").limit(max_labels)
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_h", F.xxhash64(F.coalesce("_text", F.lit(""))))
    keys = named.select("_id", "_h", F.coalesce(F.octet_length("_text"), F.lit(0)).alias("_size")).join(F.broadcast(few), "_id").distinct()  # bounded by max_labels
    keys = keys.orderBy(digest, "_id", "_y", "_h").limit(max_labels).collect()
    own, total = [], 0
    for r in keys:
        if total + r["_size"] <= max_bytes:
            total += r["_size"]
            own.append((r["_id"], r["_h"], r["_y"]))
    few = spark.createDataFrame(own, f"_id {named.schema['_id'].dataType.simpleString()}, _h long, _y int")
    rows = named.join(F.broadcast(few), ["_id", "_h"]).groupBy("_id", "_h", "_y").agg(F.first("_text").alias("_text"))  # as bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = as_bytes(b.column(1))
            for i, j in chunks(offs):
                x, at = passage_features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_pydict({"id": b.column(0).slice(i, j - i).cast(pa.string()), "y": b.column(2).slice(i, j - i), "x": [x[at[r] : at[r + 1]].tobytes() for r in range(j - i)]})

    got = sorted(rows.select("_id", "_text", "_y").mapInArrow(run, "id string, y int, x binary").collect(), key=lambda r: (r["id"], r["y"], r["x"]))
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in got]
    model = BagModel()
    x = np.concatenate(bags) if bags else np.zeros((0, WIDTH))
    model.train(x.astype(np.float64), np.concatenate([[0], np.cumsum([len(b) for b in bags], dtype=np.int64)]), np.array([r["y"] for r in got], float))
    return model


def score(docs: DataFrame, model: BagModel, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the column ``out_col``: the probability of label 1."""
    ship(docs.sparkSession)
    names = docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = as_bytes(b.column(place))
            parts = [model.scores(*passage_features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])) for i, j in chunks(offs)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], names=[*plain, "score"])

    plain = [f"c{i}" for i in range(len(names))]  # columns of any names
    kinds = [StructField(c, f.dataType) for c, f in zip(plain, docs.schema, strict=True)]
    return docs.toDF(*plain).mapInArrow(run, StructType([*kinds, StructField("score", DoubleType())])).toDF(*names, out_col)


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; rows with crc32(doc_id) % 4 = 2 are not learned from."""
    model = fit(docs, labels.where(fold(F.col("doc_id"), 4) != 2), max_labels=max_labels)
    scored = score(docs.select("doc_id", "text"), model)
    # the text is dropped in the same Python pass's projection
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns, whatever these are called."""
    model = fit(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    (own,) = fresh(docs.columns, "quality")
    return score(docs, model, out_col=own).where(F.col(own) >= threshold).drop(own)
