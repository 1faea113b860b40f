"""Language identification with a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a window of UTF-8 bytes forwards and backwards; a softmax over both states labels
every byte with a language. Documents are cut into windows of ``WINDOW`` bytes, each read from a zero state, so
that windows of many documents are one batch; a document's probabilities are the mean of its bytes' ones. The
weights are trained here by backpropagation through time in numpy on a bounded sample of rows: of each language
those with the smallest hashes of their ids, ``DOCS`` of them with ``BYTES`` of text at most (``ROWS`` rows of all
languages). Their texts are learned from whole: every window of them is seen.

Defined cases: a null text or one without any letter is ``und`` with score 0; rows without a language are not
learned from; without any learnable row every answer is ``und``. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import fold
from .runtime import ship
from .textops import as_bytes, chunks

HIDDEN = 8
WINDOW = 128
DOCS = 160
BYTES = 1 << 20
ROWS = 1 << 16
STEPS = 220
BATCH = 96


class ByteTagger:
    """Gates are piecewise linear, ``clip(0.2 x + 0.5, 0, 1)``; states are kept feature by row."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 3):
        r, h, n = np.random.default_rng(seed), hidden, max(1, len(langs))
        self.langs, self.h = langs, hidden
        self.w = {"out": r.normal(0, (2 * h) ** -0.5, (n, 2 * h)), "bias": np.zeros((n, 1))}
        for d in "fb":
            self.w |= {f"emb_{d}": r.normal(0, 0.5, (3 * h, 256)), f"gate_{d}": r.normal(0, h**-0.5, (2 * h, h)), f"cand_{d}": r.normal(0, h**-0.5, (h, h))}

    def _walk(self, ids: np.ndarray, d: str, w: dict, mask: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (time, hidden, batch) in reading order of direction d; ids and mask are (time, batch)."""
        h, n = self.h, ids.shape[1]
        emb, gate, cand = w[f"emb_{d}"], w[f"gate_{d}"], w[f"cand_{d}"]
        state = np.zeros((h, n), emb.dtype)
        out = np.empty((len(ids), h, n), emb.dtype)
        for t in range(len(ids)) if d == "f" else range(len(ids) - 1, -1, -1):
            a = np.take(emb, ids[t], axis=1)
            g = gate @ state
            g += a[: 2 * h]
            raw = g.copy() if trace is not None else None
            g *= 0.2
            g += 0.5
            np.clip(g, 0.0, 1.0, out=g)
            c = cand @ (g[h:] * state)
            c += a[2 * h :]
            np.tanh(c, out=c)
            new = c - state
            new *= g[:h]
            new *= mask[t]
            new += state
            if trace is not None:
                trace.append((t, state, raw, g, c))
            state = out[t] = new
        return out

    def probs(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sums over the first ``size`` bytes of each window of the language probabilities: (windows, languages)."""
        w = {k: v.astype(np.float32) for k, v in self.w.items()}
        ids = np.ascontiguousarray(ids.T)
        mask = (np.arange(len(ids))[:, None] < size[None, :]).astype(np.float32)
        f, b = self._walk(ids, "f", w, mask), self._walk(ids, "b", w, mask)
        total = np.zeros((len(self.langs), ids.shape[1]), np.float64)
        for t in range(len(ids)):
            s = w["out"][:, : self.h] @ f[t]
            s += w["out"][:, self.h :] @ b[t]
            s += w["bias"]
            s -= s.max(0)
            np.exp(s, out=s)
            s *= mask[t] / s.sum(0)
            total += s
        return total.T

    def gradients(self, ids: np.ndarray, size: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy at every byte, by backpropagation through time."""
        w, h = self.w, self.h
        x, n = np.ascontiguousarray(ids.T), len(y)
        mask = (np.arange(len(x))[:, None] < size[None, :]).astype(float)
        traces: dict[str, list] = {"f": [], "b": []}
        states = {d: self._walk(x, d, w, mask, traces[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], 1)
        z = np.einsum("lk,tkn->tln", w["out"], both) + w["bias"]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[:, y, np.arange(n)] -= 1
        p *= mask[:, None, :] / mask.sum()
        g = {"out": np.einsum("tln,tkn->lk", p, both), "bias": p.sum((0, 2))[:, None]}
        back = np.einsum("lk,tln->tkn", w["out"], p)
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            gate, cand = w[f"gate_{d}"], w[f"cand_{d}"]
            de, dg, dc = np.zeros((256, 3 * h)), np.zeros_like(gate), np.zeros_like(cand)
            ds = np.zeros((h, n))
            for t, state, raw, gt, c in reversed(traces[d]):
                ds = ds + back[t, part]
                on = ds * mask[t]
                dz, dcand = on * (c - state), on * gt[:h] * (1 - c * c)
                dr_state = cand.T @ dcand
                slope = 0.2 * ((raw > -2.5) & (raw < 2.5))
                draw = np.concatenate([dz, dr_state * state]) * slope
                dc += dcand @ (gt[h:] * state).T
                dg += draw @ state.T
                np.add.at(de, x[t], np.concatenate([draw, dcand]).T)
                ds = ds - on * gt[:h] + dr_state * gt[h:] + gate.T @ draw
            g |= {f"emb_{d}": de.T, f"gate_{d}": dg, f"cand_{d}": dc}
        return g

    def byte_probs(self, data: np.ndarray) -> np.ndarray:
        """The label probabilities of every byte of one window: (bytes, languages)."""
        ids, mask = data[:, None], np.ones((len(data), 1))
        both = np.concatenate([self._walk(ids, "f", self.w, mask), self._walk(ids, "b", self.w, mask)], 1)[:, :, 0]
        z = both @ self.w["out"].T + self.w["bias"][:, 0]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def train(self, ids: np.ndarray, size: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 4) -> None:
        """Backpropagation through time; the loss is the cross entropy at every byte."""
        r, w = np.random.default_rng(seed), self.w
        m, s = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
        kinds = [k for k in (np.flatnonzero(y == i) for i in range(len(self.langs))) if len(k)]
        each = -(-batch // len(kinds))
        steps = max(steps, -(-max(map(len, kinds)) // each))  # each window is seen
        runs = [np.concatenate([r.permutation(k) for _ in range(-(-steps * each // len(k)))]) for k in kinds]
        for step in range(1, steps + 1):
            pick = np.concatenate([k[(step - 1) * each : step * each] for k in runs])
            g = self.gradients(ids[pick], size[pick], y[pick])
            norm = np.sqrt(sum((v * v).sum() for v in g.values()))
            for k in w:
                v = g[k] / max(1.0, norm)
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v * v
                w[k] = w[k] - rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)


def windows(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte windows of all rows, each one's bytes in use, and each row's first window index (with an end)."""
    size = np.diff(offs)
    n = -(-size // width)
    at = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(size)), n)
    start = offs[:-1][row] + (np.arange(at[-1]) - at[row]) * width
    used = np.minimum(width, offs[1:][row] - start)
    pad = np.concatenate([data, np.zeros(width, np.uint8)])
    return pad[start[:, None] + np.arange(width)], used, at


def chosen(rows: list, most: int) -> list:
    """Of rows (group, bytes, ...) in order those that fit into ``most`` bytes of their group; one that does not is passed over."""
    out, used = [], {}
    for r in rows:
        if used.get(r[0], 0) + r[1] <= most:
            used[r[0]] = used.get(r[0], 0) + r[1]
            out.append(r)
    return out


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = DOCS, most_bytes: int = BYTES, steps: int = STEPS) -> ByteTagger:
    """Train on the whole texts of ``per_lang`` rows of every language in ``docs``, ``most_bytes`` of them at most.

    A row is an id, a language and a text, so repeated rows are one. The sample is chosen from these keys, without texts.
    """
    spark = docs.sparkSession
    ship(spark)
    digest = F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")).cast("binary"))
    named = docs.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0) & F.col(id_col).isNotNull())
    named = named.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    keys = named.select("_id", "_lang", "_h", F.octet_length("_text").alias("_size")).where(F.col("_size") <= most_bytes).distinct()
    order = Window.partitionBy("_lang").orderBy(digest, "_id", "_h")
    keys = keys.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_lang)
    few = keys.orderBy("_n", "_lang").limit(ROWS).select("_lang", "_size", "_id", "_h", "_n").collect()
    few = chosen(sorted(few, key=lambda r: (r["_lang"], r["_n"])), most_bytes)
    kind = named.schema["_id"].dataType.simpleString()
    few = spark.createDataFrame([(r["_id"], r["_lang"], r["_h"]) for r in few], f"_id {kind}, _lang string, _h long")
    rows = named.join(F.broadcast(few), ["_id", "_lang", "_h"])  # at most ROWS rows of an id, a language and a hash
    got = rows.groupBy("_id", "_lang", "_h").agg(F.first("_text").alias("_text")).select("_lang", "_text").collect()
    got = sorted((r["_lang"], r["_text"].encode()) for r in got)
    langs = sorted({lang for lang, _ in got})
    model = ByteTagger(langs)
    if len(langs) > 1:
        offs = np.cumsum([0, *(len(t) for _, t in got)])
        x, used, at = windows(np.frombuffer(b"".join(t for _, t in got), np.uint8), offs, WINDOW)
        model.train(x, used, np.repeat([langs.index(lang) for lang, _ in got], np.diff(at)), steps=steps)
    return model


def predict(docs: DataFrame, model: ByteTagger, *, id_col: str = "doc_id", text_col: str = "text", byte_labels: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; the score is the mean probability of the language over all bytes."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    langs = model.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = as_bytes(b.column(1))
            letter = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            for i, j in chunks(offs) if langs else ():
                x, used, at = windows(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], WINDOW)
                if not len(x):
                    continue
                step = 8192
                p = np.concatenate([model.probs(x[k : k + step], used[k : k + step]) for k in range(0, len(x), step)])
                run_ = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0)])
                mean = (run_[at[1:]] - run_[at[:-1]]) / np.maximum(1, np.diff(offs[i : j + 1]))[:, None]
                best[i:j], score[i:j] = mean.argmax(1), mean.max(1)
            known = letter & (best >= 0)
            pred = [langs[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0), pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows with crc32(doc_id) % 3 = 1 are not learned from."""
    model = fit(docs.where(fold(F.col("doc_id"), 3) != 1))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
