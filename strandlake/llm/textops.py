"""Vectorised byte, word and shingle primitives over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are expanded to 64-bit work arrays at a time; a longer text goes alone.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256).astype(U)[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_POWER: dict[int, np.ndarray] = {}


def _powers(n: int, inverse: bool) -> np.ndarray:
    """base ** i modulo 2**64 for i < n, or of the base's inverse."""
    got = _POWER.get(int(inverse))
    if got is None or len(got) < n:
        base = pow(_BASE, -1, 2**64) if inverse else _BASE
        got = np.full(max(n, 1 << 16), base, U)
        got[0] = 1
        got = np.multiply.accumulate(got)
        _POWER[int(inverse)] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and row offsets into them; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    base, end = int(offs[0]), int(offs[-1])
    data = np.frombuffer(data, np.uint8, end)[base:] if data is not None and end > base else np.zeros(0, np.uint8)
    return data, offs - base


def chunks(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes come to about ``size``; every row is in one of them."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row the index of its first word (with an end)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = ink[1:]
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word with A-Z lowered, and each row's first word index."""
    starts, ends, first = word_spans(data, offs)
    if not len(starts):
        return np.zeros(0, U), first
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_VALUE[data] * _powers(len(data), False), out=total[1:])
    h = (total[ends] - total[starts]) * _powers(len(data), True)[starts]
    return mix(h ^ ((ends - starts).astype(U) * U(0xD6E8FEB86659FD93))), first


_STEP = [U(0x8CB92BA72F3D8DD7), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x589965CC75374CC3), U(0x1D8E4E27C47D124F)]


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row, joined, and row offsets into them.

    A row with fewer than ``words`` words has its whole sequence as one shingle; one without words has none.
    """
    w, first = word_hashes(data, offs)
    count = np.diff(first)
    n = len(count)
    many = np.maximum(count - words + 1, 0)
    few = (count > 0) & (count < words)
    sizes = np.where(few, 1, many)
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(at[-1]), U)
    if len(w) >= words:
        full = np.zeros(len(w) - words + 1, U)
        for k in range(words):
            full = (full + w[k : k + len(full)]) * _STEP[k % 5]
            full ^= full >> U(29)
        full = mix(full)
        keep = np.repeat(many > 0, many)
        src = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(many)])[:-1], many) + np.arange(int(many.sum()))
        dst = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(many)])[:-1], many) + np.arange(int(many.sum()))
        out[dst[keep]] = full[src[keep]]
    for r in np.flatnonzero(few):
        h = int(count[r])
        for x in w[first[r] : first[r + 1]]:
            h = (h * int(_STEP[0]) + int(x)) % 2**64
        out[at[r]] = mix(np.array([h ^ 0x5BF03635], U))[0]
    parts = [np.unique(out[at[r] : at[r + 1]]) for r in range(n)]
    sets = np.concatenate(parts) if parts else out
    return sets, np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
