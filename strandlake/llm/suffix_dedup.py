"""Removal of repeated byte strings with suffix arrays built by external induced sorting.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Cutting the work into shards
loses nothing: every ``length``-byte string is keyed by the smallest hash of the 32-byte strings inside it, which
depends on its content alone, so equal strings meet in one shard. Neighbouring starts with the same key form a
segment (at most ``RUN`` starts). A key with one segment in the corpus that isn't periodic has no repeat; equal
segments are one entry with a count. Segments of keys that more than one distinct segment shares are sorted.
A key with more than ``HOT`` segments (a line shorter than ``length`` that very many documents hold) is split first:
equal strings have the key's gram at the same offset, so a segment is cut into blocks of neighbouring offsets, and the
bytes that all strings of a block share, longer than the gram, become the new key. Blocks of one string end this.

A shard's segments are one byte string. Its suffixes are sorted by induction: the order of the leftmost S-type
suffixes is found by ranking S-type substrings and doubling the ranked span until it covers ``length`` bytes;
then all L-type suffixes are induced in a forward and all S-type ones in a backward pass. Both passes work
through disk-backed priority queues, one run list for each first byte, of which items leave in order in batches:
an item is a suffix with its common-prefix length with the item before it, and the one it induces gets one more
than the least such length in between. What the queues hold beyond ``QUEUE_BYTES`` is in a file. Two neighbours
with a common prefix of ``length`` bytes are repeats.

All else that grows with the text (its symbols and types, the S-type suffixes, their ranks, order and common
prefixes) is in arrays that are files of the task beyond ``SPACE_BYTES``, gone through in blocks of ``BLOCK`` items; a
group of equal ranks beyond a block is dealt out by sampled splitters, and again, until its parts fit. So a sort's
memory does not follow its text.

The recursion on ranked S-type substrings goes by ranks: each round ranks spans of twice as many substrings from
pairs of ranks, until they cover ``length`` bytes. Inducing each level with queues of its own would give
queues of so many symbols that batches hold a few items each.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; repeated rows repeat each other's
bytes; an empty table gives an empty result. Other columns are not looked at; one with the name of a new column is
replaced by it. Rows are told apart by 96 bits of hashes of id and text and one of ``SALTS`` numbers that copies take in turn (rows
equal in all three share their ranges, and no bucket has all copies of a row), and segments by a 64-bit hash beside their key. A segment that doesn't fit its row is an error.

The rows are written once, dealt to buckets by their hash; every later join with them reads that table without
moving texts again.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .runtime import Scratch, partitions
from .textops import _powers, as_bytes, chunks, mix

U = np.uint64
LENGTH = 200
GRAM = 32
RUN = 169
SHARD_BYTES = 2 << 20
HOT = 2048
BLOCKS = (24, 1)
QUEUE_BYTES = 1 << 19
SALTS = 64
#: Bytes of a sort's arrays that are in memory; the others are in files.
SPACE_BYTES = 64 << 20
#: Items that are taken at a time: of the arrays, of the queues, and of suffixes that are compared.
BLOCK = 1 << 19
BATCH = 1 << 19
PAIRS = 1 << 16
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 16

_CODE = np.random.default_rng(977).integers(1, 2**63, 256).astype(U)


def _content(total: np.ndarray, back: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of ``size`` bytes from ``begin`` on, from running totals."""
    return mix((total[begin + size] - total[begin]) * back[begin] ^ (size.astype(U) * U(0xC2B2AE3D27D4EB4F)))


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running totals of the bytes' codes, inverse powers, and the hash of the ``GRAM`` bytes from each place on."""
    n = len(data)
    total = np.empty(n + 1, U)
    total[0] = 0
    np.take(_CODE, data, out=total[1:])
    np.multiply(total[1:], _powers(n, False), out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    back = _powers(n, True)
    gram = total[GRAM:] - total[:-GRAM]
    np.multiply(gram, back[: len(gram)], out=gram)
    return total, back, gram


def _window_min(x: np.ndarray, wide: int) -> np.ndarray:
    """min(x[i:i + wide]) for every i, from minima over powers of two."""
    step = 1
    while 2 * step <= wide:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = wide - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(data: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """key, content hash, row, start in the row, number of starts and periodicity of every segment of the rows.

    Two equal strings inside one segment overlap, so its content is periodic and its key's gram is there twice;
    ``periodic`` holds for all such segments.
    """
    n, wide = len(data), length - GRAM + 1
    none = tuple(np.zeros(0, t) for t in (U, U, np.int64, np.int64, np.int64, bool))
    rows = np.flatnonzero(np.diff(offs) >= length)
    if not len(rows):
        return none
    total, back, gram = _grams(data)
    least = _window_min(gram, wide)
    starts = n - length + 1
    change = np.empty(starts, bool)
    np.not_equal(least[1:], least[:-1], out=change[1:])
    change[offs[rows]] = True
    change[0] = True
    cut = np.flatnonzero(change)
    row = np.searchsorted(offs, cut, side="right") - 1
    stop = offs[row + 1] - length + 1
    count = np.minimum(np.r_[cut[1:], starts], stop) - cut
    inside = count > 0  # what is left of other starts crosses the end of a row
    cut, row, count = cut[inside], row[inside], count[inside]
    if (count > RUN).any():  # periodic content
        parts = -(-count // RUN)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        full = np.repeat(count, parts)
        cut, row, count = np.repeat(cut, parts) + inner * RUN, np.repeat(row, parts), np.minimum(RUN, full - inner * RUN)
    content = _content(total, back, cut, count + length - 1)
    # the gram at the segment's own starts, and at the ends of its last windows
    head_hit, tail_hit = np.zeros(starts + 1, np.int32), np.zeros(starts + 1, np.int32)
    np.cumsum(gram[:starts] == least, out=head_hit[1:])
    np.cumsum(gram[wide - 1 :] == least, out=tail_hit[1:])
    end = cut + count
    twice = head_hit[end] - head_hit[cut] + tail_hit[end] - tail_hit[np.maximum(cut, end - wide + 1)] > 1
    return least[cut], content, row, cut - offs[row], count, twice


def split(data: np.ndarray, begin: np.ndarray, count: np.ndarray, key: np.ndarray, grams: np.ndarray, block: int, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Segment, first start, number of starts, new key and content hash of every block of segments.

    ``grams`` are the segments' gram hashes, ``begin`` and ``count`` their starts in ``data``. The strings of one block have one gram position, so no two are equal.
    """
    total, back, gram = _grams(data)
    size = count + length - GRAM  # grams of a segment
    first = np.cumsum(size) - size
    seg = np.repeat(np.arange(len(begin)), size)
    place = np.arange(len(seg))
    pos = begin[seg] + place - first[seg]
    hit = np.where(gram[pos] == grams[seg], place, len(seg))
    hit = np.minimum.accumulate(hit[::-1])[::-1]
    own = place - first[seg] < count[seg]
    seg, start, at = seg[own], pos[own], pos[hit[own]]
    part = (at - start) // block
    new = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (at[1:] != at[:-1]) | (part[1:] != part[:-1])])
    starts = np.diff(np.r_[new, len(seg)])
    lo = at[new] - part[new] * block
    core = _content(total, back, lo, np.full(len(new), length - block + 1))
    core = mix(core ^ (part[new].astype(U) + U(1)) * U(0x9E3779B97F4A7C15) ^ U(block))
    return seg[new], start[new], starts, core, _content(total, back, start[new], starts + length - 1)


class Runs:
    """A bucket's items in the order in which they came, in memory up to the pool's bound and beyond it in its file."""

    def __init__(self, pool: Pool):
        self.pool, self.blocks, self.taken = pool, [], 0

    def push(self, at: np.ndarray, lcp: np.ndarray) -> None:
        if not len(at):
            return
        size = at.nbytes + lcp.nbytes
        if self.pool.held + size > self.pool.bound:
            self.blocks.append((self.pool.write(at.tobytes() + lcp.tobytes()), len(at), at.dtype))
        else:
            self.blocks.append((at, lcp))
            self.pool.held += size

    def load(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        b = self.blocks[k]
        if len(b) == 2:
            return b
        place, n, kind = b
        data = self.pool.read(place, n * (kind.itemsize + 1))
        return np.frombuffer(data, kind, n), np.frombuffer(data, np.uint8, n, n * kind.itemsize)

    def _size(self, k: int) -> int:
        b = self.blocks[k]
        return len(b[0]) if len(b) == 2 else b[1]

    def _join(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.load(k) for k in range(i, j)]
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def pop(self):
        """The waiting items in order, up to ``BATCH`` unless one block has more, or None; they stay readable."""
        i = j = self.taken
        size = 0
        while j < len(self.blocks) and (j == i or size + self._size(j) <= BATCH):
            size += self._size(j)
            j += 1
        self.taken = j
        return self._join(i, j) if i < j else None

    def backwards(self):
        """Batches from the last to the first; items in a batch are in order."""
        j = len(self.blocks)
        while j:
            i, size = j, 0
            while i and (i == j or size + self._size(i - 1) <= BATCH):
                size += self._size(i - 1)
                i -= 1
            yield self._join(i, j)
            j = i

    def free(self) -> None:
        self.pool.held -= sum(b[0].nbytes + b[1].nbytes for b in self.blocks if len(b) == 2)
        self.blocks = []


class Pool:
    """Memory that a sort's queues share, and the file of what is beyond it, of which each queue knows its blocks."""

    def __init__(self, folder: str | None, bound: int):
        self.file = tempfile.TemporaryFile(prefix="induce-", dir=folder, buffering=0)
        self.bound, self.held, self.spilled = bound, 0, 0

    def write(self, data: bytes) -> int:
        place = self.spilled
        if self.file.write(data) != len(data):
            raise OSError("a queue's block could not be written whole")
        self.spilled += len(data)
        return place

    def read(self, place: int, size: int) -> bytes:
        return os.pread(self.file.fileno(), size, place)

    def __enter__(self) -> Pool:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def _range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo:hi]) for non-empty ranges, by a table of minima over powers of two."""
    out = np.empty(len(lo), x.dtype)
    level = np.frexp((hi - lo).astype(float))[1] - 1
    table, k = x, 0
    for want in range(int(level.max(initial=0)) + 1):
        while k < want:
            step = 1 << k
            table = np.minimum(table[:-step], table[step:])
            k += 1
        use = np.flatnonzero(level == want)
        if len(use):
            out[use] = np.minimum(table[lo[use]], table[hi[use] - (1 << want)])
    return out


class _Scan:
    """Hands scanned items on to the queues of the suffixes they induce, with common-prefix lengths."""

    def __init__(self, text: np.ndarray, is_s: np.ndarray, s_pass: bool, queues: list[Runs], cap: int):
        self.text, self.is_s, self.s_pass, self.queues, self.cap = text, is_s, s_pass, queues, cap
        self.low = np.full(len(queues), 255, np.uint8)  # least length since the last push into a queue
        self.empty = np.ones(len(queues), bool)

    def feed(self, at: np.ndarray, lcp: np.ndarray) -> None:
        prev = at - 1
        use = np.flatnonzero((prev >= 0) & (self.is_s[prev] == self.s_pass))
        every = lcp.min() if len(lcp) else 255
        if not len(use):
            np.minimum(self.low, every, out=self.low)
            return
        char = self.text[prev[use]]
        order = np.argsort(char, kind="stable")
        use, char = use[order], char[order]
        first = np.r_[True, char[1:] != char[:-1]]
        lo = np.zeros(len(use), np.int64)
        lo[1:] = use[:-1] + 1
        lo[first] = 0
        got = _range_min(lcp, lo, use + 1)
        got[first] = np.minimum(got[first], self.low[char[first]])
        got = np.minimum(got, self.cap - 1) + np.uint8(1)
        begin = np.flatnonzero(first)
        got[begin[self.empty[char[begin]]]] = 0  # the first of its bucket shares nothing with the item before it
        self.empty[char[begin]] = False
        end = np.r_[begin[1:], len(use)]
        np.minimum(self.low, every, out=self.low)
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            c, last = int(char[b]), int(use[e - 1]) + 1
            self.low[c] = lcp[last:].min() if last < len(lcp) else 255
            self.queues[c].push(prev[use[b:e]].astype(np.int32), got[b:e])


class Space:
    """Arrays of a sort: in memory while they fit into a bound together, else in files of the task that go with them."""

    def __init__(self, folder: str | None, bound: int):
        self.folder, self.left, self.filed = folder, bound, 0

    def array(self, size: int, kind) -> np.ndarray:
        """Zeros."""
        need = size * np.dtype(kind).itemsize
        if need <= self.left:
            self.left -= need
            return np.zeros(size, kind)
        self.filed += need
        with tempfile.TemporaryFile(prefix="suffix-", dir=self.folder, buffering=0) as f:
            f.truncate(max(1, need))
            return np.memmap(f, kind, "r+", shape=(max(1, size),))[:size]


def _steps(n: int, size: int | None = None) -> Iterator[tuple[int, int]]:
    size = size or BLOCK
    return ((i, min(i + size, n)) for i in range(0, n, size))


def _types(text: np.ndarray, n: int, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """S-type flags, lengths of runs of equal symbols (up to 255) and the leftmost S-type places."""
    is_s, run = space.array(n, bool), space.array(n, np.uint8)
    for lo, hi in reversed([*_steps(n)]):
        x = text[lo:hi]
        end = np.r_[np.flatnonzero(x[1:] != x[:-1]), hi - lo - 1]  # of runs within the block
        size = np.diff(np.r_[-1, end])
        s = np.empty(len(end), bool)
        s[:-1] = x[end[:-1]] < x[end[:-1] + 1]
        more = 0  # of the last run in the next block
        if hi == n:
            s[-1] = True
        elif text[hi] == x[-1]:
            s[-1], more = is_s[hi], int(run[hi])
        else:
            s[-1] = x[-1] < text[hi]
        is_s[lo:hi] = np.repeat(s, size)
        length = np.repeat(end, size) - np.arange(hi - lo) + 1
        length[hi - lo - size[-1] :] += more
        run[lo:hi] = np.minimum(length, 255)
    found = lambda lo, hi: np.flatnonzero(is_s[max(lo, 1) : hi] & ~is_s[max(lo, 1) - 1 : hi - 1]) + max(lo, 1)
    lms, at = space.array(sum(len(found(lo, hi)) for lo, hi in _steps(n)), np.int32), 0
    for lo, hi in _steps(n):
        got = found(lo, hi)
        lms[at : at + len(got)] = got
        at += len(got)
    return is_s, run, lms


def _sorted_parts(items: np.ndarray, keys: np.ndarray, space: Space) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``items`` by their ``keys`` in parts of ``BLOCK``. More than that are dealt out by sampled splitters first, a splitter's own key apart."""
    n = len(items)
    if n <= BLOCK:
        order = np.argsort(keys, kind="stable")
        yield np.asarray(items)[order], np.asarray(keys)[order]
        return
    split = np.unique(np.sort(keys[:: max(1, n // 4096)])[:: 4096 // 64])

    def place(k: np.ndarray) -> np.ndarray:
        i = np.searchsorted(split, k, side="left")
        return 2 * i + ((i < len(split)) & (split[np.minimum(i, len(split) - 1)] == k))

    count = np.zeros(2 * len(split) + 1, np.int64)
    for lo, hi in _steps(n):
        count += np.bincount(place(keys[lo:hi]), minlength=len(count))
    start = np.cumsum(count) - count
    own, dealt, at = space.array(n, items.dtype), space.array(n, keys.dtype), start.copy()
    for lo, hi in _steps(n):
        of = place(keys[lo:hi])
        order = np.argsort(of, kind="stable")
        first = np.r_[True, of[order][1:] != of[order][:-1]]
        begin = np.flatnonzero(first)
        to = at[of[order]] + np.arange(hi - lo) - np.repeat(begin, np.diff(np.r_[begin, hi - lo]))
        own[to], dealt[to] = items[lo:hi][order], keys[lo:hi][order]
        at += np.bincount(of, minlength=len(count))
    for k, size in enumerate(count.tolist()):
        if size and k % 2:  # all of one key
            for lo, hi in _steps(size):
                yield own[start[k] + lo : start[k] + hi], dealt[start[k] + lo : start[k] + hi]
        elif size:
            yield from _sorted_parts(own[start[k] : start[k] + size], dealt[start[k] : start[k] + size], space)


def _refine(order: np.ndarray, rank: np.ndarray, live: np.ndarray, key_of, over, space: Space) -> np.ndarray:
    """Sort the items at the places ``live`` of ``order`` within their groups of equal rank by ``key_of(items)``, and rank them anew.

    A rank is the first place of its group. Gives the places still to be sorted: those in a group with others for which ``over(items)``
    does not hold.
    """
    left, kept, at, n = space.array(len(live), np.int32), 0, 0, len(live)

    def settle(place: np.ndarray, items: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Places in order with their items, the places where their runs begin, and how many each run has."""
        nonlocal kept
        order[place], rank[items] = items, begin
        stay = place[(size > 1) & ~over(items)]
        left[kept : kept + len(stay)] = stay
        kept += len(stay)

    while at < n:
        upto = min(at + BLOCK, n)
        place = np.asarray(live[at:upto])
        items = order[place]
        base = rank[items]
        if upto < n:  # up to the end of the last whole group
            cut = int(np.searchsorted(base, base[-1]))
            if cut == 0 and rank[order[live[upto]]] == base[0]:
                cut = None
            elif cut and rank[order[live[upto]]] == base[-1]:
                place, items, base = place[:cut], items[:cut], base[:cut]
        else:
            cut = len(base)
        if cut is not None:
            key = key_of(items)
            by = np.lexsort((key, base))
            items, key = items[by], key[by]
            new = np.r_[True, (base[1:] != base[:-1]) | (key[1:] != key[:-1])]
            first = np.flatnonzero(new)
            size = np.diff(np.r_[first, len(items)])
            settle(place, items, np.repeat(place[first], size), np.repeat(size, size))
            at += len(items)
            continue
        group, end = int(base[0]), upto  # one group beyond a block; its places follow each other
        while end < n:
            more = rank[order[live[end : min(end + BLOCK, n)]]]
            same = int(np.searchsorted(more, group, side="right"))
            end += same
            if same < len(more):
                break
        many = end - at
        ids, keys = space.array(many, np.int32), space.array(many, np.uint64)
        for lo, hi in _steps(many):
            ids[lo:hi] = order[live[at + lo : at + hi]]
            keys[lo:hi] = key_of(ids[lo:hi])
        sorted_, last, begin, done = space.array(many, np.int32), None, space.array(many, np.int32), 0
        for own, key in _sorted_parts(ids, keys, space):
            new = np.r_[last is None or key[0] != last, key[1:] != key[:-1]]
            first = np.where(new, np.arange(len(own)) + done, 0)
            if not new[0]:
                first[0] = begin[done - 1]
            sorted_[done : done + len(own)] = own
            begin[done : done + len(own)] = np.maximum.accumulate(first)
            last, done = key[-1], done + len(own)
        for lo, hi in _steps(many):
            b = np.asarray(begin[lo:hi])
            alone = (b == np.arange(lo, hi)) & (np.r_[begin[lo + 1 : hi], begin[hi] if hi < many else many] != b)
            settle(np.arange(group + lo, group + hi), np.asarray(sorted_[lo:hi]), group + b, np.where(alone, 1, 2))
        at = end
    return left[:kept]


def _lms_order(text: np.ndarray, n: int, lms: np.ndarray, length: int, space: Space) -> np.ndarray:
    """Numbers of the leftmost S-type suffixes, ordered by their first ``length`` symbols or more."""
    m = len(lms)
    order, rank, live = (space.array(m, np.int32) for _ in range(3))
    for lo, hi in _steps(m):
        order[lo:hi] = live[lo:hi] = np.arange(lo, hi)

    def span(items: np.ndarray) -> np.ndarray:
        return np.where(items + 1 < m, lms[np.minimum(items + 1, m - 1)] - lms[items] + 1, 1)

    depth = 0

    def symbols(items: np.ndarray) -> np.ndarray:
        """Six symbols of an S-type substring from ``depth`` on; what is beyond its end is larger than all."""
        key, size, at = np.zeros(len(items), U), span(items), lms[items].astype(np.int64) + depth
        for d in range(6):
            key = (key << U(9)) | np.where(depth + d < size, text[np.minimum(at + d, n)].astype(U), U(511))
        return key

    while len(live) and depth < length + 8:
        live = _refine(order, rank, live, symbols, lambda items: depth + 6 > span(items), space)  # noqa: B023
        depth += 6
    step = 1
    while 2 * step <= length + 1 and step < m:  # ranks cover ``step`` substrings, each of which has two symbols or more of its own
        live, at = space.array(m, np.int32), 0
        for lo, hi in _steps(m):
            r = rank[order[lo : min(hi + 1, m)]]
            own = r[: hi - lo]
            shared = (own != np.arange(lo, hi)) | (np.r_[r[1:], -1][: hi - lo] == own)
            got = np.flatnonzero(shared) + lo
            live[at : at + len(got)] = got
            at += len(got)
        if not at:
            break
        after = lambda items: np.where(items + step < m, rank[np.minimum(items + step, m - 1)] + 1, 0).astype(U)  # noqa: B023, E731
        _refine(order, rank, live[:at], after, lambda items: np.ones(len(items), bool), space)
        step *= 2
    return order


def _seed_lcp(text: np.ndarray, n: int, lms: np.ndarray, order: np.ndarray, cap: int, space: Space) -> np.ndarray:
    """Common-prefix lengths, up to ``cap``, of each suffix in ``order`` with the one before it, by the suffixes' numbers."""
    m = len(lms)
    before, out = space.array(m, np.int32), space.array(m, np.uint8)
    for lo, hi in _steps(m):
        before[order[lo:hi]] = np.r_[order[lo - 1] if lo else -1, order[lo : hi - 1]]
    for lo, hi in _steps(m, PAIRS):
        other = np.asarray(before[lo:hi])
        use = np.flatnonzero(other >= 0)
        out[lo + use] = _match(text, n, lms[lo + use].astype(np.int64), lms[other[use]].astype(np.int64), cap)
    return out


def _match(text: np.ndarray, n: int, pos: np.ndarray, other: np.ndarray, cap: int) -> np.ndarray:
    """Common-prefix lengths of suffixes at ``pos``, ascending, with those at ``other``, up to ``cap``. ``text`` has 32 symbols beyond its n.

    Suffixes next to each other in the text that have their neighbours at the same distance match up to the same
    place, so only the first of such a run is compared, up to ``cap`` symbols beyond the last.
    """
    if not len(pos):
        return np.zeros(0, np.uint8)
    wide = 32
    block = np.lib.stride_tricks.sliding_window_view(text, wide)
    ends = np.zeros(len(pos), np.int64)  # where a suffix's match ends
    head = np.r_[True, np.diff(pos - other) != 0]
    while head.any():
        first = np.flatnonzero(head)
        last = np.r_[first[1:], len(pos)] - 1
        if len(live := np.flatnonzero(ends[first] == 0)):
            depth = np.zeros(len(first), np.int64)
            most = pos[last] - pos[first] + cap
            while len(live):
                p = pos[first[live]] + depth[live]
                q = other[first[live]] + depth[live]
                ok = np.maximum(p, q) < n  # the text's last symbol is alone, so matches end before it
                differ = block[np.minimum(p, n)] != block[np.minimum(q, n)]
                hit = differ.any(1) | ~ok
                depth[live] += np.where(hit, np.where(ok, differ.argmax(1), 0), wide)
                live = live[~hit & (depth[live] < most[live])]
            new = ends[first] == 0
            ends[first[new]] = pos[first[new]] + depth[new] + 1
        run = np.cumsum(head) - 1
        reach = ends[first][run]
        over = (reach - 1 <= pos) & ~head  # the match ended before this suffix: it begins a run of its own
        if not over.any():
            break
        begin = over & ~np.r_[False, over[:-1]]
        head |= begin
    return np.clip(reach - 1 - pos, 0, cap).astype(np.uint8)


def repeated_starts(text: np.ndarray, length: int = LENGTH, queue_bytes: int = QUEUE_BYTES, folder: str | None = None, sink: list | None = None, space: Space | None = None) -> np.ndarray:
    """For a string of symbols 1 .. 500 ending in a single 0: where suffixes start that share ``length`` symbols with another.

    ``length`` is at most 254. With ``sink``, the suffix array and its capped common-prefix lengths are appended to it. A
    text of ``space`` has 32 zeros more, which are no part of it.
    """
    n, cap = len(text) - (0 if space is None else 32), length + 1
    if space is None:
        space = Space(folder, SPACE_BYTES)
        own = space.array(n + 32, np.uint16)
        own[:n] = text
        text = own
    flag = space.array(n, bool)
    if n < 2:
        return flag
    is_s, run, lms = _types(text, n, space)
    order = _lms_order(text, n, lms, length, space)
    prefix = _seed_lcp(text, n, lms, order, cap, space)
    symbols = max(int(text[lo:hi].max()) for lo, hi in _steps(n)) + 1
    count = np.zeros(symbols + 1, np.int64)
    for lo, hi in _steps(len(lms)):
        count[1:] += np.bincount(text[lms[lo:hi]], minlength=symbols)
    seed_at = np.cumsum(count)
    with Pool(folder, queue_bytes) as pool:
        larger = [Runs(pool) for _ in range(symbols)]
        scan = _Scan(text, is_s, False, larger, cap)
        for c in range(symbols):
            last = None
            while (got := larger[c].pop()) is not None:
                at, lcp = got
                flag[at[lcp >= length]] = True
                if last is not None and lcp[0] >= length:
                    flag[last] = True
                flag[at[:-1][lcp[1:] >= length]] = True
                last = at[-1]
                scan.feed(at, lcp)
            for i, j in _steps(seed_at[c + 1] - seed_at[c]):
                of = order[seed_at[c] + i : seed_at[c] + j]
                at, lcp = lms[of], prefix[of]
                if i == 0:
                    lcp[0] = 0 if last is None else min(cap, int(run[last]), int(run[at[0]]))
                scan.feed(at, lcp)
        smaller = [Runs(pool) for _ in range(symbols)]
        scan = _Scan(text, is_s, True, smaller, cap)
        for c in range(symbols - 1, -1, -1):
            last = None
            if c == 0:
                smaller[0].push(np.array([n - 1], np.int32), np.zeros(1, np.uint8))
            while (got := smaller[c].pop()) is not None:
                at, lcp = got
                flag[at[lcp >= length]] = True
                if last is not None and lcp[0] >= length:
                    flag[last] = True
                flag[at[:-1][lcp[1:] >= length]] = True
                last = at[-1]
                scan.feed(at, lcp)
            after = 0 if last is None else None
            for at, lcp in larger[c].backwards():
                down = np.empty_like(lcp)
                down[1:] = lcp[:0:-1]
                if after is None:
                    after = min(cap, int(run[last]), int(run[at[-1]]))
                    if after >= length:
                        flag[last] = flag[at[-1]] = True
                down[0] = after
                after = lcp[0]
                scan.feed(at[::-1], down)
            if sink is not None:
                sink.append((c, [larger[c].load(k) for k in range(len(larger[c].blocks))], [smaller[c].load(k) for k in range(len(smaller[c].blocks))]))
            larger[c].free()
            if sink is None:
                smaller[c].free()
    return flag


def _edges(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.r_[0, flag.astype(np.int8), 0])
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """rid, tag, lo, hi: byte ranges of the rows (rid, tag, text) that strings with another occurrence cover; they may overlap."""
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = as_bytes(b.column(2))
            rid, tag = b.column(0).to_numpy(), b.column(1).to_numpy()
            got = [(*segments(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], length), i) for i, j in chunks(offs, CHUNK)]
            key, content, start, count, periodic = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in (0, 1, 3, 4, 5))
            row = np.concatenate([g[2] + g[6] for g in got]) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(rid[row]), pa.array(tag[row]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(periodic.astype(bool))], names=["key", "content", "rid", "tag", "start", "count", "periodic"])

    found = scratch.save(docs.select("rid", "tag", "text").mapInArrow(cut, "key long, content long, rid long, tag int, start int, count int, periodic boolean"), "segments")
    shared = found.groupBy("key").agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"), F.max("periodic").alias("periodic")).where("n > 1 OR periodic")
    shared = scratch.save(shared.selectExpr("key", "lo <> hi OR n = 1 AS mixed", f"n > {hot} AS hot"), "shared")
    kept = scratch.save(found.drop("periodic").join(shared, "key"), "kept")
    scratch.drop("segments", "shared")
    entries = kept.where("mixed").groupBy("key", "content", "hot").agg(F.count("*").alias("times"), F.min(F.struct("rid", "tag", "start", "count")).alias("of"))
    entries = scratch.save(entries.select("key", "content", "times", "of.rid", "of.tag", "of.start", "of.count", "hot", F.col("key").alias("gram")), "entries")

    def fetch(wanted: DataFrame, work, schema: str) -> DataFrame:
        """``work`` on the bytes, their rows' bounds, the rows and the wanted segments' fields."""
        fields = ("start", "count", "key", "content", "times", "gram")
        per_row = wanted.groupBy("rid", "tag").agg(F.collect_list(F.struct(*fields)).alias("want")).withColumnsRenamed({"rid": "w_rid", "tag": "w_tag"}).hint("shuffle_hash")  # far smaller than the texts, which need no order
        whole = docs.join(per_row, (docs["rid"] == per_row["w_rid"]) & (docs["tag"] == per_row["w_tag"])).select("text", "want", "rid", "tag")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, offs = as_bytes(b.column(0))
                want = b.column(1)
                item = want.flatten()
                row = np.repeat(np.arange(b.num_rows), np.diff(want.offsets.to_numpy()))
                got = [item.field(k).to_numpy() for k in range(len(fields))]
                if (offs[row] + got[0] + got[1] + length - 1 > offs[row + 1]).any():
                    raise ValueError("a segment does not fit its row: two rows have equal hashes")
                yield from work(data, offs, row, (b.column(2).to_numpy(), b.column(3).to_numpy()), *got)

        return whole.mapInArrow(run, schema)

    def take(data, offs, row, rid, start, count, key, content, times, gram):
        begin = offs[row] + start
        texts = [data[s : s + n].tobytes() for s, n in zip(begin.tolist(), (count + length - 1).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(content), pa.array(times), pa.array(texts, pa.binary())], names=["key", "content", "times", "bytes"])

    def divide(block: int):
        names = ["key", "content", "times", "gram", "rid", "tag", "at", "start", "count", "key2", "content2"]

        def work(data, offs, row, rid, start, count, key, content, times, gram):
            for i, j in chunks(offs, CHUNK):
                use = np.flatnonzero((row >= i) & (row < j))
                if not len(use):
                    continue
                base = offs[row[use]] - offs[i]
                seg, begin, n, key2, content2 = split(data[offs[i] : offs[j]], base + start[use], count[use].astype(np.int64), key[use], gram[use].view(U), block, length)
                of, at = use[seg], begin - base[seg]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[of], content[of], times[of], gram[of], rid[0][row[of]], rid[1][row[of]], (at - start[of]).astype(np.int32), at.astype(np.int32), n.astype(np.int32), key2.view(np.int64), content2.view(np.int64))], names=names)

        return work

    layers, wholes, sorting, large = [], [], entries.where("NOT hot"), entries.where("hot")
    for k, block in enumerate(BLOCKS):
        if not large.head(1):
            break
        subs = scratch.save(fetch(large, divide(block), "key long, content long, times long, gram long, rid long, tag int, at int, start int, count int, key2 long, content2 long"), f"blocks-{k}")
        inner = subs.groupBy(F.col("key2").alias("key"), F.col("content2").alias("content")).agg(F.sum("times").alias("times"), F.min(F.struct("rid", "tag", "start", "count", "gram")).alias("of"))
        inner = scratch.save(inner.select("key", "content", "times", "of.rid", "of.tag", "of.start", "of.count", "of.gram"), f"inner-{k}")
        sizes = scratch.save(inner.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n")), f"sizes-{k}")  # a table, so that a skewed join with it can be split
        inner = inner.join(sizes, F.col("key") == F.col("_key")).drop("_key")
        wholes.append(inner.where("n = 1 AND times > 1").selectExpr("key", "content", "0 AS lo", "count AS hi"))
        sorting = sorting.unionByName(inner.where(f"n > 1 AND n <= {hot}").withColumn("hot", F.lit(False)).drop("n"))
        large = inner.where(f"n > {hot}")
        layers.append(subs)
    texts = fetch(sorting, take, "key long, content long, times long, bytes binary")
    total = (sorting.agg(F.sum(F.col("count") + length)).head()[0] or 0) // SHARD_BYTES + 1
    shards = max(partitions(spark), total)
    texts = texts.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))

    def sort(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        data, offs = as_bytes(table.column("bytes"))
        times = table.column("times").to_numpy()
        space = Space(None, SPACE_BYTES)
        text = space.array(len(data) + len(times) + 1 + 32, np.uint16)
        for i, j in chunks(offs, BLOCK):  # each segment with a 1 after it
            part, size = data[offs[i] : offs[j]], np.diff(offs[i : j + 1])
            own = np.ones(len(part) + j - i, np.uint16)
            own[np.arange(len(part)) + np.repeat(np.arange(j - i), size)] = part.astype(np.uint16) + 2
            text[offs[i] + i : offs[j] + j] = own
        text[len(data) + len(times)] = 0
        flag, found = repeated_starts(text, length, space=space), []
        for i, j in chunks(offs, BLOCK):
            start = offs[i : j + 1] - offs[i]
            size = np.diff(start)
            own = np.asarray(flag[offs[i] + i : offs[j] + j])[np.arange(start[-1]) + np.repeat(np.arange(j - i), size)]
            own |= np.repeat(times[i:j] > 1, size)
            # only a segment's own starts count; the last length - 1 bytes are there to be compared
            own[np.concatenate([np.arange(e - min(length - 1, e - s), e) for s, e in zip(start[:-1], start[1:], strict=True)])] = False
            lo, hi = _edges(own)
            row = np.searchsorted(start, lo, side="right") - 1
            found.append((i + row, lo - start[row], hi - start[row]))
        row, lo, hi = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        k, c = (table.column(x).to_numpy() for x in ("key", "content"))
        return pa.table({"key": k[row], "content": c[row], "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)})

    marks = texts.groupBy("shard").applyInArrow(sort, "key long, content long, lo int, hi int")
    marks = scratch.save(marks, "marks")
    for subs, all_starts in zip(reversed(layers), reversed(wholes), strict=True):
        found_in = marks.unionByName(all_starts).withColumnsRenamed({"key": "key2", "content": "content2"})
        marks = marks.unionByName(subs.select("key", "content", "at", "key2", "content2").join(found_in, ["key2", "content2"]).selectExpr("key", "content", "at + lo AS lo", "at + hi AS hi"))
    if layers:  # blocks that touch become one range again; a segment has at most RUN
        w = Window.partitionBy("key", "content").orderBy("lo", "hi")
        far = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
        marks = marks.withColumn("new", F.coalesce((F.col("lo") > far).cast("int"), F.lit(1))).withColumn("part", F.sum("new").over(w))
        marks = marks.groupBy("key", "content", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("part")
        marks = scratch.save(marks, "all-marks")
        scratch.drop("marks", *[f"{x}-{k}" for x in ("blocks", "inner", "sizes") for k in range(len(layers))])
    scratch.drop("entries")
    same = kept.where("NOT mixed").selectExpr("rid", "tag", "start AS lo", f"start + count + {length - 1} AS hi")
    rest = kept.where("mixed").select("key", "content", "rid", "tag", "start").join(marks, ["key", "content"]).selectExpr("rid", "tag", "start + lo AS lo", f"start + hi + {length - 1} AS hi")
    return same.unionAll(rest)


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, decode: bool = False, hot: int = HOT, names: tuple[str, ...] = ("kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")) -> DataFrame:
    """The columns of ``df`` and, for every row: kept (its bytes without repeats), n_bytes, n_removed, n_spans, kept_sha256.

    With ``decode``, ``kept`` is a string, without the rests of characters that were cut in two. ``names`` are the new columns' names.
    """
    scratch = Scratch(df.sparkSession, "suffix")
    place = df.columns.index(text_col)
    plain = [f"c{i}" for i in range(len(df.columns))]  # columns of any names
    identity = F.col(f"c{df.columns.index(id_col)}"), F.col(f"c{place}")
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))  # kept with the row in the table that is written next
    rows = df.toDF(*plain).select("*", F.xxhash64(*identity, turn).alias("rid"), F.hash(*reversed(identity)).alias("tag"))
    rows = scratch.bucketed(rows, "rows", "rid", "tag")
    ranges = repeats(rows.select("rid", "tag", F.col(f"c{place}").alias("text")), scratch, length, hot)
    cuts = scratch.save(ranges.groupBy("rid", "tag").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("cuts")), "cuts").withColumnsRenamed({"rid": "w_rid", "tag": "w_tag"}).hint("shuffle_hash")
    scratch.drop("kept", "marks", "all-marks")
    new = [f"n{i}" for i in range(5)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = as_bytes(b.column(place))
            cuts = b.column(b.num_columns - 1)
            mark = np.zeros(len(data) + 1, np.int32)
            size = cuts.value_lengths().fill_null(0).to_numpy()
            item = cuts.flatten()
            row = np.repeat(np.arange(b.num_rows), size)
            lo, hi = offs[row] + item.field(0).to_numpy(), offs[row] + item.field(1).to_numpy()
            step = np.bincount(lo, minlength=len(mark))[: len(mark)] - np.bincount(hi, minlength=len(mark))[: len(mark)]
            gone = np.cumsum(step)[:-1] > 0 if len(data) else np.zeros(0, bool)
            kept, removed, spans, digest = [], [], [], []
            for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                g = gone[s:e]
                k = int(g.sum())
                body = data[s:e].tobytes() if not k else data[s:e][~g].tobytes()
                kept.append(body)
                removed.append(k)
                spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if k else 0)
                digest.append(hashlib.sha256(body).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(plain)], pa.array([k.decode("utf-8", "ignore") for k in kept]) if decode else pa.array(kept, pa.binary()), pa.array(np.diff(offs), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)], names=[*plain, *new])

    joined = rows.join(cuts, (rows["rid"] == cuts["w_rid"]) & (rows["tag"] == cuts["w_tag"]), "left").select(*plain, "cuts")
    kinds = [StringType() if decode else BinaryType(), LongType(), LongType(), LongType(), StringType()]
    got = joined.mapInArrow(run, StructType([*[StructField(p, f.dataType) for p, f in zip(plain, df.schema, strict=True)], *map(StructField, new, kinds)]))
    taken = {x.lower() for x in names}
    return got.select(*[F.col(p).alias(c) for p, c in zip(plain, df.columns, strict=True) if c.lower() not in taken], *[F.col(n).alias(c) for n, c in zip(new, names, strict=True)])


#: By the hashes of all strings of 200 bytes.
SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT rid, i, md5(b[i : i + 199]) AS h FROM (SELECT rid, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200)),
c AS MATERIALIZED (SELECT rid, i FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
g AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT rid, i, (i > coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i) + 200, 0))::INT AS new FROM c)),
r AS (SELECT rid, min(i) AS lo, max(i) + 199 AS hi FROM g GROUP BY rid, run),
k AS (SELECT rid, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 0) + 1 AS lo, lo - 1 AS hi FROM r UNION ALL SELECT rid, max(hi) + 1, NULL FROM r GROUP BY rid),
t AS (SELECT rid, string_agg(hex(b[lo : coalesce(hi, octet_length(b))]), '' ORDER BY lo) AS kept FROM k JOIN d USING (rid) WHERE lo <= coalesce(hi, octet_length(b)) GROUP BY rid),
s AS (SELECT rid, sum(hi - lo + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM r GROUP BY rid)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN n_removed IS NULL THEN b ELSE unhex(coalesce(kept, '')) END) AS kept_sha256
FROM d LEFT JOIN s USING (rid) LEFT JOIN t USING (rid)
"""
