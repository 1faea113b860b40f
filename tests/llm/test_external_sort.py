"""The suffix sort in small blocks and with its arrays in files: right, and in memory that does not follow the text."""

import tracemalloc
from collections import Counter

import numpy as np
import pytest

from strandlake.llm import suffix_dedup


def held(text, space_bytes):
    space = suffix_dedup.Space(None, space_bytes)
    own = space.array(len(text) + 32, np.uint16)
    own[: len(text)] = text
    return own, space


@pytest.mark.parametrize("block", [1, 2, 3, 5, 8, 64])
def test_blocks_of_any_size(monkeypatch, block):
    """Groups of equal ranks beyond a block, runs over its edges, queues and arrays in files."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "BATCH", block + 1)
    monkeypatch.setattr(suffix_dedup, "PAIRS", block)
    r = np.random.default_rng(block)
    for trial in range(40):
        n, base = int(r.integers(2, 40)), r.integers(1, r.integers(2, 6), int(r.integers(1, 60)))
        t = np.concatenate([base if r.random() < 0.5 else r.integers(1, 5, int(r.integers(1, 30))) for _ in range(int(r.integers(1, 7)))])
        t = np.r_[np.tile(t[: r.integers(1, 8)], 30) if trial % 4 == 0 else t, 0].astype(np.uint16)
        text, space = held(t, [0, 300, 1 << 20][trial % 3])
        sink = []
        flag = suffix_dedup.repeated_starts(text, n, queue_bytes=[0, 60, 1 << 20][trial % 3], sink=sink, space=space)
        grams = [tuple(t[i : i + n].tolist()) for i in range(len(t))]
        count = Counter(grams)
        assert flag.tolist() == [len(g) == n and count[g] > 1 for g in grams]
        order = []
        for _, low, high in sorted(sink, key=lambda x: x[0]):
            order += [k for a, _ in low for k in a.tolist()] + [k for a, _ in high for k in a.tolist()][::-1]
        assert [grams[i] for i in order] == sorted(grams)


def test_memory_does_not_follow_the_text(monkeypatch):
    """4 and 12 MB of text in blocks of 64 K items: the same few MB, where some 120 bytes for a byte would be 480 and 1440."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 16)
    monkeypatch.setattr(suffix_dedup, "BATCH", 1 << 16)
    r, peak = np.random.default_rng(0), []
    for size in (4_000_000, 12_000_000):
        text, space = held(np.zeros(0, np.uint16), 1 << 20)
        text = space.array(size + 33, np.uint16)
        text[:size] = r.integers(97, 113, size, dtype=np.uint16)
        text[5000:6000] = text[size - 90_000 : size - 89_000]
        tracemalloc.start()
        flag = suffix_dedup.repeated_starts(text, 200, space=space)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert np.flatnonzero(flag).tolist() == [*range(5000, 5801), *range(size - 90_000, size - 89_199)]
    assert max(peak) < 48 << 20 and peak[1] < 1.5 * peak[0]
