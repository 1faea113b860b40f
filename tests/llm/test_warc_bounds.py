"""The salvage reader's memory, large records, and a round trip that does not lose a record unseen."""

import io
import os
import random
import tracemalloc

import pytest

from strandlake.llm import warc


def peak(f) -> int:
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_false_length_is_not_believed(tmp_path):
    """200 MB of records of 1 MB, one of which declares all the rest of the file: it is a gap, and all others are read."""
    path = tmp_path / "a.warc"
    one = warc.record("response", "u", os.urandom(1 << 19) * 2, {})
    with path.open("wb") as f:
        for k in range(200):
            f.write(one if k != 3 else one.replace(b"Content-Length: 1048576", b"Content-Length: 205000000"))

    seen = []

    def read():
        with path.open("rb") as f:
            seen.extend((kind, len(block), h.get("reason")) for kind, h, block, _, _ in warc.salvage(f))

    assert peak(read) < 16 << 20
    assert [k for k, _, _ in seen].count("record") == 199 and ("gap", 0, "end") in seen


@pytest.mark.parametrize("zipped", [True, False])
def test_large_records(zipped):
    """Records beyond what is held at once are read whole; damaged ones are gaps, and what follows is read."""
    big = random.Random(1).randbytes(9 << 20)
    form = (lambda r: warc.member(r, 1)) if zipped else (lambda r: r)
    recs = [form(warc.record("response", f"u{i}", x, {})) for i, x in enumerate((b"first", big, b"middle", big[::-1], b"last"))]
    got = list(warc.salvage(io.BytesIO(b"".join(recs))))
    assert [g[0] for g in got] == ["record"] * 5 and got[1][2] == big and got[3][2] == big[::-1]
    bad = bytearray(recs[1])
    bad[len(bad) // 2] ^= 255
    cut = recs[3][: len(recs[3]) // 2]
    for data, want in ((recs[0] + bytes(bad) + recs[2], [b"first", b"middle"]), (recs[0] + cut + recs[4], [b"first", b"last"]), (recs[0] + cut, [b"first"])):
        got = list(warc.salvage(io.BytesIO(data)))
        assert [g[2] for g in got if g[0] == "record"] == want
        assert sum(g[4] for g in got) == len(data)


@pytest.mark.parametrize("zipped", [True, False])
def test_many_records_over_many_blocks(zipped):
    """Records that lie across the blocks in which a file is read, 8 MB of them."""
    r = random.Random(2)
    blocks = [r.randbytes(r.choice((10, 3000, 90_000, 700_000))) for _ in range(40)]
    recs = [warc.record("response", f"u{i}", x, {}) for i, x in enumerate(blocks)]
    data = b"".join(map(warc.member, recs) if zipped else recs)
    assert len(data) > 4 << 20 and [g[2] for g in warc.salvage(io.BytesIO(data))] == blocks


def test_compressed_zeros_do_not_fill_memory():
    """A member that inflates to far more than its record declares is left after the declared length."""
    bomb = warc.member(warc.record("response", "u", b"x" * 10, {}) + b"\0" * (64 << 20))
    seen = []
    assert peak(lambda: seen.extend(g[0] for g in warc.salvage(io.BytesIO(bomb + warc.member(warc.record("response", "v", b"y", {})))))) < 16 << 20
    assert seen == ["gap", "record"]


def test_long_payloads_and_lost_records(spark, monkeypatch):
    long = "é" * 900_000  # 1.8 MB
    rows = [(1, "u", long), (2, "u", long), (3, "u", long[1:]), (4, "u", "s")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    assert got == {1: (1_800_000, "revisit", 2), 2: (1_800_000, "response", None), 3: (1_799_998, "response", None), 4: (1, "response", None)}
    read = warc.read_warc
    monkeypatch.setattr(warc, "read_warc", lambda *a, **k: read(*a, **k).where("page_id <> 3"))
    with pytest.raises(RuntimeError, match="4 records were written and 3 read"):
        warc.round_trip(df)
