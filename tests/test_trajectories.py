"""Trajectory files: what a scan reads, streams of growing files, files written by many tasks."""

import os
import struct

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from strandlake.operators import geometry
from strandlake.operators.ensemble import bimodality_profile
from strandlake.sources import dcd, readers
from strandlake.streaming import frames as streams


def frames(spark, n, atoms=7, cell=True, start=0):
    return spark.range(start, start + n).select(
        F.col("id").alias("frame_idx"),
        (F.struct(*[F.lit(float(k)).alias(c) for k, c in enumerate(("a", "gamma", "b", "beta", "alpha", "c"))]) if cell else F.lit(None).cast("struct<a:double,gamma:double,b:double,beta:double,alpha:double,c:double>")).alias("cell"),
        *[F.transform(F.sequence(F.lit(0), F.lit(atoms - 1)), lambda i, k=k: (F.sin(F.col("id") * 3 + i * 7 + k) * 9).cast("float")).alias(c) for k, c in enumerate("xyz")],
    )


def rows(df):
    return sorted((r.frame_idx, r.cell, r.x, r.y, r.z) for r in df.collect())


def raw_file(xyz: np.ndarray, first: int = 0) -> bytes:
    """A trajectory without cells, put together by hand."""
    mark = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
    return dcd.file_header(1, xyz.shape[1], False, first) + b"".join(mark(f[:, c].astype("<f4").tobytes()) for f in xyz for c in range(3))


class _Counting:
    """A file system that counts the bytes read."""

    def __init__(self, system):
        self.system, self.read = system, 0

    def open_input_file(self, name):
        outer, f = self, self.system.open_input_file(name)

        class File:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                f.close()

            def read(self, n):
                outer.read += n
                return f.read(n)

            def __getattr__(self, name):
                return getattr(f, name)

        return File()


def test_bytes_read_fall_with_what_is_asked_for(tmp_path, monkeypatch):
    xyz = np.random.default_rng(0).standard_normal((40, 50_000, 3))
    path = str(tmp_path / "t.dcd")
    (tmp_path / "t.dcd").write_bytes(raw_file(xyz))
    plain, read = dcd._prefix, {}
    for name, options in {"all": {}, "atoms": {"atoms": "7,40000,7"}, "frames": {"first": "10", "last": "13"}, "many": {"atoms": ",".join(map(str, range(0, 50_000, 2)))}}.items():
        own = _Counting(plain(path)[0])
        monkeypatch.setattr(dcd, "_prefix", lambda p, own=own: (own, *plain(p)[1:]))
        reader = dcd._Reader({"path": path, **options})
        monkeypatch.setattr(dcd, "_files", lambda p: [(p, plain(p)[0].get_file_info(p))])
        got = [b for s in reader.partitions() for b in reader.read(s)]
        read[name] = own.read
        x = np.concatenate([b.column(3).flatten().to_numpy().reshape(b.num_rows, -1) for b in got])
        take = xyz[10:14] if name == "frames" else xyz
        assert np.array_equal(x, take[:, dcd._numbers(options["atoms"]) if "atoms" in options else slice(None), 0].astype("f4"))
    assert read["all"] >= 40 * 600_000 and read["atoms"] < 0.02 * read["all"] and read["frames"] < 0.11 * read["all"] and read["many"] <= read["all"] * 1.01


def test_filters_reach_the_scan(spark, tmp_path):
    for k in range(3):
        dcd.write_dcd(frames(spark, 5 + k, start=0), f"{tmp_path}/f{k}.dcd")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = dcd.read_dcd(spark, str(tmp_path)).where((F.col("frame_idx") >= 2) & (F.col("frame_idx") < 4) & (F.size("x") == 7))
        assert sorted((r.path[-6:], r.frame_idx) for r in df.collect()) == [(f"f{k}.dcd", i) for k in range(3) for i in (2, 3)]
        one = dcd.read_dcd(spark, str(tmp_path)).where(F.col("path") == f"{tmp_path}/f1.dcd")
        assert one.count() == 6 and one.rdd.getNumPartitions() == 1
        assert dcd.read_dcd(spark, str(tmp_path)).where("frame_idx = 6").count() == 1 and dcd.read_dcd(spark, str(tmp_path)).where("frame_idx > 90").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = dcd._PushReader({"path": str(tmp_path)})
    kept = list(reader.pushFilters([dcd.GreaterThan(("frame_idx",), 3), dcd.LessThanOrEqual(("frame_idx",), 5), dcd.In(("path",), ("a", "b")), dcd.EqualTo(("path",), "b"), dcd.EqualTo(("cell", "a"), 1.0)]))
    assert (reader.first, reader.last, reader.names) == (4, 5, {"b"}) and kept == [dcd.EqualTo(("cell", "a"), 1.0)]
    assert dcd.read_dcd(spark, str(tmp_path), frames=(4, 9)).count() == 1 + 2 + 3


def test_atoms_in_their_order(spark, tmp_path):
    path = f"{tmp_path}/t.dcd"
    df = frames(spark, 6)
    dcd.write_dcd(df, path)
    whole = {r[0]: r for r in rows(df)}
    for i, cell, x, y, z in rows(dcd.read_dcd(spark, path, atoms=[5, 0, 5])):
        assert cell == whole[i][1] and all(a == [b[5], b[0], b[5]] for a, b in zip((x, y, z), whole[i][2:], strict=True))
    with pytest.raises(PythonException, match="atoms 0 to 6"):
        dcd.read_dcd(spark, path, atoms=[7]).collect()
    p = readers.read_dcd(spark, path, [6, 2, 6], [1, None, 0])
    q = readers.read_dcd(spark, path)
    at = {(r.frame_id, r.res): (r.x, r.y, r.z) for r in q.collect()}
    for r in p.collect():
        assert (r.x, r.y, r.z) == at[r.frame_id, [6, 2, 6][r.res]]
        assert r.res == 1 or (r.cx, r.cy, r.cz) == at[r.frame_id, [1, None, 0][r.res]]
    assert q._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 1


def test_many_tasks_write(spark, tmp_path, monkeypatch):
    df = frames(spark, 500, 30).repartition(5)
    dcd.write_dcd_parts(df, f"{tmp_path}/out", 6)
    files = sorted(os.listdir(tmp_path / "out"))
    assert len(files) == 6 and all(f.startswith("frames-") for f in files)
    assert rows(dcd.read_dcd_parts(spark, f"{tmp_path}/out")) == rows(df)
    heads = [dcd.header(f"{tmp_path}/out/{f}") for f in files]
    assert sum(h["declared"] for h in heads) == 500 and all(h["declared"] == h["frames"] for h in heads) and [h["first"] for h in heads] == sorted(h["first"] for h in heads)
    dcd.write_dcd_parts(frames(spark, 10, cell=False), f"{tmp_path}/bare", 2)
    assert rows(dcd.read_dcd_parts(spark, f"{tmp_path}/bare")) == rows(frames(spark, 10, cell=False))
    dcd.write_dcd_parts(df.where("false"), f"{tmp_path}/none")
    assert os.listdir(tmp_path / "none") == []
    monkeypatch.setattr(dcd, "FILE_BYTES", 5000)  # files are cut where they are full, here in one process
    w = dcd._Writer({"path": f"{tmp_path}/cut"})
    os.mkdir(tmp_path / "cut")
    batches = dcd.pa.Table.from_batches([b for f in files[:1] for b in dcd._Reader({"path": f"{tmp_path}/out/{f}"}).read(dcd._Split(f"{tmp_path}/out/{f}", f"{tmp_path}/out/{f}", 0, 1 << 20))]).to_batches(max_chunksize=4)
    message = w.write(iter(batches))
    assert len(message.drafts) > 1
    w.commit([message])
    assert sum(dcd.header(f"{tmp_path}/cut/{f}")["declared"] for f in os.listdir(tmp_path / "cut")) == heads[0]["frames"]


def test_failed_writes_leave_nothing(spark, tmp_path):
    bad = frames(spark, 40).withColumn("x", F.when(F.col("frame_idx") == 33, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("x")))
    for write in (lambda: dcd.write_dcd_parts(bad, f"{tmp_path}/parts", 4), lambda: dcd.write_dcd(bad, f"{tmp_path}/one/t.dcd")):
        os.makedirs(tmp_path / "one", exist_ok=True)
        with pytest.raises(Exception, match="number of atoms"):
            write()
    mixed = frames(spark, 20).unionByName(frames(spark, 20, 9, start=20))  # each task's frames are alike
    with pytest.raises(Exception, match="differ"):
        dcd.write_dcd_parts(mixed, f"{tmp_path}/parts", 2)
    # a task that was still running when the job was given up may leave a draft, which readers pass over
    assert [f for f in os.listdir(tmp_path / "parts") if not f.startswith(".")] == [] and os.listdir(tmp_path / "one") == []
    assert dcd._files(f"{tmp_path}/parts") == []


def test_stream_of_growing_files(spark, tmp_path):
    """Frames are appended to files whose headers stay as they were, one is there in part, and a file comes later: each whole frame comes once."""
    r = np.random.default_rng(1)
    xyz = {name: np.cumsum(r.standard_normal((30, 12, 3)), 1) for name in "ab"}
    data = {name: raw_file(x) for name, x in xyz.items()}
    size = len(raw_file(xyz["a"][:1])) - len(raw_file(xyz["a"][:0]))
    start = len(data["a"]) - 30 * size
    os.mkdir(tmp_path / "in")

    def run():
        stream = dcd.stream_dcd(spark, f"{tmp_path}/in")
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.path[-5], r.frame_idx) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    (tmp_path / "in/a.dcd").write_bytes(data["a"][: start + 10 * size + 17])
    assert run() == [("a", i) for i in range(10)]
    (tmp_path / "in/a.dcd").write_bytes(data["a"][: start + 25 * size])
    (tmp_path / "in/b.dcd").write_bytes(data["b"][:50])  # not even a header
    assert run() == [("a", i) for i in range(25)]
    (tmp_path / "in/a.dcd").write_bytes(data["a"])
    (tmp_path / "in/b.dcd").write_bytes(data["b"][: start + 3 * size])
    assert run() == [("a", i) for i in range(30)] + [("b", i) for i in range(3)]
    assert run() == [("a", i) for i in range(30)] + [("b", i) for i in range(3)]
    got = {(r.path[-5], r.frame_idx): r.x for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert all(np.array_equal(np.float32(got[n, i]), np.float32(xyz[n][i, :, 0])) for n, i in got)


def test_profile_of_a_growing_file_is_that_of_all_frames(spark, tmp_path):
    xyz = np.cumsum(np.random.default_rng(2).standard_normal((60, 14, 3)), 1)
    data, folder = raw_file(xyz), tmp_path / "in"
    size = (len(data) - len(raw_file(xyz[:0]))) // 60
    os.mkdir(folder)
    for k, n in enumerate((20, 45, 60)):
        (folder / "t.dcd").write_bytes(data[: len(data) - (60 - n) * size])
        got = streams.kept_profile(streams.trajectory(spark, str(folder)), 6, f"{tmp_path}/states", f"{tmp_path}/mark")
    want = {r.window_start: r for r in bimodality_profile(geometry.invariants(readers.read_dcd(spark, f"{folder}/t.dcd")), 6).collect()}
    rows_ = got.collect()
    assert len(rows_) == len(want) == 9
    for r in rows_:
        assert r.frames == 60 and r.bc_kappa == pytest.approx(want[r.window_start].bc_kappa, rel=1e-9) and r.bc_tau == pytest.approx(want[r.window_start].bc_tau, rel=1e-9)
