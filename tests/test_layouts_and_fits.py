"""Superposition by masks, functions in SQL text, points laid out by frame, members of archives."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import tables
from strandlake.operators import geometry, superposition
from strandlake.sources import archives, bindings, dcd, layout, pdb, readers

SF = "/root/testdata/sf0.001"


def kabsch(x, r):
    """Rotation and shift that lay x on r."""
    cx, cr = x.mean(0), r.mean(0)
    u, _, vt = np.linalg.svd((x - cx).T @ (r - cr))
    d = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    turn = vt.T @ np.diag([1, 1, d]) @ u.T
    return turn, cr - turn @ cx


def points_of(spark, arrays, strands=None):
    rows = [(f, i, *map(float, p), *(map(float, strands[f][i]) if strands is not None else ())) for f, a in enumerate(arrays) for i, p in enumerate(a)]
    return spark.createDataFrame(rows, "frame_id long, res int, x double, y double, z double" + (", cx double, cy double, cz double" if strands is not None else ""))


def arrays_of(df, *columns):
    out = {}
    for r in df.orderBy("frame_id", "res").collect():
        out.setdefault(r["frame_id"], []).append([r[c] for c in columns])
    return {k: np.array(a) for k, a in out.items()}


def test_masked_fit(spark):
    """Frames are the reference turned and mirrored parts of it, and noise; also with a second strand and residues that one side lacks."""
    r = np.random.default_rng(0)
    ref = r.standard_normal((12, 3)) * 5
    frames = [ref]
    for k in range(8):
        q = np.linalg.qr(r.standard_normal((3, 3)))[0] * (-1 if k == 3 else 1)  # also an improper one
        frames.append(ref @ q.T + r.standard_normal(3) * 9 + (0 if k == 2 else 0.3) * r.standard_normal((12, 3)))
    frames[5] = frames[5][:9]
    strands = [f + 1.5 for f in frames]
    df = points_of(spark, frames, strands)
    mask = F.col("res").isin(1, 2, 3, 5, 8)
    use = [1, 2, 3, 5, 8]
    got = superposition.superposed(df, 0, mask)
    xyz, cb = arrays_of(got, "x", "y", "z"), arrays_of(got, "cx", "cy", "cz")
    fits = {f.frame_id: f for f in superposition.fit(df, 0, mask).collect()}
    inner = {x.frame_id: x.rmsd for x in superposition.rmsd(got, df.where("frame_id = 0"), mask).collect()}
    outer = {x.frame_id: x.rmsd for x in superposition.rmsd(got, df.where("frame_id = 0"), ~mask).collect()}
    for f, a in enumerate(frames):
        turn, shift = kabsch(a[use], ref[use])
        want = a @ turn.T + shift
        assert np.linalg.det(turn) > 0
        np.testing.assert_allclose(xyz[f], want, atol=1e-9)
        np.testing.assert_allclose(cb[f], strands[f] @ turn.T + shift, atol=1e-9)
        assert fits[f].rmsd == pytest.approx(inner[f], abs=1e-6) == pytest.approx(np.sqrt(((want[use] - ref[use]) ** 2).sum(1).mean()), abs=1e-6)
        rest = [i for i in range(len(a)) if i not in use]
        assert outer[f] == pytest.approx(np.sqrt(((want[rest] - ref[rest]) ** 2).sum(1).mean()), abs=1e-9)


def test_mean_structure(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((10, 3)) * 4
    frames = [(base + 0.2 * r.standard_normal((10, 3))) @ np.linalg.qr(r.standard_normal((3, 3)))[0].T + r.standard_normal(3) for _ in range(30)]
    frames = [f if np.linalg.det(np.linalg.lstsq(base - base.mean(0), f - f.mean(0), rcond=None)[0]) > 0 else -f for f in frames]
    got = np.array([[x.x, x.y, x.z] for x in superposition.mean_structure(points_of(spark, frames), 4, rounds=4).orderBy("res").collect()])
    mean = frames[4]
    for _ in range(4):
        laid = []
        for f in frames:
            turn, shift = kabsch(f, mean)
            laid.append(f @ turn.T + shift)
        mean = np.mean(laid, 0)
    np.testing.assert_allclose(got, mean, atol=1e-6)


RECORD = "{:<6}{:>5} {:<4}{:1}{:<3} {:1}{:>4}{:1}   {:8.3f}{:8.3f}{:8.3f}  1.00{:>6}"


def structure():
    at = lambda k: (k * 1.5, k % 3 * 2.0, -k * 0.5)
    lines = ["HEADER", "ATOM  short"]
    for k, (name, atom, alt, chain, seq, code) in enumerate([("ALA", "CA", " ", "A", 5, " "), ("ALA", "CB", " ", "A", 5, " "), ("GLY", "N", " ", "A", 4, " "), ("GLY", "CA", "B", "A", 4, " "), ("GLY", "CA", "A", "A", 4, " "), ("SER", "CA", " ", "B", 4, "X"), ("ALA", "CA", "1", "A", 5, " "), ("LYS", "CB", " ", "A", 9, " "), ("HOH", "O", " ", "A", 99, " "), ("MSE", "CA", " ", "B", -3, " ")]):
        lines.append(RECORD.format("HETATM" if name == "MSE" else "ATOM", k, f" {atom}", alt, name, chain, seq, code, *at(k), "x" if k == 4 else k))
    return "\r\n".join(lines) + "\n"


def test_table_function_is_the_column_form(spark):
    tables.register(spark)
    text = structure()
    df = spark.createDataFrame([("f", text), ("g", "junk\n"), ("n", None)], "path string, text string")
    df.createOrReplaceTempView("texts_for_udtf")
    got = spark.sql("SELECT path, s.* FROM texts_for_udtf, LATERAL structure_residues(text) s ORDER BY path, res").collect()
    r = pdb.residues(pdb.from_text(df.where("path = 'f'"))).orderBy("first_line").collect()
    assert [(x.chain_id, x.seq_id, x.i_code, x.name, x.b_factor, x.x, x.y, x.z, x.bx) for x in got] == [(x.chain_id, x.seq_id, x.i_code, x.name, x.b_factor, x.ca.x, x.ca.y, x.ca.z, x.cb.x if x.cb else None) for x in r]
    assert len(got) == 4 and spark.sql("SELECT count(*) FROM texts_for_udtf, LATERAL structure_residues(text, 'B') s").head()[0] == 2
    row = spark.sql("SELECT circle_distance(3.1, -3.1), bend_distance(0, 3.1, 0, -3.1), spectrum_distance(array(1D, 2D), array(2D, 4D, 9D)), spectrum_distance(array(), array(1D))").head()
    assert tuple(row) == pytest.approx((2 * np.pi - 6.2, 2 * np.pi - 6.2, np.sqrt(2.5), 0.0))


def test_texts_of_coordinates_and_angles_of_zeros(spark):
    """As C's printf and atan2 have them: ties by the exact value and to even, and the signs of zeros."""
    import math

    tables.register(spark)
    r = np.random.default_rng(5)
    xs = [k / 16 for k in range(-40, 40)] + [k / 2000 for k in range(-3000, 3000)] + [float(np.float32(x)) for x in r.standard_normal(500)] + [-0.0, -0.0001, 1e-300, 9999.9995, 1234.5675, np.nan]
    df = spark.createDataFrame([(i, 0, x, 0.0, x) for i, x in enumerate(xs)], "frame_id long, res int, x double, y double, z double")
    texts = {r.frame_id: r.line.lower() for r in pdb.to_lines(df).collect()}
    assert [(texts[i][30:38], texts[i][46:54]) for i in range(len(xs))] == [(f"{x:8.3f}",) * 2 for x in xs]
    assert [t.lower() for (t,) in df.orderBy("frame_id").selectExpr("format_string('%8.3f', three_decimals(x))").collect()] == [f"{x:8.3f}" for x in xs]
    zeros = [(y, x) for y in (-0.0, 0.0, -0.5, 0.5) for x in (-0.0, 0.0, -0.5, 0.5)]
    got = spark.createDataFrame(zeros, "y double, x double").selectExpr("point_angle(y, x)").collect()
    assert [a for (a,) in got] == pytest.approx([math.atan2(*z) for z in zeros])


@pytest.mark.parametrize("query", ["structures_in_sql", "pdb_round_trip", "pdb_ribbons", "pdb_nucleotides", "pdb_models"])
def test_structure_files_of_ties_and_of_points_at_the_origin(spark, tmp_path, query):
    """Components on odd sixteenths, and second points whose texts are 0.000 or -0.000."""
    import duckdb

    from strandlake.plans.oracles import SQL
    from strandlake.plans.queries import QUERIES

    x = np.random.default_rng(6).standard_normal((12, 64)).astype(np.float32)
    x[8:, :] = np.random.default_rng(7).integers(-9, 9, (4, 64)) / 8 + 1 / 16
    for k, at in enumerate([(-0.0001, 0.0002), (-0.0002, -0.0001), (0.0001, -0.0001), (0.0001, 0.0001), (-0.3, -0.0001), (0.0, -0.0625)]):
        x[k + 1, 3:5] = at
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    df = QUERIES[query](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(c.sql(f"SELECT {', '.join(df.columns)} FROM ({SQL[query]})").fetchall())


def test_points_by_frame_need_no_exchange(spark, tmp_path):
    points = bindings.frames(spark, SF)
    laid = layout.write_by_frame(points, f"{tmp_path}/points", 4)
    again = layout.open_by_frame(spark, f"{tmp_path}/points", 4, "frame_id long, res int, x double, y double, z double")
    want = sorted(map(tuple, geometry.invariants(points).collect()), key=repr)
    for df in (laid, again):
        inv = geometry.invariants(df)
        assert "Exchange" not in inv._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in geometry.totals(inv)._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, inv.collect()), key=repr) == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("strandlake_")]


def test_a_member_is_read_without_the_rest(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(2)
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(20):
            z.writestr(f"big/{k}.bin", r.bytes(200_000))
        z.writestr("one/s.pdb", structure())
        z.writestr("two.pdb", "junk")
    from test_trajectories import _Counting

    own = _Counting(dcd._prefix(str(path))[0])
    own.get_file_info = own.system.get_file_info
    own.open_input_file = lambda name, f=own.system: _Reading(own, f.open_input_file(name))
    plain = dcd._prefix
    monkeypatch.setattr(dcd, "_prefix", lambda p: (own, *plain(p)[1:]))
    reader = archives._Reader({"path": str(path), "members": "one/*"})
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in got) == 1 and own.read < 200_000 < path.stat().st_size
    monkeypatch.undo()
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("empty.pdb", "")
    df = archives.read_zip(spark, str(tmp_path))
    assert df.count() == 23 and sorted(x.member for x in df.where("size < 3000").collect()) == ["empty.pdb", "one/s.pdb", "two.pdb"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = archives.read_zip(spark, str(tmp_path)).where("member LIKE 'one/%' OR member = 'none'").count(), archives.read_zip(spark, str(tmp_path)).where("member = 'two.pdb'")
        assert some[0] == 1 and some[1].count() == 1 and some[1].rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    curve = readers.read_text(archives.read_texts(spark, str(tmp_path), "one/*.pdb"))
    assert [(x.seq_id, x.chain_id) for x in curve.orderBy("res").collect()] == [(5, "A"), (4, "A"), (4, "B"), (-3, "B")]


class _Reading(io.RawIOBase):
    """A file that counts the bytes read from it."""

    def __init__(self, own, f):
        self.own, self.f = own, f

    def read(self, n=-1):
        data = self.f.read() if n is None or n < 0 else self.f.read(n)
        self.own.read += len(data)
        return data

    def seek(self, *a):
        return self.f.seek(*a)

    def tell(self):
        return self.f.tell()

    def seekable(self):
        return True


def test_networks_in_parts_are_the_same(spark, monkeypatch):
    """Sums of few frames at a time; slices of batches keep their own rows."""
    from strandlake.operators import network

    inv = geometry.invariants(bindings.frames(spark, SF)).coalesce(1)
    want = {(r.i, r.j): r.r for r in network.network(inv).collect()}
    monkeypatch.setattr(network, "PART_BYTES", 5000)
    got = {(r.i, r.j): r.r for r in network.network(inv).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_traces(spark):
    from strandlake.operators import traces

    r = np.random.default_rng(3)
    arrays, strands = [r.standard_normal((n, 3)) for n in (5, 3)], [r.standard_normal((n, 3)) for n in (5, 3)]
    points, strand = points_of(spark, arrays), points_of(spark, strands)
    both = traces.with_strand(points, strand)
    assert np.array_equal(traces.coordinates(both, 1), arrays[1]) and np.array_equal(traces.coordinates(both, 0, True), strands[0])
    assert sorted(map(tuple, traces.describe(both).collect())) == [(0, 5, 5, True), (1, 3, 3, True)] and sorted(map(tuple, traces.describe(points).collect())) == [(0, 5, 0, False), (1, 3, 0, False)]
    assert traces.with_strand(both, points).where("cx <> x").count() == 0
    assert sorted((x.frame_id, x.res) for x in traces.point(both, 3).collect()) == [(0, 3)] and sorted((x.frame_id, x.res) for x in traces.point(both, -1).collect()) == [(0, 4), (1, 2)]
    assert traces.ribbon(both).count() == 8 and traces.backbone(both).columns == ["frame_id", "res", "x", "y", "z"]
    with pytest.raises(Exception, match="frame 0 has 5 points and 0"):
        traces.ribbon(points.where("frame_id = 0")).collect()
    with pytest.raises(Exception, match="differ at frame 1, point 2"):
        traces.with_strand(points, strand.where("NOT (frame_id = 1 AND res = 2)")).collect()
    with pytest.raises(ValueError, match="no frame 9"):
        traces.coordinates(points, 9)
