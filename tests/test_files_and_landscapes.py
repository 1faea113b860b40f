"""File scans with built strands, split trajectories, queries by coordinates, landscapes, generators, streams of frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import vec as v
from strandlake.operators import audit, curves, ensemble, geometry, network, search, writhe
from strandlake.sources import bindings, dcd, generators, pdb, readers
from strandlake.streaming import frames as stream
from strandlake.streaming import moments


def points(spark, curves_):
    rows = [(int(f), i, *map(float, p)) for f, c in curves_.items() for i, p in enumerate(c)]
    return spark.createDataFrame(rows, "frame_id long, res int, x double, y double, z double")


def record(n, atom, name, chain, seq, xyz, alt=" "):
    x, y, z = xyz
    return f"ATOM  {n:5d} {atom:<4}{alt}{name:>3} {chain}{seq:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  7.50"


def text(spark, rows, path="m"):
    return pdb.from_text(spark.createDataFrame([(path, "\n".join(rows))], "path string, text string"))


def test_strands_of_structure_files(spark):
    rows = [
        record(1, " N  ", "ALA", "A", 1, (0, -1.4, 0)), record(2, " CA ", "ALA", "A", 1, (0, 0, 0)), record(3, " C  ", "ALA", "A", 1, (1.4, 0, 0)), record(4, " CB ", "ALA", "A", 1, (1, 1, 1)),
        record(5, " N  ", "GLY", "A", 2, (3, -1, 0)), record(6, " CA ", "GLY", "A", 2, (3, 0, 0)), record(7, " C  ", "GLY", "A", 2, (4, 0, 0)),
        record(8, " CA ", "SER", "A", 3, (5, 3, 0)), record(9, " CA ", "SER", "B", 1, (8, 3, 0)), record(10, " CB ", "SER", "B", 1, (8, 3, 0)),
    ]
    got = pdb.ribbons(text(spark, rows)).orderBy("res").collect()
    strand = [(r.cx - r.x, r.cy - r.y, r.cz - r.z) for r in got]
    assert [(r.res, r.name, r.seq_id, r.chain_id) for r in got] == [(0, "ALA", 1, "A"), (1, "GLY", 2, "A"), (2, "SER", 3, "A"), (3, "SER", 1, "B")]
    assert strand[0] == pytest.approx((1, 1, 1))
    assert strand[1] == pytest.approx((-1.52 / math.sqrt(2), 1.52 / math.sqrt(2), 0))  # away from N and C
    way = np.array([5.0, 3, 0]) * 2 - [3, 0, 0] - [8, 3, 0]
    assert strand[2] == pytest.approx(tuple(1.52 * way / np.linalg.norm(way)))  # between its neighbours
    assert strand[3] == pytest.approx((0, 1.52, 0))  # a CB at its CA is none, and the last residue has a perpendicular
    assert [r.seq_id for r in pdb.residue_ids(text(spark, rows), "A").orderBy("first_line").collect()] == [1, 2, 3]
    none = pdb.ribbons(text(spark, ["TER"]))
    assert none.count() == 0 and readers.read_text(spark.createDataFrame([], "path string, text string")).count() == 0


def test_bond_strand_fallbacks(spark):
    cases = [((0, 0, 0), (-1, 0, 0), (1, 0, 0), (0, 1.52, 0)), ((0, 0, 0), (0, 0, 1), (0, 0, -1), (0, 1.52, 0)), ((0, 0, 0), (0, 0, 0), (0, 0, 0), (1.52, 0, 0))]
    for ca, n, c, want in cases:
        cols = [tuple(F.lit(float(x)) for x in p) for p in (ca, n, c)]
        got = geometry.bond_strand(spark.range(1), *cols, "b").select("bx", "by", "bz").head()
        assert np.allclose(np.abs(got), np.abs(want))


def test_nucleotides_and_their_rules(spark):
    rows = [
        record(1, " O5*", "cyt", "X", 13, (0, 0, 0)), record(2, " C5*", "cyt", "X", 13, (0, 0, -2)), record(3, " C4*", "cyt", "X", 13, (1, 0, 0)), record(4, " C1*", "cyt", "X", 13, (2, 0, 0)), record(5, " N3 ", "cyt", "X", 13, (9, 9, 9)), record(6, " N1 ", "cyt", "X", 13, (3, 0, 0)),
        record(7, " P  ", "GUA", "X", 14, (5, 0, 0)), record(8, " C1'", "GUA", "X", 14, (6, 0, 0)), record(9, " N1 ", "GUA", "X", 14, (8, 8, 8)), record(10, " N9 ", "GUA", "X", 14, (7, 0, 0)), record(11, " N1 ", "GUA", "X", 14, (4, 4, 4)),
        record(12, " C1'", "URA", "X", 15, (6, 1, 0)), record(13, " N3 ", "URA", "X", 15, (6, 2, 0)), record(14, " C4'", "URA", "X", 15, (5, 1, 0)), record(15, " C3'", "URA", "X", 15, (5, 0, 0)),
        record(16, " C1'", " DT", "X", 16, (1, 1, 1)), record(17, " N1 ", " DT", "X", 16, (1, 1, 2)), record(18, " O5'", " DT", "X", 16, (2, 2, 2)), record(19, " C5'", " DT", "X", 16, (2, 2, 2)), record(20, " C3'", " DT", "X", 16, (0, 1, 1)),
        record(21, " C1'", "ALA", "X", 17, (1, 1, 1)), record(22, " N1 ", "ALA", "X", 17, (1, 1, 2)), record(23, " C1'", "  A", "X", 18, (1, 1, 1)), record(24, " N3 ", "  A", "X", 18, (1, 1, 2)),
    ]
    got = {r.seq_id: r for r in readers.read_text(spark.createDataFrame([("m", "\n".join(rows))], "path string, text string"), nucleotides=True).collect()}
    assert set(got) == {13, 14, 15, 16}  # no nucleotide, and a purine with N3 only
    assert (got[13].name, got[13].res, got[13].nx) == ("CYT", 0, 3) and (got[13].x, got[13].y, got[13].z) == pytest.approx((0, 0, 1.6))
    assert (got[14].nx, got[14].x) == (7, 5)
    assert (got[15].ny, got[15].y) == pytest.approx((2, 3.5))
    assert (got[16].x, got[16].y, got[16].z) == pytest.approx((1, 1, 4.5))  # O5' and C5' meet
    b = readers.base_vectors(readers.read_text(spark.createDataFrame([("m", "\n".join(rows))], "path string, text string"), nucleotides=True)).where("seq_id = 13").head()
    assert (b.bx, b.by, b.bz) == (1, 0, 0)


def test_readers(spark, tmp_path):
    line = [record(i + 1, " CA ", "ALA", "A", i + 1, p) for i, p in enumerate(generators.helix(6))]
    (tmp_path / "m.pdb").write_text("\n".join(["MODEL 1", *line, "ENDMDL", "MODEL 2", *line, "ENDMDL"]))
    p = readers.read_pdb_trajectory(spark, str(tmp_path / "m.pdb"), strand=True)
    assert sorted((r.frame_id, r.res) for r in p.collect()) == [(f, i) for f in (0, 1) for i in range(6)] and "cx" in p.columns
    (tmp_path / "r.pdb").write_text("\n".join(["MODEL 1", *line, "ENDMDL", "MODEL 2", *line[:4], "ENDMDL"]))
    with pytest.raises(Exception, match="from 4 to 6 points"):
        readers.read_pdb_trajectory(spark, str(tmp_path / "r.pdb")).collect()
    assert readers.read_pdb(spark, str(tmp_path / "m.pdb")).columns[:2] == ["frame_id", "res"]
    with pytest.raises(Exception, match="no frames"):
        readers.even_frames(p.where("frame_id > 9").select("frame_id", "res", "x", "y", "z")).collect()


def test_trajectory_splits_and_built_strand(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(9)
    rows = [(i, None, *[r.random(10).astype(np.float32).tolist() for _ in range(3)]) for i in range(23)]
    df = spark.createDataFrame(rows, "frame_idx long, cell struct<a:double,gamma:double,b:double,beta:double,alpha:double,c:double>, x array<float>, y array<float>, z array<float>")
    path = str(tmp_path / "t.dcd")
    dcd.write_dcd(df, path)
    got = [x for lo in range(0, 9000, 500) for b in dcd._Reader({"path": path}).read(dcd._Split(path, path, lo, lo + 500)) for x in zip(*[c.to_pylist() for c in b.columns[1:]], strict=True)]
    assert [tuple(g) for g in got] == rows  # each frame is in one split
    p = readers.read_dcd(spark, path, [0, 1, 2, 3], [None, 5, None, 7])
    q = geometry.pseudo_strand(readers.read_dcd(spark, path, [0, 1, 2, 3]))
    a, b = ({(x.frame_id, x.res): x for x in d.collect()} for d in (p, q))
    assert all((a[k].cx, a[k].cz) == pytest.approx((b[k].px, b[k].pz)) for k in a if k[1] in (0, 2)) and a[4, 3].cy == pytest.approx(rows[4][3][7])
    with pytest.raises(ValueError, match="4 atoms"):
        readers.read_dcd(spark, path, [0, 1, 2, 3], [1])
    assert readers.read_dcd(spark, path).where("frame_id = 3").count() == 10


def test_kernels_agree_with_pairs_as_rows(spark):
    r = np.random.default_rng(5)
    c = {f: np.cumsum(r.standard_normal((n, 3)), 0) for f, n in enumerate((4, 9, 15, 15, 3))}
    p = points(spark, c)
    want = {x.frame_id: x.w for x in writhe.segment_pairs(p).groupBy("frame_id").agg(F.sum("w").alias("w")).collect()}
    got = {x.frame_id: x.writhe for x in writhe.total_writhe(p).collect()}
    assert got == pytest.approx({f: w for f, w in want.items() if f != 4}) and 4 not in got
    local = {(x.frame_id, x.res): x.writhe for x in writhe.local_writhe(p, 3).collect()}
    pairs = writhe.segment_pairs(p).collect()
    assert set(local) == {(f, i) for f in (1, 2, 3) for i in range(3, len(c[f]) - 3)}
    assert all(local[f, i] == pytest.approx(sum(x.w for x in pairs if x.frame_id == f and x.i >= i - 3 and x.j <= i + 2)) for f, i in local)
    small, curves.PAIR_BYTES = curves.PAIR_BYTES, 64
    try:
        blocks = sum(w.sum(1) for _, w in curves.diagonals(c[2][None]))
    finally:
        curves.PAIR_BYTES = small
    assert blocks[0] == pytest.approx(want[2])


def test_long_curves_stay_in_bounds():
    c = np.cumsum(np.random.default_rng(1).standard_normal((1, 400, 3)), 1)
    assert max(w.size for _, w in curves.diagonals(c)) <= 400 and curves.total_writhe(c).shape == (1,)


def test_writhe_by_three_formulas(spark):
    p = generators.noisy_helices(spark, 3, 14, 0.1)  # no segments nearly touch, which the midpoint rule needs
    one, two, three = ({r.frame_id: r.writhe for r in f(p).collect()} for f in (writhe.standard_writhe, audit.arc_writhe, audit.gauss_writhe))
    assert two == pytest.approx(one, abs=1e-9) and three == pytest.approx(one, abs=5e-3)
    x = np.random.default_rng(2).normal(size=200)
    got = spark.createDataFrame([(float(t),) for t in x], "x double").agg(ensemble.bimodality("x")).head()[0]
    assert got == pytest.approx(audit.bimodality_of(x)) and audit.bimodality_of([1.0] * 9) == 0


def test_bundles_and_their_radius(spark):
    r = np.random.default_rng(5)
    c = {f: np.cumsum(r.standard_normal((n, 3)), 0) for f, n in enumerate((5, 9, 15))}
    got = {x.frame_id: x for x in geometry.bundle(points(spark, c)).collect()}
    assert {f: (len(x.seg), len(x.kappa), len(x.tau), len(x.writhe)) for f, x in got.items()} == {0: (4, 3, 2, 3), 1: (8, 7, 6, 5), 2: (14, 13, 12, 7)}
    w = {x.res: x.writhe for x in writhe.local_writhe(points(spark, {2: c[2]}), 4).collect()}
    assert got[2].writhe == pytest.approx([w[k] for k in sorted(w)])
    with pytest.raises(Exception, match="four points"):
        geometry.bundle(points(spark, {0: c[0][:3]})).collect()
    e = {f: np.cumsum(r.standard_normal((6, 3)), 0) for f in range(2)}
    rna = points(spark, e).withColumns({f"{s}{a}": F.col(a) + (0.0 if s == "o" else float(i + 1)) for s in "on" for i, a in enumerate("xyz")})
    b = geometry.bundle(rna, strand="n").where("frame_id = 1").head()
    assert (len(b.theta), len(b.writhe)) == (4, 2)
    a, t = (geometry.invariants(points(spark, {0: x})) for x in (e[0], e[1]))
    d = geometry.deltas(a, t).orderBy("res").collect()
    ka, kb = ([x.kappa for x in i.orderBy("res").collect()] for i in (a, t))
    assert d[0].d_kappa == pytest.approx(abs(ka[0] - kb[0])) and 0 <= d[0].d_tau <= 180


def test_queries_by_coordinates(spark):
    p = generators.noisy_helices(spark, 40, 20, decoys=8).cache()
    i = search.build_index(p, 6).cache()
    asked = [(r.x, r.y, r.z) for r in p.where("frame_id = 10").orderBy("res").collect()]
    by_id, by_points = (search.nearest(i, q, 5, width=6).collect() for q in (10, asked))
    assert by_points[0].frame_id == 10 and by_points == by_id and all(r.frame_id < 32 for r in by_id)
    some = search.nearest(i, 10, 35, 0.01, width=6).collect()  # fewer are in the radius, so three times as many are ranked
    assert len(some) == 35
    assert search.range_query(i, np.array(asked), 0.05, width=6).count() == search.range_query(i, 10, 0.05, width=6).count() >= 1
    for q in (asked, asked[3:10]):
        assert search.subcurve_nearest(p, q, 3, 9, 3).head().frame_id == 10
    with pytest.raises(Exception, match="another number of points"):
        search.nearest(i, asked[:12], 3, width=6).collect()
    with pytest.raises(Exception, match="no frame 77"):
        search.nearest(i, 77, 3, width=6).collect()
    with pytest.raises(ValueError, match="neither"):
        search.subcurve_nearest(p, asked[:5], 3, 9, 3)
    assert tuple(search.introspect(i).head()) == (40, 20, 20) and search.frame(i, 3).count() == 1


def test_arrays_and_expressions_have_one_distance(spark):
    r = np.random.default_rng(8)
    rows = [(i, r.uniform(0, 3, 6).tolist(), r.uniform(-3.1, 3.1, 5).tolist(), r.uniform(0, 3, 4).tolist(), r.uniform(-3.1, 3.1, 4).tolist()) for i in range(9)]
    df = spark.createDataFrame([*rows, (99, [], [], [1.0], [1.0])], "i int, ka array<double>, ta array<double>, kb array<double>, tb array<double>")
    cols = list(map(F.col, ("ka", "ta", "kb", "tb")))
    for metric, weights in (("frechet", (1.0, 1.0)), ("time_warp", (2.0, 0.5))):
        got = {x.i: x.d for x in curves.distances(df, "d", metric, ["ka", "ta"], ["kb", "tb"], weights).collect()}
        assert got == pytest.approx({x.i: x.d for x in df.select("i", v.METRICS[metric](*cols, *weights).alias("d")).collect()})
    flat = curves.gather(generators.random_walks(spark, 2, 9))
    assert curves.distances(flat.withColumn("b", F.col("points")), "d", "frechet_points", ["points"], ["b"]).head().d == 0
    one, two = (generators.random_walks(spark, 1, 12, seed=k) for k in (1, 2))
    got = search.sliding_frechet(one, two, 4).orderBy("start").collect()
    a, b = (np.array([(x.x, x.y, x.z) for x in p.orderBy("res").collect()]) for p in (one, two))
    assert [x.start for x in got] == list(range(9)) and got[0].centre == 2
    cost = np.linalg.norm(a[None, 3:7, None] - b[None, None, 3:7], axis=3)
    assert got[3].frechet == pytest.approx(curves.warp(cost, False)[0])


def test_network_against_numpy(spark):
    r = np.random.default_rng(6)
    c = {f: np.cumsum(r.standard_normal((8, 3)), 0) for f in range(40)}
    got = {(x.i, x.j): x.r for x in network.network(geometry.invariants(points(spark, c))).collect()}
    kappa, tau = (np.array([curves.invariants(c[f][None], 1e-9)[k][0] for f in c]) for k in (1, 2))
    tau = np.concatenate([tau, tau[:, -1:]], 1)
    turn = lambda a: (lambda d: np.arctan2(np.sin(d), np.cos(d)))(a - np.arctan2(np.sin(a).sum(0), np.cos(a).sum(0)))
    u = np.stack([turn(kappa), turn(tau)], 2)
    for (i, j), value in got.items():
        x = np.concatenate([u[:, i - 1], u[:, j - 1]], 1)
        s = x.T @ x / 39 + 1e-6 * np.eye(4)
        mi = max(0, -0.5 * (np.linalg.slogdet(s + 1e-6 * np.eye(4))[1] - np.linalg.slogdet(s[:2, :2])[1] - np.linalg.slogdet(s[2:, 2:])[1]))
        assert value == pytest.approx(math.sqrt(1 - math.exp(-2 * mi)))
    assert len(got) == 15


def test_landscapes(spark):
    p = generators.two_state(spark, 120, 20, (8, 12)).cache()
    assert p.where("res = 19").count() == 120
    f, names = search.dihedral_features(p)
    share = [r.share for r in search.explained_variance(f, names, 3).orderBy("component").collect()]
    assert share == sorted(share, reverse=True) and 0.5 < share[0] <= 1
    pc = search.dihedral_pca(p).cache()
    one, two = ([r.pc1 for r in pc.where(f"frame_id % 2 = {k}").collect()] for k in (0, 1))
    assert max(min(one), min(two)) > min(max(one), max(two))  # the two states are apart
    s = search.free_energy_surface(pc, "pc1", "pc2", 20).collect()
    assert len(s) == 400 and min(r.energy for r in s) == 0
    b = search.barrier(pc, "pc1").head()
    x = np.array([r.pc1 for r in pc.collect()])
    lo, hi = np.percentile(x, 1), np.percentile(x, 99)
    g = np.linspace(lo - 0.1 * (hi - lo), hi + 0.1 * (hi - lo), 100)
    d = np.exp(-0.5 * ((g[:, None] - x) / (x.std(ddof=1) * 120**-0.2)) ** 2).sum(1)
    e = -np.log(np.maximum(d / d.max(), 1e-4))
    w, u = e[:50].argmin(), 50 + e[50:].argmin()
    assert b.height == pytest.approx(e[w:u].max() - min(e[w], e[u])) and b.height > 1
    assert search.histogram_barrier(pc.withColumn("k", F.col("frame_id") % 2), "k", ["pc1", "pc2"]).head()[0] > 0
    none = pc.where("frame_id < 0")
    assert search.barrier(none, "pc1").count() == search.free_energy_surface(none, "pc1", "pc2").count() == 0
    d = ensemble.domain_means(ensemble.density_profile(p, 4), "mean_density", [("head", 0, 8), ("loop", 8, 12), ("none", 50, 60)]).collect()
    assert {r.domain for r in d} == {"head", "loop"} and all(r.peak >= r.mean for r in d)


def test_normal_modes_are_stiff_free(spark):
    c = generators.helix(12)
    rows = search.normal_modes(points(spark, {3: c}), 3, 2).collect()
    h = np.zeros((36, 36))
    for i in range(12):
        for j in range(12):
            d = c[i] - c[j]
            n = np.linalg.norm(d)
            if i != j and 0.1 < n < 9.5:
                k = np.outer(d, d) / n**4
                h[3 * i : 3 * i + 3, 3 * j : 3 * j + 3] -= k
                h[3 * i : 3 * i + 3, 3 * i : 3 * i + 3] += k
    value = np.linalg.eigvalsh(h)
    assert {r.mode: r.amplitude for r in rows} == pytest.approx({1: value[6] ** -0.5, 2: value[7] ** -0.5})
    m = np.array([(r.x, r.y, r.z) for r in sorted(rows, key=lambda r: r.res) if r.mode == 1]).ravel()
    assert np.allclose(h @ m, value[6] * m, atol=1e-9)


def test_stream_of_frames(spark, tmp_path):
    p = generators.random_walks(spark, 60, 12)
    bindings.to_arrays(p).repartition(4).write.parquet(str(tmp_path / "in"))
    stream.keep_profile(stream.read_frames(spark, str(tmp_path / "in"), 1), 6, "kept", str(tmp_path / "cp"))
    want = {r.window_start: (r.bc_kappa, r.bc_tau) for r in ensemble.bimodality_profile(geometry.invariants(p), 6).collect()}
    got = {r.window_start: (r.bc_kappa, r.bc_tau) for r in spark.table("kept").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got)


def test_windowed_moments_drop_late_rows(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "a", float(m)) for m in range(0, 50, 5)]
    df = spark.createDataFrame(rows, "t string, k string, x double").withColumn("t", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    moments.run_available(moments.windowed_moments(s, "t", "20 minutes", "5 minutes", ["k"], "x"), "win", str(tmp_path / "cp"), "update")
    assert sorted((r.n, r["mean"]) for r in spark.table("win").collect()) == [(2, 42.5), (4, 7.5), (4, 27.5)]


def test_generated_paths(spark):
    a, b = (points(spark, {0: c}).drop("frame_id") for c in (np.zeros((5, 3)), np.ones((5, 3))))
    got = generators.between(a, b, 4).where("res = 2").orderBy("frame_id").collect()
    assert [r.x for r in got] == [0, 0.25, 0.5, 0.75]
    p = generators.random_walks(spark, 5, 9).collect()
    assert p == generators.random_walks(spark, 5, 9).collect()


@pytest.mark.parametrize("bits", [2, 5, 16])
def test_models_over_the_edges_of_blocks(spark, monkeypatch, bits):
    """Files with models longer than a block, open, empty and doubly ended ones, and lines before the first; no window spans a file's lines."""
    monkeypatch.setattr(pdb, "BLOCK_BITS", bits)
    r = np.random.default_rng(bits)
    rows, want = [], []
    for path in [f"f{k}" for k in range(12)] + [None]:
        share = r.choice([0.0, 0.05, 0.3], 2)
        words = [r.choice(["MODEL     1", "ENDMDL", "ATOM"], p=[share[0], share[1], 1 - share.sum()]) for _ in range(150)]
        number = np.cumsum([w.startswith("MODEL") for w in words])
        for k, w in enumerate(words):
            rows.append((path, 3 * k - 40, f"{w}"))
            if not number[-1] or (number[k] and any(v == "ENDMDL" and n == number[k] for v, n in zip(words, number, strict=True))):
                want.append((str(path), 3 * k - 40, int(number[k])))
    df = spark.createDataFrame(rows, "path string, line_no int, line string").repartition(3)
    got = pdb.models(df)
    assert got.columns == ["path", "line_no", "line", "model"]
    assert sorted((str(t.path), t.line_no, t.model) for t in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [w for w in plan.splitlines() if "Window" in w and "line_no" in w and "_block" not in w]
