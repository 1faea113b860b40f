"""Analytic fixtures, invariances and independent NumPy versions of the curve operators."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import vec as v
from strandlake.operators import ensemble, geometry, network, search, writhe
from strandlake.sources import bindings, dcd, pdb
from strandlake.streaming import moments as stream


def points(spark, curves):
    rows = [(int(f), i, *map(float, p)) for f, c in curves.items() for i, p in enumerate(c)]
    return spark.createDataFrame(rows, "frame_id long, res int, x double, y double, z double")


def helix(n, sign=1):
    a = np.radians(100) * np.arange(n)
    return np.stack([2.3 * np.cos(a), sign * 2.3 * np.sin(a), 1.5 * np.arange(n)], 1)


def turned(c, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((3, 3)))
    return c @ (q * np.linalg.det(q)).T + 5


def by_res(df, col):
    return [r[col] for r in df.orderBy("frame_id", "res").collect() if r[col] is not None]


def test_helix_is_uniform_and_chiral(spark):
    p = points(spark, {0: helix(25), 1: helix(25, -1)})
    rows = geometry.invariants(p).where("tau IS NOT NULL").collect()
    assert np.ptp([r.kappa for r in rows]) < 1e-9
    left, right = ([r.tau for r in rows if r.frame_id == f] for f in (0, 1))
    assert np.allclose(left, -np.array(right)) and np.ptp(left) < 1e-9
    w = {r.frame_id: r.writhe for r in writhe.total_writhe(p).collect()}
    assert w[0] == pytest.approx(-1.46505, abs=1e-4) and w[1] == pytest.approx(-w[0])
    assert {r.frame_id: r.writhe for r in writhe.standard_writhe(p).collect()}[0] == pytest.approx(2.9301, abs=1e-3)


def test_rigid_motion_changes_nothing(spark):
    c = np.cumsum(np.random.default_rng(2).standard_normal((20, 3)), 0)
    p = points(spark, {0: c, 1: turned(c, 3)})
    for df, col in ((geometry.invariants(p), "kappa"), (geometry.invariants(p), "tau"), (writhe.local_writhe(p, 4), "writhe"), (writhe.compactness(p, 4), "compactness")):
        got = by_res(df, col)
        assert np.allclose(got[: len(got) // 2], got[len(got) // 2 :], atol=1e-9)
    assert max(r.rmsd for r in search.superpose(p, 0).collect()) < 1e-6


def test_subcurve_is_local(spark):
    p = points(spark, {0: np.cumsum(np.random.default_rng(4).standard_normal((30, 3)), 0)})
    part = by_res(geometry.invariants(geometry.subcurve(p, 8, 16)), "tau")
    assert np.allclose(part, by_res(geometry.invariants(p), "tau")[8:14])
    assert geometry.subcurve(p, 8, 10).count() == 0


def test_degenerate_and_collinear(spark):
    p = points(spark, {0: [(0, 0, 0), (0, 0, 0), (1, 0, 0), (1, 1, 0)]})
    q = points(spark, {0: [(0, 0, 0), (1, 0, 0), (2, 0, 0), (2, 1, 0)]})
    for bad in (p, q):
        with pytest.raises(Exception, match="degenerate|collinear"):
            geometry.invariants(bad).collect()
        assert geometry.invariants(bad, "null").count() == 4


def test_flat_curves_have_no_compactness(spark):
    a = np.pi / 10 * np.arange(20)
    p = points(spark, {0: np.stack([3.8 * np.arange(20), 0 * a, 0 * a], 1), 1: np.stack([10 * np.cos(a), 10 * np.sin(a), 0 * a], 1)})
    assert max(by_res(writhe.compactness(p, 4), "compactness")) < 1e-9


def test_rebuilt_curve(spark):
    c = np.cumsum(np.random.default_rng(5).standard_normal((12, 3)), 0)
    p = points(spark, {0: c})
    again = bindings.to_points(geometry.integrate(search.build_index(p, 4)))
    assert search.superpose(p.unionAll(again.withColumn("frame_id", F.lit(1).cast("long"))), 0).where("frame_id = 1").head().rmsd < 1e-6


def test_bimodality_coefficient(spark):
    r = np.random.default_rng(1)
    data = {"normal": r.standard_normal(4000), "uniform": r.uniform(-1, 1, 4000), "two": r.choice([-3.0, 3.0], 4000), "short": [1.0, 2.0], "flat": [5.0] * 100}
    df = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs], "k string, x double")
    got = {r.k: r.bc for r in ensemble.moments(df, ["k"], "x").collect()}
    assert got["normal"] == pytest.approx(0.333, abs=0.05) and got["uniform"] == pytest.approx(0.555, abs=0.05)
    assert got["two"] > 0.95 and got["short"] == 0 and got["flat"] == 0


def test_islands_and_peak(spark):
    p = spark.createDataFrame([(i, i + 7, s) for i, s in enumerate([0.1, 0.7, 0.9, 0.1, 0.9, 0.1, 0.1, 0.8])], "window_start int, window_end int, score double")
    got = sorted(map(tuple, ensemble.candidates(p, 0.6).collect()))
    assert got == [(1, 11, 2, 0.9), (7, 14, 7, 0.8)]
    assert len(ensemble.candidates(p, 0.6, gap=0).collect()) == 3


def _grid(a, b, cost, total):
    d = np.full((len(a), len(b)), np.inf)
    for i in range(len(a)):
        for j in range(len(b)):
            best = 0.0 if i == j == 0 else min(d[i - 1, j] if i else np.inf, d[i, j - 1] if j else np.inf, d[i - 1, j - 1] if i and j else np.inf)
            d[i, j] = best + cost(a[i], b[j]) if total else max(best, cost(a[i], b[j]))
    return d[-1, -1]


def test_curve_distances(spark):
    r = np.random.default_rng(8)
    rows = [(i, r.uniform(0, 3, 6).tolist(), r.uniform(-3.1, 3.1, 5).tolist(), r.uniform(0, 3, 4).tolist(), r.uniform(-3.1, 3.1, 4).tolist()) for i in range(20)]
    df = spark.createDataFrame([*rows, (99, [], [], [1.0], [1.0])], "i int, ka array<double>, ta array<double>, kb array<double>, tb array<double>")
    got = {x.i: x for x in df.select("i", v.frechet(*map(F.col, ("ka", "ta", "kb", "tb"))).alias("f"), v.time_warp(*map(F.col, ("ka", "ta", "kb", "tb"))).alias("t")).collect()}

    def cost(p, q):
        t = abs(p[1] - q[1])
        return math.hypot(p[0] - q[0], min(t, 2 * math.pi - t))

    for i, ka, ta, kb, tb in rows:
        a, b = list(zip(ka, ta, strict=False)), list(zip(kb, tb, strict=False))
        assert got[i].f == pytest.approx(_grid(a, b, cost, False)) and got[i].t == pytest.approx(_grid(a, b, cost, True) / (len(a) + len(b)))
    assert got[99].f == 0 and got[99].t == 0


def test_whole_curves_are_compared(spark, tmp_path):
    from strandlake.plans.queries import QUERIES

    r = np.random.default_rng(12)
    e = r.standard_normal((3, 64))
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(e)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    kappas = {x.frame_id: (x.kappa, x.tau) for x in search.build_index(bindings.frames(spark, str(tmp_path))).collect()}
    bends = {f: list(zip(*kt, strict=False)) for f, kt in kappas.items()}
    assert {len(b) for b in bends.values()} == {18}

    def cost(p, q):
        t = abs(p[1] - q[1])
        return math.hypot(p[0] - q[0], min(t, 2 * math.pi - t))

    got = {x.a: x.warp for x in QUERIES["time_warp_pairs"](spark, str(tmp_path)).collect()}
    assert got == {f: pytest.approx(_grid(bends[f], bends[f + 1], cost, True) / 36, abs=2e-6) for f in (0, 1)}
    day = np.datetime64("2024-01-01", "us")
    rows, curves = [], {}
    for u, n in ((0, 7), (1, 12), (2, 9)):
        for k in range(n):
            hours, value, props = float(u + 2 * k), float(r.normal(0, 1 + 9 * (k >= 5))), int(r.integers(0, 90))
            rows.append((len(rows), (day + np.timedelta64(int(hours * 3600), "s")).astype(object), u, value, f'{{"k": {props}}}'))
            curves.setdefault(u, []).append(np.array([hours, value, props]))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {x.a: x.frechet for x in QUERIES["frechet_points_users"](spark, str(tmp_path)).collect()}
    assert got == {u: pytest.approx(_grid(curves[u], curves[u + 1], lambda p, q: np.linalg.norm(p - q), False), abs=2e-6) for u in (0, 1)}


def test_search_finds_itself_first(spark):
    r = np.random.default_rng(3)
    p = points(spark, {f: helix(20) + r.normal(0, 0.05 if f < 15 else 0.8, (20, 3)) for f in range(20)})
    i = search.build_index(p, 6).cache()
    assert [x.frame_id for x in search.nearest(i, 10, 5).collect()][0] == 10
    assert {x.frame_id for x in search.nearest(i, 10, 5).collect()} <= set(range(15))
    w = {x.frame_id: np.array(x.writhe) for x in i.collect()}
    want = {f for f in w if np.sqrt(((w[f] - w[10]) ** 2).mean()) <= 0.05}
    assert {x.frame_id for x in search.range_query(i, 10, 0.05).collect()} == want and 10 in want
    assert search.subcurve_nearest(p, 4, 3, 9, 3).head().frechet == 0


def test_network_bounds(spark):
    r = np.random.default_rng(6)
    p = points(spark, {f: np.cumsum(r.standard_normal((8, 3)), 0) for f in range(12)})
    inv = geometry.invariants(p)
    e = network.network(inv)
    assert all(0 <= x.r <= 1 for x in e.collect()) and e.count() == 15
    m = {(x.i, x.j): x.r for x in network.full_matrix(e, 8).collect()}
    assert len(m) == 64 and all(m[i, i] == 1 for i in range(8)) and all(m[i, j] == m[j, i] for i, j in m) and m[0, 3] == 0
    assert network.cooperativity(e, spark.createDataFrame([(0, 50)], "i int, j int")).head()[0] == 0


def test_pdb_scan(spark, tmp_path):
    def line(n, atom, res, chain, seq, x, alt=" ", rec="ATOM  "):
        return f"{rec}{n:5d} {atom:<4}{alt}{res:>3} {chain}{seq:4d}    {x:8.3f}{2.0:8.3f}{3.0:8.3f}  1.00  7.50"

    text = [line(1, " CA ", "ALA", "A", 1, 1.0), line(2, " CB ", "ALA", "A", 1, 1.5), line(3, " CA ", "GLY", "A", 2, 2.0), line(4, " CA ", "GLY", "A", 2, 9.0, "B"), line(5, " CA ", "SER", "B", 1, 3.0), line(6, " N  ", "SER", "B", 7, 3.0), "TER"]
    (tmp_path / "a.pdb").write_text("\n".join(text))
    rows = pdb.lines(spark, str(tmp_path / "a.pdb"))
    got = {(r.chain_id, r.seq_id): r for r in pdb.residues(rows).collect()}
    assert set(got) == {("A", 1), ("A", 2), ("B", 1)} and got["A", 2].ca.x == 2.0 and got["A", 2].cb is None and got["A", 1].b_factor == 7.5
    assert pdb.residues(rows, "B").count() == 1
    (tmp_path / "m.pdb").write_text("\n".join(["MODEL 1", text[0], "ENDMDL", "MODEL 2", text[0], "ENDMDL", "MODEL 3", text[0]]))
    assert pdb.residues(pdb.models(pdb.lines(spark, str(tmp_path / "m.pdb")))).count() == 2
    bad = rows.unionAll(spark.createDataFrame([("x", 9, text[0][:22] + " xyz" + text[0][26:])], rows.schema))
    assert pdb.residues(bad, mode="null").count() == 3


def test_dcd_round_trip(spark, tmp_path):
    r = np.random.default_rng(9)
    rows = [(i, (50.0 + i, 90.0, 60.0, 90.0, 90.0, 70.0), *[r.random(10).astype(np.float32).tolist() for _ in range(3)]) for i in range(5)]
    df = spark.createDataFrame(rows, "frame_idx long, cell struct<a:double,gamma:double,b:double,beta:double,alpha:double,c:double>, x array<float>, y array<float>, z array<float>")
    path = str(tmp_path / "t.dcd")
    dcd.write_dcd(df, path)
    h = dcd.header(path)
    assert (h["declared"], h["frames"], h["atoms"], h["cell"], h["cut"]) == (5, 5, 10, True, False)
    got = sorted(map(tuple, dcd.read_dcd(spark, path).drop("path").collect()))
    assert [(g[0], tuple(g[1]), *g[2:]) for g in got] == rows
    p = dcd.project(dcd.read_dcd(spark, path), [3, 3, 0])
    assert p.count() == 15 and p.where("frame_id = 1 AND res = 0").head().x == pytest.approx(rows[1][2][3])
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX|out of bounds"):
        dcd.project(dcd.read_dcd(spark, path), [99]).collect()
    (tmp_path / "cut.dcd").write_bytes(open(path, "rb").read()[:-7])
    assert dcd.read_dcd(spark, str(tmp_path / "cut.dcd"), strict=False).count() == 4
    with pytest.raises(Exception, match="cut"):
        dcd.read_dcd(spark, str(tmp_path / "cut.dcd")).count()
    assert struct.unpack("<i", open(path, "rb").read(4))[0] == 84


def test_streaming_moments_match_batch(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, float((i * 37) % 11)) for i in range(300)], "k long, x double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.run_available(stream.streaming_moments(s, ["k"], "x"), "mom", str(tmp_path / "cp"))
    got = {r.k: r.bc for r in spark.table("mom").collect()}
    want = {r.k: r.bc for r in ensemble.moments(df, ["k"], "x").collect()}
    assert got == pytest.approx(want)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 45
    assert e.entry(spark).count() == 14


def test_components_and_free_energy_in_numpy(spark):
    x = np.cumsum(np.random.default_rng(4).standard_normal((80, 3)), 0) @ np.diag([3.0, 1.0, 0.3])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "frame_id long, a double, b double, c double")
    c = x - x.mean(0)
    _, vec = np.linalg.eigh(c.T @ c / len(c))
    w = vec[:, -1] * np.sign(vec[np.abs(vec[:, -1]).argmax(), -1])
    got = [r.pc1 for r in search.pca(df, ["a", "b", "c"]).orderBy("frame_id").collect()]
    assert np.allclose(got, c @ w)
    lag = (c[:-3].T @ c[3:]) / (len(c) - 3)
    val, v_ = np.linalg.eigh(c.T @ c / len(c) + 1e-4 * np.eye(3))
    white = v_ / np.sqrt(val)
    _, u = np.linalg.eigh(white.T @ ((lag + lag.T) / 2) @ white)
    w = white @ u[:, -1]
    w = w * np.sign(w[np.abs(w).argmax()])
    assert np.allclose([r.ic1 for r in search.lagged_components(df, ["a", "b", "c"], 3).orderBy("frame_id").collect()], c @ w)
    a = x[:, 0]
    h = a.std(ddof=1) * len(a) ** -0.2
    grid = np.linspace(np.percentile(a, 1), np.percentile(a, 99), 50)
    e = -np.log(np.maximum(np.exp(-((a[None] - grid[:, None]) ** 2) / (2 * h * h)).sum(1) / (len(a) * h * np.sqrt(2 * np.pi)), 1e-4))
    assert np.allclose([r.energy for r in search.free_energy(df, "a").orderBy("x").collect()], e - e.min())


def test_features_are_all_components(spark, tmp_path):
    from strandlake.plans.queries import QUERIES

    r = np.random.default_rng(14)
    label = np.arange(60) % 3
    x = np.cumsum(r.standard_normal((60, 64)), 0) * np.linspace(0.1, 3, 64) + 4 * label[:, None] * (np.arange(64) >= 40)
    spark.createDataFrame([(i, v_.tolist(), int(k)) for i, (v_, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    run = lambda q: QUERIES[q](spark, str(tmp_path))
    d, s = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), []
    for i in range(60):
        own, *other = [d[i, (label == k) & (np.arange(60) != i)].mean() for k in (label[i], *{0, 1, 2} - {label[i]})]
        s.append((min(other) - own) / max(min(other), own))
    assert run("silhouette").head()[0] == pytest.approx(np.mean(s), abs=2e-6)
    c = x - x.mean(0)
    _, vec = np.linalg.eigh(c.T @ c / 60)
    w = vec[:, -1] * np.sign(vec[np.abs(vec[:, -1]).argmax(), -1])
    assert np.allclose([t.pc1 for t in run("pca").orderBy("frame_id").collect()], c @ w, atol=2e-6)
    lag = c[:-3].T @ c[3:] / 57
    val, v_ = np.linalg.eigh(c.T @ c / 60 + 1e-4 * np.eye(64))
    white = v_ / np.sqrt(val)
    _, u = np.linalg.eigh(white.T @ ((lag + lag.T) / 2) @ white)
    w = white @ u[:, -1]
    w = w * np.sign(w[np.abs(w).argmax()])
    assert np.allclose([t.ic1 for t in run("lagged_components").orderBy("frame_id").collect()], c @ w, rtol=1e-4, atol=1e-4)


def test_pseudo_strand_without_bisector(spark):
    rows = [(1, k, 3.0 * k, 0.0, 0.0) for k in range(3)] + [(2, 0, 0.0, 0.0, 0.0)] + [(3, k, 0.0, 0.0, 3.0 * k) for k in range(2)]
    got = geometry.pseudo_strand(spark.createDataFrame(rows, "frame_id long, res int, x double, y double, z double")).orderBy("frame_id", "res").collect()
    assert [(r.px - r.x, r.py - r.y, r.pz - r.z) for r in got] == [pytest.approx(p) for p in [(0, 1.52, 0)] * 4 + [(0, -1.52, 0)] * 2]
