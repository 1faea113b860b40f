"""The pivot index against scans, mergeable moment states against batch moments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import ensemble, pivots, search, states
from strandlake.sources import bindings
from strandlake.streaming import states as kept

SF = "/root/testdata/sf0.01"


def spectra(n, seed=0, length=11):
    r = np.random.default_rng(seed)
    steps = r.standard_normal((n, length + 8))
    return np.stack([steps[:, i : i + 9].mean(1) for i in range(length)], 1)


def indexed(spark, rows, path, **options):
    df = spark.createDataFrame([(i, [1.0], [0.5], [0.1], [float(x) for x in w]) for i, w in rows], "frame_id long, seg array<double>, kappa array<double>, tau array<double>, writhe array<double>")
    return pivots.build(df, path, **options)


def rms(a, b):
    m = min(len(a), len(b))
    return float(np.sqrt(((np.array(a[:m]) - np.array(b[:m])) ** 2).mean())) if m else 0.0


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Spectra with repeated rows, and some of another length."""
    x = spectra(3000)
    rows = [(i, x[i % 2600 if i < 2900 else 5]) for i in range(3000)] + [(4000 + i, spectra(40, 1, 7)[i]) for i in range(40)]
    return rows, indexed(spark, rows, f"{tmp_path_factory.mktemp('pivots')}/ix", cell_rows=100)


@pytest.mark.parametrize("query", [0, 5, 77, 4003])
def test_pivots_equal_the_scan(table, query):
    rows, index = table
    own = index.spectrum(query)
    far = sorted((rms(own, w), i) for i, w in rows)
    for k in (1, 20, 150, 5000):
        got = index.nearest(own, k).collect()
        assert [r.frame_id for r in got] == [i for _, i in far[:k]]
    edge = far[30][0]  # a frame at just this distance belongs to the result
    assert {r.frame_id for r in index.within(own, edge).select("frame_id").collect()} == {i for d, i in far if d <= edge}


def test_pivots_for_many_queries(spark, table):
    rows, index = table
    asked = [(i, w) for i, w in rows if i % 97 == 0 or i in (4003, 5)] + [(-7, [])]
    q = spark.createDataFrame([(i, [float(x) for x in w]) for i, w in asked], "query_id long, writhe array<double>")
    want = []
    for i, w in asked:
        far = sorted((rms(w, x), j) for j, x in rows if j != i)
        want += [(i, k + 1, far[k][1]) for k in range(6)]
    got = index.nearest_of(q, 6).collect()
    assert sorted((r.query_id, r.rank, r.frame_id) for r in got) == sorted(want)


def test_pivots_prune_and_push(spark, tmp_path):
    index = indexed(spark, [*enumerate(spectra(20000))], f"{tmp_path}/ix")
    own = index.spectrum(3)
    near = index.candidates(own, index.radius(own, 10))
    assert near.count() < 0.2 * 20000
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = near.select("frame_id")._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(p0" in plan and "LessThanOrEqual(p7" in plan
    assert "PartitionFilters: [isnotnull(even" in plan and "writhe" not in plan.rpartition("ReadSchema")[2]


def test_pivots_of_little(spark, tmp_path):
    empty = indexed(spark, [], f"{tmp_path}/none")
    assert empty.nearest(np.zeros(11), 3).collect() == []
    q = spark.createDataFrame([(1, [0.5, 0.5])], "query_id long, writhe array<double>")
    assert empty.nearest_of(q, 3).collect() == []
    alike = indexed(spark, [(i, [0.5] * 4) for i in range(30)], f"{tmp_path}/alike")
    assert [r.frame_id for r in alike.nearest(np.full(4, 0.5), 4).collect()] == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="no frame 99"):
        alike.spectrum(99)


def test_conformers_by_pivots(spark, tmp_path):
    index = search.build_index(bindings.frames(spark, SF))
    saved = pivots.build(index, f"{tmp_path}/ix", cell_rows=50)
    one = saved.frames.where("frame_id = 33").head()
    for k, coarse in ((5, 1.0), (12, 0.05)):
        want = search.nearest(index, 33, k, coarse).collect()
        assert saved.conformers(one.writhe, one.kappa, one.tau, k, coarse).collect() == want


def parts(spark):
    r = np.random.default_rng(3)
    x = [("a", float(v)) for v in r.gamma(2, 3, 500)] + [("b", 7.0)] * 5 + [("c", 1e6 + float(v)) for v in r.standard_normal(400)] + [("d", None), ("e", 2.0), (None, 4.0)]
    return spark.createDataFrame(x, "key string, x double").withColumn("part", F.pmod(F.hash("x"), F.lit(7)))


def test_states_merge_to_the_whole(spark):
    df = parts(spark)
    want = {r.key: r for r in ensemble.moments(df, ["key"], "x").collect()}
    stored = df.groupBy("key", "part").agg(states.state("x").alias("s"))
    got = stored.groupBy("key").agg(states.merge("s").alias("s")).select("key", *[c.alias(n) for n, c in states.summary("s").items()]).collect()
    assert len(got) == len(want)
    for r in got:
        for c in ("n", "mean", "variance", "skewness", "kurtosis", "bc"):
            assert getattr(r, c) == pytest.approx(getattr(want[r.key], c) or 0.0, rel=1e-6, abs=1e-9), (r.key, c)


def test_states_of_a_stream_outlive_a_restart(spark, tmp_path):
    """Two runs from one checkpoint, the second over new files only, end with the moments of all rows."""
    df = parts(spark).where("key IS NOT NULL")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(2):
            df.where(F.pmod("part", F.lit(2)) == k).select("key", "x").write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema("key string, x double").parquet(f"{tmp_path}/in")
            out = kept.streaming_states(stream, ["key"], "x")
            sink = lambda d, b, k=k: d.write.mode("overwrite").parquet(f"{tmp_path}/out/run={k}/batch={b}")
            out.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    last = spark.read.parquet(f"{tmp_path}/out").groupBy("key").agg(F.max_by(F.struct("n", "mean", "m2", "m3", "m4"), F.struct("run", "batch")).alias("s"))
    got = {r.key: r for r in last.select("key", *[c.alias(n) for n, c in states.summary("s").items()]).collect()}
    want = {r.key: r for r in ensemble.moments(df, ["key"], "x").collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        for c in ("n", "mean", "variance", "skewness", "kurtosis"):
            assert getattr(r, c) == pytest.approx(getattr(want[k], c) or 0.0, rel=1e-5, abs=1e-9), (k, c)


def test_orders_on_a_line_make_curves(spark, tmp_path):
    """By the SQL of checked_orders only the number of points tells; terms that a line leaves undefined are null."""
    import duckdb

    from strandlake.plans.oracles import SQL
    from strandlake.plans.queries import QUERIES

    rows = [(1, i, 1, 1, 34.0, p, 0.04) for i, p in enumerate((50170.0, 38580.0, 94951.0))] + [(1, 4, 1, 1, 31.0, 82798.0, 0.09), (1, 7, 1, 1, 21.0, 72716.0, 0.05)]
    rows += [(2, i, 1, 1, 8.0, 900.0, 0.01) for i in range(4)] + [(3, i, 1, 1, float(i * i), 10.0 * i, 0.01 * i**3) for i in range(3)]
    rows += [(4, i, 1, 1, float(i * i), None if i == 2 else 1000.0 * i, 0.01 * i**3) for i in range(5)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES["checked_orders"](spark, str(tmp_path)).collect())) == sorted(c.sql(SQL["checked_orders"]).fetchall())
    checked = search.checked_index(bindings.order_curves(spark, str(tmp_path)), 2, "null")
    one, two, _, four = (r.asDict() for r in checked.orderBy("frame_id").collect())
    assert len(one["seg"]) == 4 and None not in one["seg"] and one["tau"][0] is None
    assert two["seg"] == [None] * 3 and [x is None for x in four["seg"]] == [False, True, True, False]
    strict = {r.frame_id: r.reason for r in search.checked_index(bindings.order_curves(spark, str(tmp_path)), 2).collect()}
    assert strict == {1: "collinear segments", 2: "degenerate segment", 3: "too few points", 4: "coordinate null or not finite"}


@pytest.mark.parametrize("most", [16, 65536])
def test_silhouette_of_groups_equals_brute_force(spark, monkeypatch, most):
    """Pairs of groups are partitions of one shuffle, no join; close rows keep their digits, and rows without a label or a component count as 0."""
    monkeypatch.setattr(search, "GROUP_ROWS", most)
    r = np.random.default_rng(3)
    x = 1e3 + 1e-6 * r.standard_normal((70, 5))
    x[40:] += 5 * r.standard_normal((30, 5))
    x[50:55] = x[45]
    label = [None if i in (7, 60) else str(i % 3) if i < 66 else "alone" if i == 66 else "b" for i in range(70)]
    lost = {9, 44}
    rows = [(i, label[i], *(None if i in lost and k == 2 else float(v) for k, v in enumerate(x[i]))) for i in range(70)]
    got = search.silhouette(spark.createDataFrame(rows, "frame_id long, label string, a double, b double, c double, d double, e double"), "label", list("abcde"))
    s = []
    for i in range(70):
        far = {}
        for j in range(70):
            if i != j and label[j] is not None and not {i, j} & lost:
                far.setdefault(label[j], []).append(np.sqrt(((x[i] - x[j]) ** 2).sum()))
        mean = {k: float(np.mean(v)) for k, v in far.items()}
        own, other = mean.pop(label[i], None), min(mean.values(), default=None)
        s.append(0.0 if None in (own, other, label[i]) else (other - own) / max(own, other))
    assert got.head()[0] == pytest.approx(np.mean(s), abs=1e-9)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString() and "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()


def test_silhouette_sums_each_distance_once(monkeypatch):
    r, made = np.random.default_rng(4), []
    x = r.standard_normal((1500, 4))
    rows = np.arange(1500), np.sort(r.integers(0, 6, 1500)), np.hstack([x, (x * x).sum(1, keepdims=True), np.ones((1500, 1))])
    block = search._block_distances
    monkeypatch.setattr(search, "_block_distances", lambda a, b: made.append((len(a), len(b))) or block(a, b))
    got, _ = search._pair_sums(rows, rows, True)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(got, np.stack([d[:, rows[1] == k].sum(1) for k in range(6)], 1), atol=1e-9)
    assert sum(n * m for n, m in made) < 0.7 * 1500**2


def test_cells_need_no_python_workers_beside_those_of_the_search(spark, table):
    _, index = table
    cuts = [0.5, 1.0, 2.0]
    at = [-float("inf"), 0.4, 0.5, 0.7, 1.0, 2.0, 3.0, float("inf"), float("nan")]
    got = spark.createDataFrame([(x,) for x in at], "p double").select(pivots._cell(F.col("p"), cuts).alias("c")).collect()
    assert [r.c for r in got] == np.searchsorted(cuts, at, side="right").tolist()
    q = spark.createDataFrame([(0, [float(x) for x in index.spectrum(0)])], "query_id long, writhe array<double>")
    plan = index.nearest_of(q, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInPandas" not in plan


def test_workers_of_jobs_give_memory_back(spark):
    from jobs.common import ship

    ship(spark)
    env = spark.sparkContext.environment
    assert env["ARROW_DEFAULT_MEMORY_POOL"] == "system" and int(env["MALLOC_TRIM_THRESHOLD_"]) <= 4 << 20
