"""Searches by metric against plain programmes over all frames."""

import numpy as np
import pytest

from strandlake.operators import metrics, pivots


def curves_of(n, seed=0, least=3, most=18):
    """(kappa, tau) of random lengths in families that are alike, with angles at the branch cut and repeated curves."""
    r = np.random.default_rng(seed)
    bases = [(r.uniform(0, np.pi, 60), r.uniform(-np.pi, np.pi, 60)) for _ in range(12)]
    out = []
    for i in range(n):
        m, (k, t) = int(r.integers(least, most)), bases[i % 12]
        k = np.clip(k[:m] + 0.15 * r.standard_normal(m), 0, np.pi)
        t = np.angle(np.exp(1j * (t[:m] + 0.3 * r.standard_normal(m) + (np.pi if i % 5 == 0 else 0))))
        out.append((k, t) if i % 9 else out[i // 2] if i else (k, t))
    out[3] = (np.array([0.0, np.pi, 0.0]), np.array([np.pi, -np.pi, 0.0]))
    return out


def plain(a, b, total, weights=(1.0, 1.0)):
    n, m = min(map(len, a)), min(map(len, b))
    if not n or not m:
        return 0.0
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    for i in range(n):
        for j in range(m):
            t = abs(a[1][i] - b[1][j])
            t = 2 * np.pi - t if t > np.pi else t
            c = np.sqrt(weights[0] * (a[0][i] - b[0][j]) ** 2 + weights[1] * t * t)
            best = min(d[i, j + 1], d[i + 1, j], d[i, j])
            d[i + 1, j + 1] = best + c if total else max(best, c)
    return d[n, m] / ((n + m) if total else 1)


def table(spark, rows):
    return spark.createDataFrame([(i, k.tolist(), t.tolist(), [0.0]) for i, (k, t) in enumerate(rows)], "frame_id long, kappa array<double>, tau array<double>, writhe array<double>").repartition(3)


@pytest.mark.parametrize("name", ["frechet", "time_warp"])
@pytest.mark.parametrize("weights", [(1.0, 1.0), (0.0, 2.0), (3.0, 0.5)])
def test_cascade_equals_the_scan(spark, name, weights):
    rows = curves_of(400)
    df, of = table(spark, rows), metrics.metric(name, weights)
    for q in (3, 20, 21):
        query = rows[q]
        want = sorted((plain(query, x, name == "time_warp", weights), i) for i, x in enumerate(rows))
        got = metrics.nearest(df, query, 25, of).collect()
        assert [r.frame_id for r in got] == [i for _, i in want[:25]]
        assert np.allclose([r.distance for r in got], [d for d, _ in want[:25]], atol=1e-12)
        edge = want[60][0]
        assert {r.frame_id for r in metrics.within(df, query, edge * (1 + 1e-12), of).collect()} == {i for d, i in want if d <= edge * (1 + 1e-12)}
    assert metrics.nearest(df, (np.zeros(0), np.zeros(0)), 2, of).collect()[0].distance == 0.0


@pytest.mark.parametrize("name", ["frechet", "time_warp"])
def test_few_programmes_run_to_their_end(spark, name):
    rows = curves_of(3000, 1, 16, 18)
    counts = metrics.counter(spark.sparkContext)
    metrics.nearest(table(spark, rows).coalesce(1), rows[40], 10, metrics.metric(name), counts).collect()
    seen, first, second, abandoned, full = counts.value.tolist()
    assert seen == 3000 == first + second + abandoned + full
    assert full < 0.25 * seen and first > 0.3 * seen


def test_bounds_are_bounds():
    rows = curves_of(300, 2)
    for name in ("frechet", "time_warp"):
        of = metrics.metric(name, (2.0, 1.0))
        for q in range(0, 300, 30):
            low = metrics.cell_table(rows[q], of.weights)
            for k, t in rows:
                assert metrics.first_bound(k[None], t[None], rows[q], of, low)[0] <= plain(rows[q], (k, t), name == "time_warp", (2.0, 1.0)) + 1e-12


def test_pivot_curves_equal_the_scan(spark, tmp_path):
    rows = curves_of(1500, 4)
    rows[44] = (np.zeros(0), np.zeros(0))  # at 0 from all others, so no pivot tells of it
    of = metrics.metric("frechet", (1.0, 0.5))
    index = pivots.build(table(spark, rows).selectExpr("*", "kappa AS seg"), f"{tmp_path}/ix", pivots=5, cell_rows=100, metric=of)
    index = pivots.PivotIndex.open(spark, f"{tmp_path}/ix")
    assert index.metric == of
    for q in (7, 300):
        want = sorted((plain(rows[q], x, False, (1.0, 0.5)), i) for i, x in enumerate(rows))
        for got in (metrics.nearest(index, index.item(q), 12, of).collect(), index.nearest(index.item(q), 12).collect()):
            assert [r.frame_id for r in got] == [i for _, i in want[:12]]
        assert {r.frame_id for r in metrics.within(index, index.item(q), 0.4, of).collect()} == {i for d, i in want if d <= 0.4}
        assert index.candidates(index.item(q), 0.4).count() < 1500
    other = metrics.metric("time_warp")  # no pivots for it: a scan
    want = sorted((plain(rows[7], x, True), i) for i, x in enumerate(rows))
    assert [r.frame_id for r in metrics.nearest(index, index.item(7), 5, other).collect()] == [i for _, i in want[:5]]
    with pytest.raises(ValueError, match="triangle"):
        pivots.build(table(spark, rows), f"{tmp_path}/no", metric=other)
