"""Recall of the curve search at production ranges where norms differ, by the operator itself."""

import numpy as np
import pandas as pd
import pytest

from strandlake.llm import ann


@pytest.mark.parametrize("kind", ["one long", "log-normal", "clusters"])
def test_recall_and_share(spark, kind):
    r = np.random.default_rng(0)
    n = 12000
    x = r.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "one long":
        x[777] *= 5
    if kind == "log-normal":
        x *= np.exp(0.3 * r.standard_normal((n, 1)))
    if kind == "clusters":
        mids = x[:60]
        x = mids[r.integers(0, 60, n)] + r.standard_normal((n, 64)) * 0.03
        x[100:400] = x[100]  # ties: 300 rows with one vector
    x = np.float32(x)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    shares = []
    found = ann.nearest(df, df.where("vec_id % 40 = 0"), k=20, shares=shares).collect()
    assert sum(a for a, _ in shares) <= shares[0][1]  # never more pairs than a scan
    x, got = x.astype(float), {}
    for f in found:
        got.setdefault(f.query_id, []).append(f.vec_id)
        assert f.score == pytest.approx(x[f.query_id] @ x[f.vec_id], abs=1e-12)
    hits = 0
    for q in range(0, n, 40):
        score = np.round(x @ x[q], 12)
        score[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(n), -score))[:20].tolist()) & set(got[q]))
        assert len(got[q]) == 20 and q not in got[q]
    assert hits >= 0.9 * 20 * (n / 40)
    if kind == "clusters":
        ties = [i for i in got[120] if 100 <= i < 400]
        assert sorted(ties) == [i for i in range(100, 400) if i != 120][: len(ties)]
