"""The jobs over growing and repeated input, on copies."""

import json
import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobs import conformer_index, text_moments

SF = "/root/testdata/sf0.001"


def profile_of(docs: pd.DataFrame) -> dict:
    """(source, lang, measure) -> n, mean, variance, skewness, excess kurtosis by plain sums."""
    import re

    out = {}
    for (source, lang), part in docs.groupby(["source", "lang"], dropna=False):
        texts = [t or "" for t in part["text"]]
        words = np.array([len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts], float)
        letters = np.array([len(re.sub(r"[\x20\x09-\x0D]+", "", t)) for t in texts], float)
        stops = np.array([len(re.findall(r"[.!?]", t)) for t in texts], float)
        for name, x in (("log_words", np.log1p(words)), ("word_length", letters[words > 0] / words[words > 0]), ("sentence_words", words / (stops + 1))):
            d = x - x.mean() if len(x) else x
            var = (d**2).mean() if len(x) else 0.0
            flat = var <= 1e-14
            out[source, lang, name] = [len(x), x.mean() if len(x) else 0.0, var, 0.0 if flat or len(x) < 3 else (d**3).mean() / var**1.5, 0.0 if flat or len(x) < 4 else (d**4).mean() / var**2 - 3]
    return out


def told(df) -> dict:
    null = lambda s: s if s is not None else np.nan
    return {(null(r.source), null(r.lang), r.measure): [r.n, r.mean, r.variance, r.skewness, r.kurtosis] for r in df.collect()}


def same(got: dict, want: dict) -> None:
    key = lambda d: {tuple(map(str, k)): v for k, v in d.items()}
    got, want = key(got), key(want)
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-7, atol=1e-9)


def test_text_moments_takes_only_what_is_new(spark, tmp_path):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    extra = pd.DataFrame({"doc_id": [-1, -2, -3], "text": [None, "", "a b. c!"], "lang": ["en", None, None], "source": [None, "s", "s"], "n_chars": [0, 0, 7]})
    parts = [docs.iloc[:70], pd.concat([docs.iloc[70:150], extra]), docs.iloc[150:]]
    table, seen = tmp_path / "documents.parquet", []
    table.mkdir()
    for k, part in enumerate(parts):
        part.to_parquet(table / f"part-{k}.parquet", index=False)
        seen.append(part)
        got = [told(text_moments.run(spark, str(tmp_path), f"{tmp_path}/out", f"{tmp_path}/mark")) for _ in range(2)]
        assert str(got[0]) == str(got[1])  # nothing new, the same to the last digit
        same(got[0], profile_of(pd.concat(seen)))
    states = spark.read.parquet(f"{tmp_path}/out/states")
    assert sorted(r.batch for r in states.select("batch").distinct().collect()) == [0, 1, 2]  # each file was summed once
    assert states.where("measure = 'log_words'").agg(F.sum("state.n")).head()[0] == len(docs) + 3


def test_text_moments_batch_is_replaced_when_repeated(spark, tmp_path):
    """A run that ended after its states were written and before its mark was: the batch comes again and counts once."""
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    table = tmp_path / "documents.parquet"
    table.mkdir()
    docs.to_parquet(table / "part-0.parquet", index=False)
    text_moments.run(spark, str(tmp_path), f"{tmp_path}/out", f"{tmp_path}/mark")
    for f in Path(f"{tmp_path}/mark/commits").iterdir():
        f.unlink()
    same(told(text_moments.run(spark, str(tmp_path), f"{tmp_path}/out", f"{tmp_path}/mark")), profile_of(docs))


def test_text_moments_in_many_batches(spark, tmp_path):
    """A bound on the files of a micro-batch changes nothing but the number of states."""
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    table = tmp_path / "a b" / "documents.parquet"
    table.mkdir(parents=True)
    for k in range(5):
        docs.iloc[k::5].to_parquet(table / f"part-{k}.parquet", index=False)
    same(told(text_moments.run(spark, str(table.parent), f"{tmp_path}/out", f"{tmp_path}/mark", files=2)), profile_of(docs))
    assert spark.read.parquet(f"{tmp_path}/out/states").select("batch").distinct().count() == 3


def test_text_moments_of_nothing(spark, tmp_path):
    pd.read_parquet(f"{SF}/documents.parquet").iloc[:0].to_parquet(tmp_path / "documents.parquet")
    assert text_moments.run(spark, str(tmp_path), f"{tmp_path}/out", f"{tmp_path}/mark").collect() == []


def test_conformer_index_keeps_what_it_rejects(spark, tmp_path):
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    bad = pd.DataFrame({"vec_id": [-1, -2, -3, -4], "embedding": [None, np.float32([0.5] * 64), np.float32([*range(63), np.nan]), np.float32([i // 3 for i in range(64)])], "label": [0, 0, 0, 0]})
    bad.at[2, "embedding"] = np.float32([0.1, np.nan, *([0.3] * 62)])
    pd.concat([e, bad]).to_parquet(tmp_path / "embeddings.parquet", index=False)
    runs = [conformer_index.run(spark, str(tmp_path), f"{tmp_path}/out", k=3, every=10).collect() for _ in range(2)]
    assert sorted(runs[0]) == sorted(runs[1])
    checked = spark.read.parquet(f"{tmp_path}/out/checked")
    assert checked.count() == len(e) + len(bad)
    rejected = {r.frame_id: (r.reason, r.place) for r in checked.where("status = 'rejected'").collect()}
    assert rejected == {-1: ("coordinate null or not finite", 0), -2: ("degenerate segment", 0), -3: ("coordinate null or not finite", 0), -4: ("collinear segments", 0)}
    spectra = {r.frame_id: np.array(r.writhe) for r in checked.where("status = 'kept'").collect()}
    want = []
    for q in spectra:
        if q % 10 == 0:
            d = sorted((float(np.sqrt(((spectra[q] - spectra[i]) ** 2).mean())), i) for i in spectra if i != q)
            want += [(q, r + 1, d[r][1]) for r in range(3)]
    assert sorted((r.query_id, r.rank, r.frame_id) for r in runs[0]) == sorted(want)


@pytest.mark.parametrize("job", ["text_moments", "conformer_index"])
def test_command_line(job, tmp_path):
    config = {"tables": SF, "output": f"{tmp_path}/out"} | ({"checkpoint": f"{tmp_path}/mark"} if job == "text_moments" else {"k": 2})
    (tmp_path / "c.json").write_text(json.dumps(config | {"output": "/nowhere"}))
    ran = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--config", f"{tmp_path}/c.json", "--output", f"{tmp_path}/out"], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert "wrote" in ran.stderr and (tmp_path / "out").is_dir()
