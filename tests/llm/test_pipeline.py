"""Every stage of the pipeline on what the stage before kept, against plain Python."""

import hashlib
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import packing, quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables, with more near copies, passages that repeat, a hot source, and nulls."""
    path = tmp_path_factory.mktemp("tables")
    docs, labels = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/labels.parquet")
    r = random.Random(3)
    some = [t for t in docs["text"] if t and 600 < len(t) < 4000][:20]
    more = []
    for k, t in enumerate(some[:10]):
        w = t.split(" ")
        w[len(w) // 2] = "otherwise"
        more.append(" ".join(w))
        more.append(f"{some[(k + 7) % 20][:300]} unlike {k} " + " ".join(r.choices(t.split(" "), k=80)) + " " + some[10 + k][100:700])
    extra = pd.DataFrame({"doc_id": range(10_000, 10_000 + len(more)), "text": more, "lang": "en", "source": [None, "hot", "hot", "hot"] * (len(more) // 4), "n_chars": [len(t) for t in more]})
    nulls = pd.DataFrame({"doc_id": [20_000, 20_001], "text": [None, ""], "lang": [None, "en"], "source": ["hot", None], "n_chars": [0, 0]})
    pd.concat([docs, extra, nulls]).astype({"doc_id": "int64", "n_chars": "int64"}).to_parquet(path / "documents.parquet", index=False)
    labels.to_parquet(path / "labels.parquet", index=False)
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What each stage got and gave."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage-{k}")
        got = spark.read.parquet(f"{folder}/stage-{k}")
        out.append((docs, got))
        docs = got
    return out


def rows(df, columns=COLUMNS):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_columns_are_those_of_documents(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "mixing sources", "best-fit packing"]
    assert all(got.columns == COLUMNS for _, got in stages[:-1])


def test_quality_stage(spark, stages, folder):
    before, after = stages[0]
    scored = quality.classify(before, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").select("doc_id")
    assert rows(after) == rows(before.join(scored, "doc_id")) and 0 < after.count() < before.count()


def test_near_duplicate_stage(stages):
    before, after = stages[1]
    all_ = rows(before)
    sets, group = [shingles(r[1]) for r in all_], list(range(len(all_)))
    for i in range(len(all_)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for r, g, s in zip(all_, group, sets, strict=True):
        least[g] = min(least.get(g, r[0]), r[0]) if s else r[0]
    want = [r for r, g in zip(all_, group, strict=True) if r[0] == least[g]]
    assert rows(after) == want and len(want) < len(all_)


def test_repeats_stage(stages):
    before, after = stages[2]
    all_ = rows(before)
    seen = {}
    for k, r in enumerate(all_):
        b = (r[1] or "").encode()
        for i in range(len(b) - 199):
            seen.setdefault(b[i : i + 200], []).append((k, i))
    gone = [bytearray(len((r[1] or "").encode())) for r in all_]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + 200] = b"\x01" * 200
    want = []
    for r, g in zip(all_, gone, strict=True):
        if r[1] is None or not any(g):
            want.append(r)
            continue
        text = bytes(c for c, x in zip(r[1].encode(), g, strict=True) if not x).decode("utf-8", "ignore")
        want.append((*r[:1], text, *r[2:4], len(text)))
    assert rows(after) == sorted(want, key=repr) and want != all_


def test_mixing_stage(stages):
    before, after = stages[3]
    all_ = rows(before)
    size = {r: len(WORD.findall(r[1] or "")) for r in all_}
    sources = sorted({r[3] for r in all_ if r[3] is not None}) + ([None] if any(r[3] is None for r in all_) else [])
    total = {s: sum(size[r] for r in all_ if r[3] == s) for s in sources}
    goal, weight = {}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    left, free = 1.5 * sum(total.values()), set(sources)
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share > 2 * total[s]}
        if not over:
            goal |= {s: weight[s] * share for s in free}
            break
        goal |= {s: 2.0 * total[s] for s in over}
        left -= sum(2.0 * total[s] for s in over)
        free -= over
    want = []
    for s in sources:
        own = [r for r in all_ if r[3] == s]
        name = lambda r: f"{r[0]}:{size[r]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}"
        own.sort(key=lambda r: (hashlib.md5(name(r).encode()).hexdigest(), r[0], size[r]))
        budget = int(goal[s])
        whole, rest = divmod(budget, total[s]) if total[s] else (0, 0)
        at = 0
        for r in own:
            want += [r] * (whole + (at < rest)) if size[r] else []
            at += size[r]
    assert rows(after) == sorted(want, key=repr)


def test_packing_stage(stages):
    before, after = stages[4]
    words = {}
    for r in rows(before):
        words.setdefault(r[0], []).append(len(WORD.findall(r[1] or "")))
    parts, bins = {}, {}
    for r in after.collect():
        parts[r.doc_id] = parts.get(r.doc_id, 0) + r.length
        if r.length:
            bins.setdefault((r.shard, r.sequence), []).append(r)
    assert parts == {k: sum(v) for k, v in words.items()}
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        used = sum(r.length for r in own)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert own[0].capacity == min(c for c in packing.CAPACITIES if c >= used)
    lengths = [r.length for r in after.where(F.col("length") > 0).collect()]  # one shard: the plain best fit fills as many of each capacity
    import numpy as np

    _, _, caps = packing.best_fit(np.array(lengths), packing.CAPACITIES)
    assert sorted(caps.tolist()) == sorted(own[0].capacity for own in bins.values())


def test_run_is_the_stages(spark, stages, folder):
    assert rows(corpus_pipeline.run(spark, folder), stages[-1][1].columns) == rows(stages[-1][1], stages[-1][1].columns)
