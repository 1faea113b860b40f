"""The jobs as queries: run twice into one new folder, and what is there then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.plans import oracles
from strandlake.plans.queries import rounded
from strandlake.storage import new_folder

from . import conformer_index, text_moments


def job1_text_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of text measures by source and language; the second run finds nothing new."""
    base = new_folder(spark, "job1")
    for _ in range(2):
        out = text_moments.run(spark, sf_dir, f"{base}/output", f"{base}/mark")
    return rounded(out)


def job2_conformer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every 50th frame by a saved index, built and asked twice."""
    base = new_folder(spark, "job2")
    for _ in range(2):
        out = conformer_index.run(spark, sf_dir, f"{base}/output")
    return rounded(out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_text_moments, job2_conformer_index)}

SQL: dict[str, str] = {
    "job1_text_moments": r"""
WITH s AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::DOUBLE AS words,
             length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g'))::DOUBLE AS letters, len(regexp_extract_all(coalesce(text, ''), '[.!?]'))::DOUBLE AS stops FROM documents),
v AS (SELECT source, lang, 'log_words' AS measure, ln(1 + words) AS x FROM s UNION ALL SELECT source, lang, 'word_length', CASE WHEN words > 0 THEN letters / words END FROM s
      UNION ALL SELECT source, lang, 'sentence_words', words / (stops + 1) FROM s),
mu AS (SELECT *, avg(x) OVER (PARTITION BY source, lang, measure) AS m FROM v),
c AS (SELECT source, lang, measure, count(x) AS n, coalesce(avg(x), 0) AS mean, coalesce(avg((x - m) * (x - m)), 0) AS v2, coalesce(avg((x - m) * (x - m) * (x - m)), 0) AS v3, coalesce(avg((x - m) * (x - m) * (x - m) * (x - m)), 0) AS v4
      FROM mu GROUP BY ALL),
k AS (SELECT *, CASE WHEN v2 <= 1e-14 OR n < 3 THEN 0 ELSE v3 / (v2 * sqrt(v2)) END AS skewness, CASE WHEN v2 <= 1e-14 OR n < 4 THEN 0 ELSE v4 / (v2 * v2) - 3 END AS kurtosis FROM c),
b AS (SELECT *, CASE WHEN n < 4 OR v2 <= 1e-14 THEN 0 ELSE kurtosis + 3.0 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)) END AS low FROM k),
t AS (SELECT *, CASE WHEN low <= 1e-12 THEN 0 ELSE greatest(0, least(1, (skewness * skewness + 1) / low)) END AS bc FROM b)
SELECT source, lang, measure, n::BIGINT AS n, round(mean, 6) + 0.0 AS mean, round(v2, 6) + 0.0 AS variance, round(skewness, 6) + 0.0 AS skewness, round(kurtosis, 6) + 0.0 AS kurtosis, round(bc, 6) + 0.0 AS bc, bc > 5.0::DOUBLE / 9.0::DOUBLE AS bimodal FROM t
""",
    "job2_conformer_index": f"""WITH {oracles.FRAMES}, {oracles.PAIRS}, {oracles.LOCAL5},
d AS (SELECT q.frame_id AS query_id, a.frame_id, sqrt(avg((a.writhe - q.writhe) * (a.writhe - q.writhe))) AS d FROM lw q JOIN lw a ON a.res = q.res AND a.frame_id <> q.frame_id WHERE q.frame_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, frame_id) AS rank FROM d)
SELECT query_id, rank, frame_id, round(d, 6) + 0.0 AS writhe_distance, query_id % 8 AS part FROM r WHERE rank <= 5""",
}
