"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, exact_dedup, html_extract, jaccard_join, language_id, mixing, packing, quality, suffix_dedup, topk_search, warc, yinyang
from .runtime import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th embedding."""
    e = _table(spark, sf_dir, "embeddings")
    return topk_search.exact_top_k(e, e.where("vec_id % 50 = 0"), k=5)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 512 to 4096 words."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 200-byte strings that occur elsewhere."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' target shares."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op9_ann_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the 20 nearest of every 20th embedding."""
    e = _table(spark, sf_dir, "embeddings")
    return ann.nearest(e, e.where("vec_id % 20 = 0"), k=20)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row stays of equal texts, for every document."""
    ship(spark)
    return exact_dedup.exact_duplicates(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four codebook indexes of every embedding, and their errors."""
    return yinyang.compress(_table(spark, sf_dir, "embeddings")).drop("looked")


def packing_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That every document is in the packing once, in sequences that hold what they may."""
    return packing.coverage(packing.pack(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_topk_search, op2_language_id, op3_best_fit_packing, op4_jaccard_join, op5_html_extract, op6_quality_classifier, op7_suffix_dedup, op8_mix_sources, op9_ann_curves, op10_warc, op11_exact_dedup, op12_vector_codes, packing_coverage)
}
ORACLE_SQL: dict[str, str] = {"op1_topk_search": topk_search.SQL, "op4_jaccard_join": jaccard_join.SQL, "op7_suffix_dedup": suffix_dedup.SQL, "op8_mix_sources": mixing.SQL, "op10_warc": warc.SQL, "op11_exact_dedup": exact_dedup.SQL, "op12_vector_codes": yinyang.SQL, "packing_coverage": packing.COVERAGE_SQL}
