"""The corpus pipeline: quality filter, near duplicates, repeated passages, mixing, packing.

Each stage takes all that its predecessor kept, written as Parquet on shared storage and read again. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import jaccard_join, mixing, packing, quality, suffix_dedup
from strandlake.llm.runtime import Scratch, fresh, small


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component one document: the one with the smallest id, then the smallest hash of its text.

    A document is an id with a text. So of texts that share an id only those go that are near copies of a kept one, ids
    may be null (such documents come last in the choice), and of a document that is repeated one row is kept.
    """
    scratch = Scratch(spark, "pipeline-dups")
    own, id_, row, lone = fresh(docs.columns, "key", "id", "row", "again")
    keyed = docs.withColumn(own, F.xxhash64("text"))
    found = jaccard_join.near_duplicates(keyed.select("doc_id", "text", own), key_col=own)
    found = scratch.save(found.groupBy("doc_id", "row_key", "component").agg(F.count("*").alias("rows")), "found")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_key").alias("key"))
    best = found.where("component IS NOT NULL").groupBy(F.col("component").alias("_of")).agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1")
    best = scratch.save(best.select("_of", "best"), "best")
    lost = found.join(small(best, best.count(), 48), F.col("component") == F.col("_of")).where(~order.eqNullSafe(F.col("best")))
    lost = scratch.save(lost.select(F.col("doc_id").alias(id_), F.col("row_key").alias(row)), "lost")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(row))
    kept = keyed.join(small(lost, lost.count(), 32), same, "left_anti")
    again = scratch.save(found.where("rows > 1").select(F.col("doc_id").alias(id_), F.col("row_key").alias(row), F.lit(True).alias(lone)), "again")
    if not again.head(1):
        return kept.drop(own)
    marked = kept.join(small(again, again.count(), 32), same, "left")
    twice = marked.where(F.col(lone).isNotNull()).dropDuplicates(["doc_id", own]).drop(own, id_, row, lone)
    return marked.where(F.col(lone).isNull()).drop(own, id_, row, lone).unionAll(twice)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that occur elsewhere; ``n_chars`` follows the text."""
    names = fresh(docs.columns, "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    cut = suffix_dedup.remove_repeats(docs, decode=True, names=tuple(names))
    text = F.when(F.col("text").isNotNull(), F.col(names[0]))
    new = {"text": text, "n_chars": F.when(F.col(names[2]) > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))}
    return cut.withColumns({c: x.cast(docs.schema[c].dataType) for c, x in new.items() if c in docs.columns}).drop(*names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one at a source's cut is taken whole."""
    whole = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row")
    mixed = mixing.mix_sources(docs.select("doc_id", "text", "source", whole), carry=["row"]).where("taken > 0")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", filter_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", drop_repeats),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: Learned scores, verified sketches and heuristic packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to shared storage and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        scratch.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
