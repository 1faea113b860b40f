"""Exact duplicates by stateful streaming with DataFrame functions only.

Texts are equal when they are the same bytes after every run of white space became one space. A folder holds what the
operator knows; ``take`` adds the files of a table that it has not seen yet, in two streams that end when nothing is new:

* the first reads new files and appends a small row for each document: identifier, content locator (file and row in
  it), digest of the normalised text;
* the second keeps keyed state for each digest in RocksDB, on the executors' disks with a change log in the shared
  folder, without expiry: the smallest identifier with its locator, and the number of rows. Rows of a task are summed
  before they move, so a digest that a third of all rows has sends one row a task.

Digests alone decide nothing. ``result`` fetches the texts of all rows that share a digest by their locators and
compares whole bytes: (digest, text) pairs are made distinct, within each task first, and a digest that is left with
two texts is a collision, whose rows are grouped by their texts instead.

Defined cases: a null text is an empty one; rows of one identifier and text are copies of each other, of which the
first by locator stays; a null identifier stays only where all of its group are null; an empty table gives no rows;
other columns are not read. A file is taken once, whatever is written into it later.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import Scratch, small

SPACES = r"[\x20\x09-\x0D]+"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
ROWS = "doc_id long, file string, place long, digest binary, sha string"
GROUPS = "digest binary, first struct<none: boolean, id: bigint, file: string, place: bigint>, n long"
#: Bytes of a row of the tables whose counted size decides on a broadcast.
GROUP_BYTES, LOCATOR_BYTES = 256, 320


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings, and afterwards as it was."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ExactDedup:
    """Deduplication of one growing Parquet table, kept in ``folder`` (on storage that all executors share)."""

    def __init__(self, spark: SparkSession, folder: str, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] | None = None):
        self.spark, self.folder, self.id_col, self.text_col = spark, folder.rstrip("/"), id_col, text_col
        self.digest = digest or (lambda text: F.unhex(sha256(text)))

    def _located(self, source: DataFrame) -> DataFrame:
        """Identifier, locator and normalised text of each row."""
        at = F.col("_metadata")
        return source.select(F.col(self.id_col).cast("long").alias("doc_id"), at["file_path"].alias("file"), at["row_index"].alias("place"), normalised(F.col(self.text_col)).alias("text"))

    @staticmethod
    def _pattern(path: str) -> str:
        """A glob of just this path: a stream takes a single file only so."""
        path = path.rstrip("/")
        return f"{path[:-1]}[{path[-1]}]"

    def take(self, path: str) -> None:
        """Add the files at ``path`` (a Parquet file or folder) that were not taken yet."""
        spark, pattern = self.spark, self._pattern(path)
        source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)
        rows = self._located(source).select("doc_id", "file", "place", self.digest(F.col("text")).cast("binary").alias("digest"), sha256(F.col("text")).alias("sha"))
        rows.writeStream.format("parquet").option("path", f"{self.folder}/rows").option("checkpointLocation", f"{self.folder}/taken").trigger(availableNow=True).start().awaitTermination()

        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "file", "place")).alias("first")
        with settings(spark, STATE):
            seen = spark.readStream.schema(ROWS).parquet(f"{self.folder}/rows").groupBy("digest").agg(first, F.count("*").alias("n"))

            def changed(groups: DataFrame, batch: int) -> None:
                groups.write.mode("overwrite").parquet(f"{self.folder}/groups/batch={batch}")

            seen.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start().awaitTermination()

    def result(self, path: str) -> DataFrame:
        """``doc_id, keep_id, group_size, kept, text_sha256`` and the locator ``file, place`` of every row taken from ``path``."""
        spark, scratch = self.spark, Scratch(self.spark, "exact")
        rows = spark.read.schema(ROWS).parquet(f"{self.folder}/rows")
        now = spark.read.schema(GROUPS + ", batch long").parquet(f"{self.folder}/groups").groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n"))
        shared = scratch.save(now.where("n > 1").select(F.col("digest").alias("of"), "first", "n"), "shared")
        shared = small(shared, shared.count(), GROUP_BYTES)
        hits = scratch.save(rows.join(shared, F.col("digest") == F.col("of")).select(F.col("file").alias("h_file"), F.col("place").alias("h_place"), "digest"), "hits")
        texts = self._located(spark.read.schema(spark.read.parquet(path).schema).parquet(self._pattern(path)))
        there = (F.col("file") == F.col("h_file")) & (F.col("place") == F.col("h_place"))
        fetched = texts.join(small(hits, hits.count(), LOCATOR_BYTES), there)
        apart = fetched.select("digest", "text").distinct().groupBy("digest").count().where("count > 1")
        apart = scratch.save(apart.select(F.col("digest").alias("c_of")), "collisions")

        def told(d: DataFrame) -> DataFrame:
            lone = F.col("n").isNull()
            keep = lone | ((F.col("first.file") == F.col("file")) & (F.col("first.place") == F.col("place")))
            keep_id = F.when(lone, F.col("doc_id")).otherwise(F.col("first.id"))
            return d.select("doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), keep.alias("kept"), F.col("sha").alias("text_sha256"), "file", "place")

        if not apart.head(1):
            return told(rows.join(shared, F.col("digest") == F.col("of"), "left"))
        apart = small(apart, apart.count(), 64)
        clear = told(rows.join(apart, F.col("digest") == F.col("c_of"), "left_anti").join(shared, F.col("digest") == F.col("of"), "left"))
        mixed = scratch.save(fetched.join(apart, F.col("digest") == F.col("c_of"), "left_semi").select("doc_id", "file", "place", "digest", "text", sha256(F.col("text")).alias("sha")), "mixed")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "file", "place")).alias("first")
        own = mixed.groupBy(F.col("digest").alias("of"), F.col("text").alias("same")).agg(first, F.count("*").alias("n"))
        return clear.unionByName(told(mixed.join(own, (F.col("digest") == F.col("of")) & (F.col("text") == F.col("same")))))


def exact_duplicates(spark: SparkSession, path: str, **options) -> DataFrame:
    """All rows of the Parquet table at ``path``, taken once into a scratch folder."""
    work = ExactDedup(spark, f"{Scratch(spark, 'exact-state').base}/state", **options)
    work.take(path)
    return work.result(path)


def exact_duplicates_of(df: DataFrame, **options) -> DataFrame:
    """As :func:`exact_duplicates`, for any DataFrame, which is written to scratch storage first."""
    scratch = Scratch(df.sparkSession, "exact-input")
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    scratch.save(df.select(F.col(id_col).cast("long").alias(id_col), text_col), "table")
    return exact_duplicates(df.sparkSession, f"{scratch.base}/table", **options)


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY doc_id NULLS LAST)
"""
