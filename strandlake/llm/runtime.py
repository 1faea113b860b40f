"""Session helpers shared by the training-data operators: scratch tables on shared storage and size-checked joins."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its measured size is at most this many bytes.
BROADCAST_BYTES = 16 << 20

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Arrow batches of whole texts: rows and bytes at most, set where the session has larger ones.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


#: For Python workers: memory that is freed goes back to the system.
WORKER = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20)}


def ship(spark: SparkSession) -> None:
    """Let Python workers that share this file tree import the package, and bound their Arrow batches."""
    for key, most in BATCH.items():
        now = (spark.conf.get(key) or "").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)
    env = spark.sparkContext.environment
    for key, value in WORKER.items():
        env.setdefault(key, value)
    parts = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = ":".join([_ROOT, *parts])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only where the setting is absent and all of Spark runs in one process, as in tests, a temporary folder is made and set.
    """
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_ = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.sparkContext.setCheckpointDir(set_)
        set_ = spark.sparkContext.getCheckpointDir()
    return set_.rstrip("/")


class Scratch:
    """Tables written to shared storage to cut lineage; what is left goes when the session's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        ship(spark)
        path = self._path(self.base)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet below the scratch folder and read it back."""
        df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def bucketed(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """Write ``df`` dealt to buckets by the columns ``by``, once, so that joins on them read it without a shuffle.

        The catalog's entry is only needed to resolve the result and goes at once; the files are the scratch folder's.
        """
        n, table = partitions(self.spark), f"strandlake_{uuid.uuid4().hex}"
        df.repartition(n, *by).write.bucketBy(n, *by).option("path", f"{self.base}/{name}").saveAsTable(table)
        got = self.spark.table(table)
        got.schema  # resolved here  # noqa: B018
        self.spark.sql(f"DROP TABLE {table}")
        return got

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast ``df`` if its counted rows fit the bound; else leave the shuffle join to the planner."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as keep it apart from the names in ``taken``, whatever their case."""
    have, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
