"""Points laid out by frame once, so that plans by frame need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def write_by_frame(points: DataFrame, path: str, buckets: int) -> DataFrame:
    """Write ``points`` to the folder ``path`` in buckets of whole frames, each sorted by frame and place, and open them."""
    name = f"strandlake_{uuid.uuid4().hex}"
    points.repartition(buckets, "frame_id").write.mode("overwrite").bucketBy(buckets, "frame_id").sortBy("frame_id", "res").option("path", path).saveAsTable(name)
    points.sparkSession.sql(f"DROP TABLE {name}")  # the session's entry goes, the files stay
    return open_by_frame(points.sparkSession, path, buckets, points.schema.simpleString()[7:-1].replace(":", " "))


def open_by_frame(spark: SparkSession, path: str, buckets: int, columns: str) -> DataFrame:
    """The points of such a folder, in this or a later session; ``columns`` are their names and types."""
    name = f"strandlake_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (frame_id) SORTED BY (frame_id, res) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    got = spark.table(name)
    got.schema  # resolved here, before the entry goes  # noqa: B018
    spark.sql(f"DROP TABLE {name}")
    return got
