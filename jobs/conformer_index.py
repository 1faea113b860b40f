"""Index an ensemble of curves and list what each sampled frame resembles.

Every frame of ``embeddings`` is checked in one pass; ``checked`` holds all of them, partitioned by status, so frames
that cannot be indexed are kept with a reason and its place. The good ones go to a pivot index (``index``), and every
``every``-th frame is asked for its ``k`` nearest; the answers are written to ``neighbours``, partitioned by a part of
the query's id. A rerun replaces all of it with the same rows.

    python -m jobs.conformer_index --tables /data/tables --output /data/conformers
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import pivots, search
from strandlake.sources import bindings

from .common import log, main, ship

CHECKED = "frame_id long, seg array<double>, kappa array<double>, tau array<double>, writhe array<double>, reason string, place int, status string"


def run(spark: SparkSession, tables: str, output: str, points: int = 21, width: int = 10, k: int = 5, every: int = 50, parts: int = 8) -> DataFrame:
    """query_id, rank, frame_id, writhe_distance, part of every ``every``-th good frame."""
    ship(spark)
    base, seen = output.rstrip("/"), Observation("frames")
    frames = bindings.frames(spark, tables.rstrip("/"), points)
    checked = search.checked_index(frames, width).withColumn("status", F.when(F.col("reason").isNull(), "kept").otherwise("rejected"))
    checked = checked.observe(seen, F.count("*").alias("all"), F.count_if(F.col("status") == "kept").alias("kept"))
    checked.write.mode("overwrite").partitionBy("status").parquet(f"{base}/checked")
    log.info("read %s frames of %s; %s kept, %s rejected in %s/checked", seen.get["all"], tables, seen.get["kept"], seen.get["all"] - seen.get["kept"], base)
    good = spark.read.schema(CHECKED).parquet(f"{base}/checked").where("status = 'kept'").drop("reason", "place", "status")
    index = pivots.build(good, f"{base}/index", written=True)
    asked = good.where(F.col("frame_id") % every == 0).select(F.col("frame_id").alias("query_id"), "writhe")
    found = index.nearest_of(asked, k).withColumn("part", F.pmod("query_id", F.lit(parts)).cast("int"))
    found.write.mode("overwrite").partitionBy("part").parquet(f"{base}/neighbours")
    out = spark.read.schema("query_id long, rank int, frame_id long, writhe_distance double, part int").parquet(f"{base}/neighbours")
    log.info("wrote %s rows to %s/neighbours", out.count(), base)
    return out


if __name__ == "__main__":
    main("conformer_index", run, "conformer_index.json")
