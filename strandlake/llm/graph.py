"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Rows (``node``, ``component``: the smallest node reachable) for every node that has a link.

    ``links`` has columns ``a`` and ``b``; order, repeats and self links don't matter. Alternates the
    large-star and small-star steps until no edge changes, so the rounds grow with the logarithm of a
    component's size, and a hub's links are reduced by partial minima before they are shuffled. Every round's
    edges go to a table on shared storage; nothing but counts reaches the driver.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.save(edges, f"{name}-0")
    step, before = 0, None
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = low.select("u", F.col("m").alias("v")).unionAll(small).where("u <> v").distinct()
        step += 1
        edges = scratch.save(edges, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select("v", "v").distinct().toDF("node", "component")
    )
