"""Mixing sources to target weights with DataFrame functions only.

Every row gets a hash-random key; within its source rows are ordered by that key, token counts are summed
along that order, and the order is cut at the source's exact budget, after as many whole epochs as the budget
holds. The prefix sums are distributed: the key's leading digits cut a source into ``slices`` ranges, the
ranges' totals (a small table) are summed first, and rows are only ordered within their range. So a source
with any share of the rows is spread over as many tasks as others. The key is a hash of id, size and text, so rows that
share an id, or have none, are spread as well. Rows that are alike in source and key are one row with a count up to
the end, where parts of at most ``COPIES`` of them are dealt out anew; so copies of one row meet in no task.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, last in
order; rows with equal keys are ordered by id and size; an empty table gives an empty result; a source without words
has target 0. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SLICE_DIGITS = 3
COPIES = 1 << 16

WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """The number of words, with no list of them: what is left when each word becomes one letter."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORDS, "x"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """One row per source (from rows ``source``, ``source_size``) with its ``target``.

    A source's cap is ``most`` times its size. With sources ordered by cap / weight, those before some place
    are capped and the others share the rest by weight; the first place where the level does not exceed the
    next ratio is the answer (water filling in closed form). It runs over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    t = sizes.withColumn("weight", w.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    t = (
        t.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("left"))
        .withColumn("open", F.col("level") <= F.col("cap") / F.col("weight"))
    )
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"]
    return t.withColumn("water", level).select(
        "source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("water"))).alias("target")
    )


def _copies(rows: DataFrame) -> DataFrame:
    """A row for each of the ``n`` that a row stands for, with ``inner`` moved on by its size.

    More than ``COPIES`` of one row go in parts, which are dealt out before they become rows.
    """
    few, many = rows.where(F.col("n") <= COPIES), rows.where(F.col("n") > COPIES)
    part = many.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
    part = part.repartition("key", "part").withColumns({"inner": F.col("inner") + F.col("part") * COPIES * F.col("size"), "n": F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES)}).drop("part")
    every = few.unionByName(part).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    return every.withColumn("inner", F.col("inner") + F.col("copy") * F.col("size")).drop("copy")


def mix_sources(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    slice_digits: int = SLICE_DIGITS,
    carry: list[str] | None = None,
) -> DataFrame:
    """Rows ``doc_id, size, source_size, target, taken`` (and columns named in ``carry``) for every row of ``df``.

    ``taken`` counts the words that the mix takes of a document: its size for each whole epoch, and in the last
    epoch its size if it comes before the cut, or the part of it up to the cut. So each source's taken words
    come to its target rounded down. ``most`` bounds the epochs.
    """
    extra = [c for c in carry or []]
    rows = df.select(
        F.col(id_col).alias("doc_id"), size_of(F.col(text_col)).alias("size"), F.col(source_col).alias("source"), *[F.col(c).alias(f"_x_{c}") for c in extra],
        F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("body"),
    )
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string"), F.lit(":"), F.col("body"))
    rows = rows.withColumn("key", F.md5(name.cast("binary"))).drop("body")
    rows = rows.withColumn("slice", F.substring("key", 1, slice_digits))
    if extra:
        rows = rows.withColumn("n", F.lit(1).cast("long"))
    else:  # a few numbers of each row: written once, so that texts are read and their words counted once
        rows = Scratch(df.sparkSession, "mix").save(rows.groupBy("source", "slice", "key", "doc_id", "size").agg(F.count("*").alias("n")), "sizes")
    ranges = rows.groupBy("source", "slice").agg(F.sum(F.col("size") * F.col("n")).alias("slice_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("start", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    goal = targets(ranges.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, share, most)
    goal = goal.withColumn("budget", F.floor("target").cast("long")).select(F.col("source").alias("s_source"), "source_size", "target", "budget")
    plan = starts.join(goal, starts["source"].eqNullSafe(goal["s_source"])).select(
        F.col("source").alias("p_source"), F.col("slice").alias("p_slice"), "start", "source_size", "target", "budget"
    )
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["p_source"]) & (rows["slice"] == plan["p_slice"]))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("budget") - epochs * F.col("source_size")
    if not extra:
        rows = _copies(rows)
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("inner")))
    return rows.select(
        "doc_id", "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"), *[F.col(f"_x_{c}").alias(c) for c in extra]
    )


SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::VARCHAR || ':' || md5(coalesce(text, ''))) AS key FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
                   (2 * source_size)::DOUBLE AS cap FROM sizes),
walked AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS capped,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight FROM weighed),
level AS (SELECT (total - capped) / rest_weight AS water FROM walked
          WHERE (total - capped) / rest_weight <= cap / weight ORDER BY cap / weight, water LIMIT 1),
goal AS (SELECT source, source_size, CASE WHEN (SELECT water FROM level) IS NULL THEN cap
         ELSE least(cap, weight * (SELECT water FROM level)) END AS target FROM walked),
placed AS (SELECT r.doc_id, r.size, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
    coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM rows r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM placed
"""
