"""Blind scan of a growing corpus for mixed populations: moments and bimodality of text measures by source and language.

Each run takes the files of ``documents`` that no run has taken before (the checkpoint of a file stream is the mark),
sums them to mergeable moment states, one for each source, language and measure, and adds these to ``states``,
partitioned by batch; a batch that is repeated after a failure replaces its own partition. The profile of all batches
is then merged from the states alone, without the texts, and written to ``profile``, partitioned by measure.

    python -m jobs.text_moments --tables /data/tables --output /data/moments --checkpoint /data/moments-mark
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import states

from .common import exactly, log, main, ship

KEYS = ("source", "lang")
WORD, SPACE, STOP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+", r"[.!?]"
STORED = f"source string, lang string, measure string, state {states.STATE}, batch long"


def measures(docs: DataFrame) -> DataFrame:
    """source, lang, measure, value: three rows for each document; a null text has no words, and a mean of none is null."""
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(*KEYS, F.regexp_count(text, F.lit(WORD)).cast("double").alias("words"), F.length(F.regexp_replace(text, SPACE, "")).cast("double").alias("letters"), F.regexp_count(text, F.lit(STOP)).cast("double").alias("stops"))
    of = {"log_words": F.log1p("words"), "word_length": F.when(F.col("words") > 0, F.col("letters") / F.col("words")), "sentence_words": F.col("words") / (F.col("stops") + 1)}
    return sized.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), x.alias("value")) for n, x in of.items()])).alias("m")).select(*KEYS, "m.measure", "m.value")


def run(spark: SparkSession, tables: str, output: str, checkpoint: str, bimodal: float = 5 / 9, files: int = 1000) -> DataFrame:
    """Take new documents below ``tables``, at most ``files`` files in a micro-batch, and give the profile of all so far: source, lang, measure, n, mean, variance, skewness, kurtosis, bc, bimodal."""
    ship(spark)
    path, kept, profile = f"{tables.rstrip('/')}/documents.parquet", f"{output.rstrip('/')}/states", f"{output.rstrip('/')}/profile"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(exactly(path)).select("text", *KEYS)
    spark.createDataFrame([], STORED).write.mode("append").partitionBy("batch").parquet(kept)

    def add(docs: DataFrame, batch: int) -> None:
        got = measures(docs).groupBy(*KEYS, "measure").agg(states.state("value").alias("state")).withColumn("batch", F.lit(batch).cast("long"))
        got.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(kept)
        log.info("batch %s written to %s", batch, kept)

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %s new rows of %s", sum(p["numInputRows"] for p in query.recentProgress), path)
    whole = spark.read.schema(STORED).parquet(kept).groupBy(*KEYS, "measure").agg(states.merge("state").alias("state"))
    told = whole.select(*KEYS, "measure", *[c.alias(n) for n, c in states.summary("state").items()])
    told.withColumn("bimodal", F.col("bc") > bimodal).write.mode("overwrite").partitionBy("measure").parquet(profile)
    out = spark.read.schema(f"source string, lang string, n long, {', '.join(f'{x} double' for x in ('mean', 'variance', 'skewness', 'kurtosis', 'bc'))}, bimodal boolean, measure string").parquet(profile)
    log.info("wrote %s rows to %s", out.count(), profile)
    return out


if __name__ == "__main__":
    main("text_moments", run, "text_moments.json")
