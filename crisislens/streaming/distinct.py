"""Structured Streaming: hourly volumes without repeats, and a side table of late posts.

A post that is delivered again within the watermark is counted once
(``dropDuplicatesWithinWatermark`` on its id; the ids of older posts are forgotten,
which bounds the state).  A post that arrives behind the watermark can no longer
change an hour that came out; a second query over the same files, with the same
files a batch, writes such posts to a table of their own.  The watermark of a batch is
the latest event time of the batches before it less the delay, which each batch
leaves as one row beside the table, so a restarted query goes on from there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hourly import enrich_stream, raw_post_stream


def distinct_volumes(E_stream: DataFrame, watermark: str = "2 hours", key: str = "post_id") -> DataFrame:
    """(hour, messages, retweets, reach) of distinct posts, an hour once it is closed."""
    timed = E_stream.withColumn("event_time", F.col("dt").cast("timestamp"))
    return (timed.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark([key])
            .groupBy(F.window("event_time", "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("messages"), F.count_if("is_retweet").alias("retweets"), F.sum("reach").alias("reach"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "messages", "retweets", "reach"))


def late_writer(spark: SparkSession, folder: str, watermark: str):
    """A foreachBatch function that writes the posts of a batch at or behind its watermark to ``folder``/late/batch=N."""
    if not re.fullmatch(r"\d+ (second|minute|hour|day)s?", watermark):
        raise ValueError("the watermark must be a number of seconds, minutes, hours or days")

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        # one row a batch; those of this batch and later ones are left of an attempt that failed
        seen = (session.read.schema("batch bigint, latest timestamp_ntz").option("recursiveFileLookup", "true").parquet(f"{folder}/latest").where(F.col("batch") < number)
                if number else session.createDataFrame([], "batch bigint, latest timestamp_ntz"))
        bound = seen.agg((F.max("latest") - F.expr(f"INTERVAL {watermark}")).alias("bound"))
        late = batch.crossJoin(F.broadcast(bound)).where(F.col("dt") <= F.date_trunc("millisecond", F.col("bound"))).drop("bound")
        late.write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        batch.agg(F.max("dt").cast("timestamp_ntz").alias("latest")).withColumn("batch", F.lit(number).cast("bigint")).select("batch", "latest").coalesce(1) \
            .write.mode("overwrite").parquet(f"{folder}/latest/{number}")

    return write


def read_late(spark: SparkSession, folder: str) -> DataFrame:
    """The late posts, with the number of their batch."""
    return spark.read.parquet(f"{folder}/late")


def start_distinct(spark: SparkSession, source: str, schema: T.StructType, mapping: dict[str, str], sink: str, late: str, checkpoint: str,
                   watermark: str = "2 hours", max_files: int = 8) -> tuple:
    """(query of the volumes, query of the late posts) over the files that are there."""
    def posts() -> DataFrame:
        return enrich_stream(raw_post_stream(spark, source, schema, max_files), mapping)

    volumes = (distinct_volumes(posts(), watermark).writeStream.outputMode("append").format("parquet")
               .option("path", sink).option("checkpointLocation", f"{checkpoint}/volumes").trigger(availableNow=True).start())
    side = (posts().select("post_id", "dt", "author", "text_raw").writeStream.foreachBatch(late_writer(spark, late, watermark))
            .option("checkpointLocation", f"{checkpoint}/late").trigger(availableNow=True).start())
    return volumes, side
