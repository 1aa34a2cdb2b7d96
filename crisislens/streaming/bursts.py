"""Structured Streaming: hourly bursts by two chained stateful aggregations.

The first counts posts by event-time hour.  The second takes the closed hours of a
span (a day) together: their number, sum and sum of squares give mean and population
standard deviation, and the hours themselves, as many as fit in a span, are held for
their z-scores.  State is one row an open hour and one row an open span; both are
dropped once the watermark passes them, so a span comes out when it is closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.timeline import burst_label
from .hourly import enrich_stream, raw_post_stream


def hourly_bursts(E_stream: DataFrame, watermark: str = "2 hours", span: str = "1 day") -> DataFrame:
    """(span, hour, messages, retweets, zscore, retweet_pct, burst_level) of every hour of the closed spans.

    ``timeline.bursts`` by span gives the same on a stored corpus.
    """
    timed = E_stream.withColumn("event_time", F.col("dt").cast("timestamp"))
    hours = (timed.withWatermark("event_time", watermark).groupBy(F.window("event_time", "1 hour").alias("w"))
             .agg(F.count(F.lit(1)).alias("messages"), F.count_if("is_retweet").alias("retweets")))
    m = F.col("messages")
    spans = (hours.groupBy(F.window(F.window_time("w"), span).alias("s"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum(m).alias("total"), F.sum(m * m).alias("squares"),
                  F.collect_list(F.struct(F.col("w.start").alias("hour"), "messages", "retweets")).alias("hours")))
    # integers up to the root: n * squares - total^2 is exactly zero for equal hours
    deviation = F.sqrt((F.col("n") * F.col("squares") - F.col("total") * F.col("total")).cast("double")) / F.col("n")
    rows = spans.select(F.col("s.start").cast("timestamp_ntz").alias("span"), (F.col("total") / F.col("n")).alias("mean"), deviation.alias("sd"), F.inline("hours"))
    z = (m - F.col("mean")) / F.when(F.col("sd") == 0, F.lit(1.0)).otherwise(F.col("sd"))
    return (rows.select("span", F.col("hour").cast("timestamp_ntz").alias("hour"), "messages", "retweets", z.alias("zscore"),
                        F.when(m > 0, F.col("retweets") / m * 100.0).otherwise(0.0).alias("retweet_pct"))
            .withColumn("burst_level", burst_label(F.col("zscore"))))


def start_bursts(spark: SparkSession, source: str, schema: T.StructType, mapping: dict[str, str], sink: str, checkpoint: str,
                 watermark: str = "2 hours", span: str = "1 day", max_files: int = 8):
    """Run the bursts of a folder of raw post files into a Parquet sink, over the files that are there."""
    posts = enrich_stream(raw_post_stream(spark, source, schema, max_files), mapping)
    return (hourly_bursts(posts, watermark, span).writeStream.outputMode("append").format("parquet")
            .option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
