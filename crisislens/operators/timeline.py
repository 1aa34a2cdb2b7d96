"""Daily / hourly timelines, peaks and hourly bursts.

Aggregation first (partial + final HashAggregate, one shuffle on the bucket);
the rolling means and z-scores are windows over the *aggregated* buckets,
partitioned by the ``by`` keys, so at most one row per hour reaches them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .common import By, over_group, top_k


def bucket_table(E: DataFrame, bucket: str, by: By = ()) -> DataFrame:
    """The measures of each hour or day, without trends; no ``risk_mean`` for posts that have no risk level yet."""
    authors = F.countDistinct("author")
    return E.groupBy(*by, bucket).agg(
        F.count(F.lit(1)).alias("messages"),
        authors.alias("auteurs"),
        F.count_if("is_retweet").alias("retweets"),
        F.sum("reach").alias("reach"),
        F.sum("impressions").alias("impressions"),
        F.sum("engagement_total").alias("engagement"),
        *([F.avg("risk_level").alias("risk_mean")] if "risk_level" in E.columns else []),
    )


def _timeline(E: DataFrame, bucket: str, rolling: int, roll_name: str, by: By) -> DataFrame:
    return with_trend(bucket_table(E, bucket, by), bucket, rolling, roll_name, by)


def with_trend(tl: DataFrame, bucket: str, rolling: int, roll_name: str, by: By = ()) -> DataFrame:
    """The rolling mean and z-score over rows of :func:`bucket_table`."""
    ordered = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(bucket)
    whole = over_group(by)
    m = F.col("messages")
    return tl.select(
        *by, bucket, "messages", "auteurs", "retweets", "reach", "impressions", "engagement",
        *[c for c in ("risk_mean",) if c in tl.columns],
        F.when(m > 0, F.col("retweets") / m * 100.0).otherwise(0.0).alias("retweets_pct"),
        F.avg(m).over(ordered.rowsBetween(-(rolling - 1), 0)).alias(roll_name),
        ((m - F.avg(m).over(whole)) / (F.stddev_pop(m).over(whole) + C.ZSCORE_EPS)).alias("zscore"),
    )


def daily_timeline(E: DataFrame, by: By = ()) -> DataFrame:
    """Day -> volume, authors, retweets, reach, ... + 3-row rolling mean and z-score.
    Days without posts have no row (the rolling window counts rows)."""
    return _timeline(E, "day", 3, "rolling_mean_3d", by)


def hourly_timeline(E: DataFrame, by: By = ()) -> DataFrame:
    return _timeline(E, "hour", 6, "rolling_mean_6h", by)


def peaks(timeline: DataFrame, bucket: str, n: int | None, by: By = ()) -> DataFrame:
    """Top buckets by messages then z-score (bucket ascending on ties)."""
    return top_k(timeline, [F.desc("messages"), F.desc("zscore"), F.asc(bucket)], n, by)


def daily_peaks(E: DataFrame, n: int | None = 10, by: By = ()) -> DataFrame:
    return peaks(daily_timeline(E, by), "day", n, by)


def hourly_peaks(E: DataFrame, n: int | None = 20, by: By = ()) -> DataFrame:
    return peaks(hourly_timeline(E, by), "hour", n, by)


def bursts(E: DataFrame, n: int | None = C.BURST_TOP, by: By = ()) -> DataFrame:
    """Hourly bursts: z-score with population std (0 -> 1, no epsilon),
    labelled 'pic majeur' (>= 3), 'pic notable' (>= 2) or 'normal'."""
    tl = E.groupBy(*by, "hour").agg(
        F.count(F.lit(1)).alias("messages"),
        F.countDistinct("author").alias("authors"),
        F.count_if("is_retweet").alias("retweets"),
        F.sum("reach").alias("reach"),
    )
    whole = over_group(by)
    m = F.col("messages")
    sd = F.stddev_pop(m).over(whole)
    z = (m - F.avg(m).over(whole)) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
    scored = tl.select(*by, "hour", "messages", "authors", "retweets", "reach", z.alias("zscore"),
                       F.when(m > 0, F.col("retweets") / m * 100.0).otherwise(0.0).alias("retweet_pct"))
    scored = scored.withColumn("burst_level", burst_label(F.col("zscore")))
    return top_k(scored, [F.desc("zscore"), F.desc("messages"), F.asc("hour")], n, by)


# FIXED VALUES — burst labels and thresholds.
BURST_MAJOR, BURST_NOTABLE, BURST_NORMAL = "pic majeur", "pic notable", "normal"


def burst_label(z):
    return F.when(z >= 3, BURST_MAJOR).when(z >= 2, BURST_NOTABLE).otherwise(BURST_NORMAL)
