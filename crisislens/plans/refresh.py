"""Incremental refresh: new files of raw posts are enriched and only the dates they touch are written again.

A store is a folder on shared storage:

* ``corpus``: the enriched posts without the risk level, by date, with the batch
  that brought them;
* ``hours`` and ``days``: the timeline measures, by date, without trends;
* ``files``: the files taken in, with their batch.  It is written last, so a batch
  counts from then on; rows of a batch that failed before are left out and replaced
  when its files, which still count as new, are taken in again;
* ``state``: the reach quantile that the risk levels of ``hours`` and ``days`` stand on.

Touched dates are replaced as wholes (dynamic partition overwrite), other dates keep
their files.  The risk level depends on the quantile over all posts: if that moved,
the measures of all dates are made anew from the stored flags, without reading text.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.enrich import enrich, exact_quantile, narrative_flag_name, with_risk_level
from ..operators.timeline import bucket_table, with_trend
from ..config import DEFAULT_LEXICON, REACH_QUANTILE
from ..session import cluster_for_write
from .tables import store


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _replace(df: DataFrame, path: str) -> None:
    """Write the dates of ``df`` as wholes; other dates stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def new_files(spark: SparkSession, source: str, root: str, glob: str = "*.parquet") -> list[str]:
    """The files under ``source`` that the store has not taken in: names only, no contents are read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(source).select("path")
    taken = _read(spark, f"{root}/files")
    fresh = listed if taken is None else listed.join(taken.select("path"), "path", "left_anti")
    return sorted(r["path"] for r in fresh.collect())


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """The posts of the batches that count."""
    done = spark.read.parquet(f"{root}/files").select("batch").distinct()
    return spark.read.parquet(f"{root}/corpus").join(F.broadcast(done), "batch", "left_semi").drop("batch")       # one row a refresh


def refresh(spark: SparkSession, source: str, root: str, mapping: dict[str, str] | None = None) -> dict:
    """Take in the new files under ``source``: {files, dates, quantile_moved}."""
    names = new_files(spark, source, root)
    if not names:
        return {"files": 0, "dates": 0, "quantile_moved": False}
    batch = hashlib.sha256("\n".join(names).encode()).hexdigest()[:16]
    new = store(enrich(spark.read.parquet(*names), mapping, with_risk=False).withColumn("batch", F.lit(batch)), "refresh-new")
    touched = [r["date"] for r in new.select("date").distinct().collect()]

    taken = _read(spark, f"{root}/files")
    before = _read(spark, f"{root}/corpus")
    if before is not None and taken is not None:
        done = F.broadcast(taken.select("batch").distinct())                 # one row a refresh
        kept = before.where(F.col("date").isin(touched)).join(done, "batch", "left_semi").where(F.col("batch") != batch)
        new = store(kept.select(*new.columns).unionByName(new), "refresh-dates")
    _replace(cluster_for_write(new, "date", "post_id"), f"{root}/corpus")

    corpus = spark.read.parquet(f"{root}/corpus")
    good = [batch] if taken is None else [batch, *[r["batch"] for r in taken.select("batch").distinct().collect()]]
    corpus = corpus.where(F.col("batch").isin(good))
    p95 = exact_quantile(corpus, "reach", REACH_QUANTILE)
    state = _read(spark, f"{root}/state")
    last = None if state is None else state.first()["reach_p95"]
    moved = state is None or last != p95
    flags = [narrative_flag_name(n.label) for n in DEFAULT_LEXICON]
    narrow = corpus.select("date", "day", "hour", "author", "is_retweet", "reach", "impressions", "engagement_total", "sentiment", *flags)
    if not moved:
        narrow = narrow.where(F.col("date").isin(touched))
    rated = with_risk_level(narrow, p95=spark.createDataFrame([(p95,)], "reach_p95 double"))
    for bucket, folder in (("hour", "hours"), ("day", "days")):
        _replace(bucket_table(rated, bucket, ("date",)), f"{root}/{folder}")
    spark.createDataFrame([(p95,)], "reach_p95 double").coalesce(1).write.mode("overwrite").parquet(f"{root}/state")
    spark.createDataFrame([(n, batch) for n in names], "path string, batch string").coalesce(1).write.mode("append").parquet(f"{root}/files")
    return {"files": len(names), "dates": len(touched), "quantile_moved": moved}


def daily(spark: SparkSession, root: str) -> DataFrame:
    """The daily timeline of a store, as ``timeline.daily_timeline`` has it."""
    return with_trend(spark.read.parquet(f"{root}/days").drop("date"), "day", 3, "rolling_mean_3d")


def hourly(spark: SparkSession, root: str) -> DataFrame:
    """The hourly timeline of a store, as ``timeline.hourly_timeline`` has it."""
    return with_trend(spark.read.parquet(f"{root}/hours").drop("date"), "hour", 6, "rolling_mean_6h")
