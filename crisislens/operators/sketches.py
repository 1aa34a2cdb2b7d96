"""Mergeable sketches: distinct authors and reach quantiles that roll up without the posts.

A sketch of each hour (authors) or date (reach) is written once.  Any coarser
period is a merge of sketches; a late hour adds one sketch and changes no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import By

AUTHOR_BITS = 14                 # 2^14 slots a sketch: a standard error of 0.8 %
REACH_K = 800                    # a rank error of about 0.4 %


def author_sketches(E: DataFrame, bucket: str = "hour", by: By = ()) -> DataFrame:
    """(by, bucket, messages, sketch): the authors of each bucket as a HyperLogLog sketch."""
    return E.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("messages"), F.hll_sketch_agg("author", F.lit(AUTHOR_BITS)).alias("sketch"))


def author_estimates(sketches: DataFrame, by: By = ()) -> DataFrame:
    """(by, messages, authors_estimate) from the sketches of any buckets."""
    merged = sketches.groupBy(*by).agg(F.sum("messages").alias("messages"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*by, "messages", F.hll_sketch_estimate("sketch").alias("authors_estimate"))


def reach_sketches(E: DataFrame, bucket: str = "date", by: By = ()) -> DataFrame:
    """(by, bucket, sketch): the reach of each bucket's posts as a KLL sketch."""
    value = F.col("reach").cast("double")
    return E.where(value.isNotNull() & ~F.isnan(value)).groupBy(*by, bucket).agg(F.kll_sketch_agg_double(value, F.lit(REACH_K)).alias("sketch"))


def merge_reach(sketches: DataFrame, by: By = ()) -> DataFrame:
    """(by, sketch): the merge of the sketches of any buckets."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(REACH_K)).alias("sketch"))


def quantile_of(sketch: Column, q: Column) -> Column:
    """The value at rank ``q`` (0 to 1) of a merged sketch."""
    return F.kll_sketch_get_quantile_double(sketch, q)
