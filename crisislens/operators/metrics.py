"""Corpus or period KPIs and top tables (grouped by optional ``by`` keys)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ln1p_pos, pct
from .common import By, explode_list, neg_flag, over_group, top_k


def kpis(E: DataFrame, by: By = (), approx_distinct: bool = False) -> DataFrame:
    """19 measures per group; groups without posts yield no row."""
    n = F.count(F.lit(1))
    authors = F.approx_count_distinct("author") if approx_distinct else F.countDistinct("author")
    agg = E.groupBy(*by).agg(
        n.alias("messages"),
        authors.alias("auteurs_uniques"),
        F.min("dt").alias("debut"),
        F.max("dt").alias("fin"),
        F.count_if("is_retweet").alias("retweets"),
        F.count_if("is_original").alias("originaux"),
        F.count_if("is_reply").alias("reponses"),
        F.count_if("is_quote").alias("citations"),
        *[F.sum(c).alias(c) for c in ("likes", "comments", "shares", "impressions", "reach", "engagement_total")],
        F.count_if(neg_flag()).alias("_neg"),
        F.avg("risk_level").alias("risk_moyen"),
        F.max("risk_level").alias("risk_max"),
    ).where(F.col("messages") > 0)
    return kpi_columns(agg, by)


def kpi_columns(agg: DataFrame, by: By) -> DataFrame:
    """The 19 measures from counts, sums, ``_neg`` and ``risk_moyen`` of each group."""
    return agg.select(
        *by, "messages", "auteurs_uniques", "debut", "fin",
        "retweets", pct(F.col("retweets"), F.col("messages")).alias("retweets_pct"),
        "originaux", pct(F.col("originaux"), F.col("messages")).alias("originaux_pct"),
        "reponses", "citations", "likes", "comments", "shares", "impressions", "reach", "engagement_total",
        pct(F.col("_neg"), F.col("messages")).alias("sentiment_negatif_pct"),
        "risk_moyen", "risk_max",
    )


def author_table(E: DataFrame, by: By = ()) -> DataFrame:
    """Per-author totals with the influence score (no ordering)."""
    t = E.groupBy(*by, "author").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if("is_retweet").alias("retweets"),
        F.sum("likes").alias("likes"),
        F.sum("shares").alias("shares"),
        F.sum("reach").alias("reach"),
        F.sum("impressions").alias("impressions"),
        F.max("followers").alias("followers"),
        F.avg("risk_level").alias("risk_mean"),
    )
    return with_influence(t)


def with_influence(authors: DataFrame) -> DataFrame:
    """Author totals with the influence score."""
    score = (ln1p_pos(F.col("reach")) * 0.35 + ln1p_pos(F.col("shares")) * 0.25 + ln1p_pos(F.col("likes")) * 0.20
             + ln1p_pos(F.col("messages")) * 0.10 + ln1p_pos(F.col("followers")) * 0.10)
    return authors.withColumn("influence_score", score)


def top_authors(E: DataFrame, n: int | None = 10, by: By = ()) -> DataFrame:
    order = [F.desc("influence_score"), F.desc("reach"), F.desc("shares"), F.asc("author")]
    return top_k(author_table(E, by), order, n, by)


def top_hashtags(E: DataFrame, n: int | None = 15, by: By = ()) -> DataFrame:
    """Hashtag -> number of posts carrying it (lists are already distinct)."""
    tags = explode_list(E, "hashtags_list", "hashtag", by).where(F.col("hashtag").isNotNull())
    counts = tags.groupBy(*by, "hashtag").agg(F.count(F.lit(1)).alias("count"))
    return top_k(counts, [F.desc("count"), F.asc("hashtag")], n, by)


TOP_POST_COLUMNS = ("post_id", "dt", "author", "engagement_type", "sentiment", "likes", "comments", "shares",
                    "reach", "risk_level", "main_narrative", "text_raw")


def top_posts(E: DataFrame, n: int | None = 10, by: By = ()) -> DataFrame:
    cols = [c for c in TOP_POST_COLUMNS if c in E.columns]
    slim = E.select(*by, *cols, "engagement_total")
    order = [F.desc("engagement_total"), F.desc("reach"), F.desc("shares"), F.asc("post_id")]
    return top_k(slim, order, n, by).drop("engagement_total")


def narratives_table(E: DataFrame, by: By = ()) -> DataFrame:
    """Narrative -> posts tagged with it, % of *posts* (sums above 100).

    Posts are counted by their whole list first, so the texts behind the lists are
    passed once: a group's posts are the sum over its lists, a narrative's over those
    that hold it.  Rows of a null group are left out."""
    lists = E.groupBy(*by, "narratives").agg(F.count(F.lit(1)).alias("posts"))
    for key in by:
        lists = lists.where(F.col(key).isNotNull())
    lists = lists.withColumn("n_posts", F.sum("posts").over(over_group(by)))
    out = (explode_list(lists, "narratives", "narrative", (*by, "posts", "n_posts"))
           .groupBy(*by, "narrative").agg(F.sum("posts").alias("count"), F.max("n_posts").alias("n_posts")))
    return out.select(*by, "narrative", "count",
                      (F.col("count") / F.greatest(F.lit(1), F.col("n_posts")) * 100.0).alias("pct_messages"))


def _share_table(E: DataFrame, key: str, alias: str, by: By) -> DataFrame:
    counts = E.groupBy(*by, F.col(key).alias(alias)).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(over_group(by))
    return counts.select(*by, alias, "count", (F.col("count") / total * 100.0).alias("pct"))


def sentiment_table(E: DataFrame, by: By = ()) -> DataFrame:
    return _share_table(E, "sentiment", "sentiment", by)


def engagement_type_table(E: DataFrame, by: By = ()) -> DataFrame:
    return _share_table(E, "engagement_type", "type", by)
