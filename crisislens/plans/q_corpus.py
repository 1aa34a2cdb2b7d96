"""Queries over the enriched corpus itself (mapping and enrichment)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators.enrich import enrich, narrative_flag_name
from ..sources.fixtures import messy_posts
from .oracle import WORD, q, with_e_ctes
from .registry import corpus, joined, register

FLAGS = [narrative_flag_name(n.label) for n in C.DEFAULT_LEXICON]


@register("enrich_time", with_e_ctes("", "SELECT post_id, dt, date, day, hour, hour_of_day, week FROM e"),
          "P1-P4 date parse, drop bad dates, buckets, week label")
def enrich_time(spark, sf_dir):
    return corpus(spark, sf_dir, with_risk=False).select("post_id", "dt", "date", "day", "hour", "hour_of_day", "week")


@register("enrich_text", with_e_ctes("", "SELECT post_id, text_raw, text_norm, author, sentiment, engagement_type FROM e"),
          "P5-P7, P10, P13, C1 text, accent folding, author, type, sentiment")
def enrich_text(spark, sf_dir):
    return corpus(spark, sf_dir, with_risk=False).select("post_id", "text_raw", "text_norm", "author", "sentiment", "engagement_type")


@register("enrich_flags", with_e_ctes("", """SELECT post_id, likes, comments, shares, impressions, reach, followers,
 following, x_posts, engagement_total, is_retweet, is_reply, is_quote, is_original FROM e"""),
          "P8, P9, P11, P12 metrics and engagement flags")
def enrich_flags(spark, sf_dir):
    return corpus(spark, sf_dir, with_risk=False).select(
        "post_id", *C.METRIC_COLUMNS, "engagement_total", "is_retweet", "is_reply", "is_quote", "is_original")


@register("enrich_entities", with_e_ctes("", """SELECT post_id, array_to_string(hashtags_list, '|') AS hashtags,
 hashtags_joined, array_to_string(mentions_list, '|') AS mentions, CAST(len(hashtags_list) AS BIGINT) AS n_hashtags,
 CAST(len(mentions_list) AS BIGINT) AS n_mentions FROM e"""),
          "P14-P16 hashtags and mentions")
def enrich_entities(spark, sf_dir):
    E = corpus(spark, sf_dir, with_risk=False)
    return E.select("post_id", joined("hashtags_list").alias("hashtags"), "hashtags_joined",
                    joined("mentions_list").alias("mentions"),
                    F.size("hashtags_list").cast("bigint").alias("n_hashtags"),
                    F.size("mentions_list").cast("bigint").alias("n_mentions"))


@register("enrich_narratives", with_e_ctes("", f"""SELECT post_id, {', '.join(FLAGS)},
 array_to_string(narratives, '|') AS narratives, main_narrative FROM e"""),
          "P17-P19 narrative flags, labels, main narrative")
def enrich_narratives(spark, sf_dir):
    E = corpus(spark, sf_dir, with_risk=False)
    return E.select("post_id", *FLAGS, joined("narratives").alias("narratives"), "main_narrative")


@register("enrich_risk", with_e_ctes("", "SELECT post_id, reach, sentiment, is_retweet, risk_level FROM e"),
          "P20-P21 corpus reach p95 and risk level")
def enrich_risk(spark, sf_dir):
    return corpus(spark, sf_dir).select("post_id", "reach", "sentiment", "is_retweet", "risk_level")


_MENTION = q("@" + WORD + "+")


@register("ingest_map_columns", with_e_ctes("", f"""SELECT e.post_id, e.author, e.text_raw, e.likes, e.comments, e.shares,
 e.reach, e.impressions, e.followers, e.engagement_type, e.is_retweet, e.sentiment, e.dt,
 array_to_string(list_sort(list_distinct(list_concat(
   coalesce(regexp_extract_all(lower(raw.author_src), {_MENTION}), []),
   regexp_extract_all(lower(e.text_raw), {_MENTION})))), '|') AS mentions
FROM e JOIN raw ON raw.post_id = e.post_id"""),
          "S3-S6 header normalisation, greedy auto mapping (mentions fall on Author), coercion of string metrics")
def ingest_map_columns(spark, sf_dir):
    E = enrich(messy_posts(spark, sf_dir))           # auto mapping from spreadsheet headers
    return E.select("post_id", "author", "text_raw", "likes", "comments", "shares", "reach", "impressions",
                    "followers", "engagement_type", "is_retweet", "sentiment", "dt",
                    joined("mentions_list").alias("mentions"))
