"""Queries: KPIs, share tables, top tables, timelines, peaks, bursts."""

from __future__ import annotations

from ..config import NEGATIVE_SENTIMENTS
from ..operators import metrics as M
from ..operators import timeline as TL
from .oracle import q, with_e_ctes
from .registry import corpus, present, register, sln1p, spct, sr6

_NEG = "(" + ", ".join(q(s) for s in NEGATIVE_SENTIMENTS) + ")"

KPIS_SQL = with_e_ctes("", f"""SELECT count(*) AS messages, count(DISTINCT author) AS auteurs_uniques,
 min(dt) AS debut, max(dt) AS fin,
 count_if(is_retweet) AS retweets, {sr6(spct('count_if(is_retweet)', 'count(*)'))} AS retweets_pct,
 count_if(is_original) AS originaux, {sr6(spct('count_if(is_original)', 'count(*)'))} AS originaux_pct,
 count_if(is_reply) AS reponses, count_if(is_quote) AS citations,
 sum(likes) AS likes, sum(comments) AS comments, sum(shares) AS shares, sum(impressions) AS impressions,
 sum(reach) AS reach, sum(engagement_total) AS engagement_total,
 {sr6(spct(f'count_if(sentiment IN {_NEG})', 'count(*)'))} AS sentiment_negatif_pct,
 {sr6('avg(risk_level)')} AS risk_moyen, max(risk_level) AS risk_max
FROM e HAVING count(*) > 0""")

PCT_ROUND = ("retweets_pct", "originaux_pct", "sentiment_negatif_pct", "risk_moyen")


@register("kpis", KPIS_SQL, "A1 KPIs, A17 null-safe sums and percentages")
def kpis(spark, sf_dir):
    return present(M.kpis(corpus(spark, sf_dir)), PCT_ROUND)


def _share_sql(key: str, alias: str) -> str:
    return with_e_ctes("", f"""SELECT {key} AS {alias}, count(*) AS count,
 {sr6(f'CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () * 100')} AS pct FROM e GROUP BY {key}""")


@register("sentiment_table", _share_sql("sentiment", "sentiment"), "A5 sentiment counts and shares")
def sentiment_table(spark, sf_dir):
    return present(M.sentiment_table(corpus(spark, sf_dir)), ("pct",))


@register("engagement_types", _share_sql("engagement_type", "type"), "A6 engagement-type counts and shares")
def engagement_types(spark, sf_dir):
    return present(M.engagement_type_table(corpus(spark, sf_dir)), ("pct",))


@register("narratives_table", with_e_ctes("n AS (SELECT count(*) AS n_posts FROM e)", f"""
SELECT narrative, count(*) AS count,
 {sr6('CAST(count(*) AS DOUBLE) / greatest(1, any_value(n.n_posts)) * 100')} AS pct_messages
FROM (SELECT unnest(narratives) AS narrative FROM e) x CROSS JOIN n GROUP BY narrative"""),
          "A4 narrative counts, % of posts (multi-label)")
def narratives_table(spark, sf_dir):
    return present(M.narratives_table(corpus(spark, sf_dir)), ("pct_messages",))


TOP_AUTHORS_SQL = with_e_ctes(f"""a AS (SELECT author, count(*) AS messages, count_if(is_retweet) AS retweets,
 sum(likes) AS likes, sum(shares) AS shares, sum(reach) AS reach, sum(impressions) AS impressions,
 max(followers) AS followers, avg(risk_level) AS risk_mean FROM e GROUP BY author),
s AS (SELECT *, {sln1p('reach')} * 0.35 + {sln1p('shares')} * 0.25 + {sln1p('likes')} * 0.20
   + {sln1p('messages')} * 0.10 + {sln1p('followers')} * 0.10 AS influence_score FROM a),
k AS (SELECT *, row_number() OVER (ORDER BY influence_score DESC, reach DESC, shares DESC, author) AS rank FROM s)""",
    f"""SELECT rank, author, messages, retweets, likes, shares, reach, impressions, followers,
 {sr6('risk_mean')} AS risk_mean, {sr6('influence_score')} AS influence_score FROM k WHERE rank <= 50""")


@register("top_authors", TOP_AUTHORS_SQL, "A2 author table, X4 influence score, T1 top-50 order")
def top_authors(spark, sf_dir):
    return present(M.top_authors(corpus(spark, sf_dir), n=50), ("risk_mean", "influence_score"))


@register("top_hashtags", with_e_ctes("""h AS (SELECT hashtag, count(*) AS count
 FROM (SELECT unnest(hashtags_list) AS hashtag FROM e) GROUP BY hashtag)""",
    """SELECT * FROM (SELECT row_number() OVER (ORDER BY count DESC, hashtag) AS rank, hashtag, count FROM h)
 WHERE rank <= 50"""), "A3 hashtag counts, T2 top-50")
def top_hashtags(spark, sf_dir):
    return present(M.top_hashtags(corpus(spark, sf_dir), n=50))


@register("top_posts", with_e_ctes("", """SELECT * FROM (SELECT row_number() OVER (
   ORDER BY engagement_total DESC, reach DESC, shares DESC, post_id) AS rank,
 post_id, dt, author, engagement_type, sentiment, likes, comments, shares, reach, risk_level, main_narrative, text_raw
 FROM e) WHERE rank <= 10"""), "T3 top posts by engagement")
def top_posts(spark, sf_dir):
    return present(M.top_posts(corpus(spark, sf_dir), n=10))


def _timeline_sql(bucket: str, rolling: int, roll_name: str, top: int | None) -> str:
    ctes = f"""t AS (SELECT {bucket}, count(*) AS messages, count(DISTINCT author) AS auteurs,
 count_if(is_retweet) AS retweets, sum(reach) AS reach, sum(impressions) AS impressions,
 sum(engagement_total) AS engagement, avg(risk_level) AS risk_mean FROM e GROUP BY {bucket}),
z AS (SELECT *, (messages - avg(messages) OVER ()) / (stddev_pop(messages) OVER () + 1e-9) AS z,
 avg(messages) OVER (ORDER BY {bucket} ROWS BETWEEN {rolling - 1} PRECEDING AND CURRENT ROW) AS roll FROM t),
k AS (SELECT *, row_number() OVER (ORDER BY messages DESC, z DESC, {bucket}) AS rank FROM z)"""
    cols = f"""{bucket}, messages, auteurs, retweets, reach, impressions, engagement, {sr6('risk_mean')} AS risk_mean,
 {sr6(f'CASE WHEN messages > 0 THEN retweets / messages * 100 ELSE 0 END')} AS retweets_pct,
 {sr6('roll')} AS {roll_name}, {sr6('z')} AS zscore"""
    if top is None:
        return with_e_ctes(ctes, f"SELECT {cols} FROM k")
    return with_e_ctes(ctes, f"SELECT rank, {cols} FROM k WHERE rank <= {top}")


TL_ROUND = ("risk_mean", "retweets_pct", "rolling_mean_3d", "rolling_mean_6h", "zscore")


@register("daily_timeline", _timeline_sql("day", 3, "rolling_mean_3d", None), "A7 daily timeline, W1, W3")
def daily_timeline(spark, sf_dir):
    return present(TL.daily_timeline(corpus(spark, sf_dir)), TL_ROUND)


@register("hourly_timeline", _timeline_sql("hour", 6, "rolling_mean_6h", None), "A8 hourly timeline, W2, W3")
def hourly_timeline(spark, sf_dir):
    return present(TL.hourly_timeline(corpus(spark, sf_dir)), TL_ROUND)


@register("daily_peaks", _timeline_sql("day", 3, "rolling_mean_3d", 10), "T4 top-10 daily peaks")
def daily_peaks(spark, sf_dir):
    return present(TL.daily_peaks(corpus(spark, sf_dir), n=10), TL_ROUND)


@register("hourly_peaks", _timeline_sql("hour", 6, "rolling_mean_6h", 20), "T4 top-20 hourly peaks")
def hourly_peaks(spark, sf_dir):
    return present(TL.hourly_peaks(corpus(spark, sf_dir), n=20), TL_ROUND)


@register("bursts", with_e_ctes("""t AS (SELECT hour, count(*) AS messages, count(DISTINCT author) AS authors,
 count_if(is_retweet) AS retweets, sum(reach) AS reach FROM e GROUP BY hour),
z AS (SELECT *, (messages - avg(messages) OVER ()) /
   (CASE WHEN stddev_pop(messages) OVER () = 0 THEN 1 ELSE stddev_pop(messages) OVER () END) AS z FROM t),
k AS (SELECT *, row_number() OVER (ORDER BY z DESC, messages DESC, hour) AS rank FROM z)""",
    f"""SELECT rank, hour, messages, authors, retweets, reach, {sr6('z')} AS zscore,
 {sr6('CASE WHEN messages > 0 THEN retweets / messages * 100 ELSE 0 END')} AS retweet_pct,
 CASE WHEN z >= 3 THEN 'pic majeur' WHEN z >= 2 THEN 'pic notable' ELSE 'normal' END AS burst_level
 FROM k WHERE rank <= 12"""), "A16 hourly bursts, W4, C10, T8 top-12")
def bursts(spark, sf_dir):
    return present(TL.bursts(corpus(spark, sf_dir)), ("zscore", "retweet_pct"))
