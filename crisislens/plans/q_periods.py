"""Queries: peak-day periods, per-period tables and the crisis velocity score."""

from __future__ import annotations

from ..config import NEGATIVE_SENTIMENTS
from ..operators import metrics as M
from ..operators import periods as P
from ..operators import timeline as TL
from .oracle import q, with_e_ctes
from .q_metrics import PCT_ROUND, TL_ROUND
from .registry import corpus, present, register, sln1p, spct, sr6, sround_py

_NEG = "(" + ", ".join(q(s) for s in NEGATIVE_SENTIMENTS) + ")"
BY = ("period_id",)

# DuckDB: top-5 peak days as periods, and the posts of each period.
PERIOD_CTES = """dt1 AS (SELECT day, count(*) AS messages FROM e GROUP BY day),
dz AS (SELECT *, (messages - avg(messages) OVER ()) / (stddev_pop(messages) OVER () + 1e-9) AS z FROM dt1),
pr AS (SELECT 'peak_day_' || CAST(rank AS VARCHAR) AS period_id, day AS "start",
         day + INTERVAL 1 DAY - INTERVAL 1 SECOND AS "end"
       FROM (SELECT *, row_number() OVER (ORDER BY messages DESC, z DESC, day) AS rank FROM dz) WHERE rank <= 5),
ep AS (SELECT pr.period_id, e.* FROM e JOIN pr ON e.dt >= pr."start" AND e.dt <= pr."end")"""


def _periods(spark, sf_dir, with_risk: bool = True):
    """The corpus and the posts of its five busiest days.  Without the risk level, for tables that do not read it, the
    corpus' reach quantile is not worked out."""
    E = corpus(spark, sf_dir, with_risk=with_risk)
    periods = P.peak_day_periods(E, top=5)
    return E, P.assign_periods(E, periods.select("period_id", "start", "end"))


def stored_periods(spark, sf_dir, *names):
    """What reports read many times, stored: the corpus' times and reach, and the posts of its five busiest days
    (with the columns that the named tables read, or all)."""
    from .analysis import period_posts
    from .tables import read_by, store
    E = corpus(spark, sf_dir)
    return store(E.select("dt", "reach"), "corpus-span"), period_posts(E, P.peak_day_periods(E, top=5), read_by(*names) if names else None)


@register("period_engagement_types", with_e_ctes(PERIOD_CTES, f"""SELECT period_id, engagement_type, count(*) AS count,
 {sr6(spct('count(*)', 'sum(count(*)) OVER (PARTITION BY period_id)'))} AS pct FROM ep GROUP BY period_id, engagement_type"""),
          "R1, A6 engagement types by period")
def period_engagement_types(spark, sf_dir):
    from .analysis import analyze_periods
    E = corpus(spark, sf_dir)
    t = analyze_periods(E, P.peak_day_periods(E, top=5))["engagement_types"]
    return present(t.withColumnRenamed("type", "engagement_type").select("period_id", "engagement_type", "count", "pct"), ("pct",))


@register("peak_day_periods", with_e_ctes(PERIOD_CTES, 'SELECT period_id, "start", "end" FROM pr'),
          "F2 peak-day bounds (day .. day+1d-1s) from T4 ranks")
def peak_day_periods(spark, sf_dir):
    return P.peak_day_periods(corpus(spark, sf_dir), top=5).select("period_id", "start", "end")


@register("period_kpis", with_e_ctes(PERIOD_CTES, f"""SELECT period_id, count(*) AS messages,
 count(DISTINCT author) AS auteurs_uniques, min(dt) AS debut, max(dt) AS fin,
 count_if(is_retweet) AS retweets, {sr6(spct('count_if(is_retweet)', 'count(*)'))} AS retweets_pct,
 count_if(is_original) AS originaux, {sr6(spct('count_if(is_original)', 'count(*)'))} AS originaux_pct,
 count_if(is_reply) AS reponses, count_if(is_quote) AS citations,
 sum(likes) AS likes, sum(comments) AS comments, sum(shares) AS shares, sum(impressions) AS impressions,
 sum(reach) AS reach, sum(engagement_total) AS engagement_total,
 {sr6(spct(f'count_if(sentiment IN {_NEG})', 'count(*)'))} AS sentiment_negatif_pct,
 {sr6('avg(risk_level)')} AS risk_moyen, max(risk_level) AS risk_max
FROM ep GROUP BY period_id"""), "F1 inclusive period filter, J3 period join (many periods in one job), A1 by period")
def period_kpis(spark, sf_dir):
    _, Ep = _periods(spark, sf_dir)
    return present(M.kpis(Ep, by=BY), PCT_ROUND)


def _hours_sql(a: str, b: str) -> str:
    return f"greatest(1.0, CAST(epoch_us({b}) - epoch_us({a}) AS DOUBLE) / 1e6 / 3600.0)"


_CV_CTES = PERIOD_CTES + f""",
k AS (SELECT period_id, count(*) AS messages, min(dt) AS debut, max(dt) AS fin, sum(reach) AS reach,
   {spct('count_if(is_retweet)', 'count(*)')} AS rt_pct,
   {spct(f'count_if(sentiment IN {_NEG})', 'count(*)')} AS neg_pct, avg(risk_level) AS risk_moyen
 FROM ep GROUP BY period_id),
ref AS (SELECT min(dt) AS ref_start, max(dt) AS ref_end, count(*) AS ref_messages, sum(reach) AS ref_reach FROM e),
c AS (SELECT k.*, ref.*, {_hours_sql('debut', 'fin')} AS period_hours,
   messages / {_hours_sql('debut', 'fin')} AS vph, ref_messages / {_hours_sql('ref_start', 'ref_end')} AS ref_vph,
   20.0 * ({sln1p('reach')} / ln(1 + (ref_reach + 1))) AS reach_raw FROM k CROSS JOIN ref),
s AS (SELECT *, least(30.0, 10.0 * ln(1 + vph / (ref_vph + 1e-9))) AS volume_c,
   CASE WHEN ref_reach > 0 THEN least(20.0, reach_raw) ELSE 0.0 END AS reach_c,
   least(15.0, neg_pct / 100.0 * 15.0) AS neg_c, least(15.0, rt_pct / 100.0 * 15.0) AS rt_c,
   least(20.0, (risk_moyen / 5.0) * 20.0) AS risk_c FROM c),
f AS (SELECT *, CASE WHEN ref_reach > 0 AND reach_raw < 20.0
     THEN round_even((volume_c + reach_c + neg_c + rt_c + risk_c) * 10.0, 0) / 10.0
     ELSE {sround_py('volume_c + reach_c + neg_c + rt_c + risk_c', 1)} END AS score FROM s)"""


@register("crisis_velocity", with_e_ctes(_CV_CTES, f"""SELECT period_id, messages, debut, fin,
 {sr6('period_hours')} AS period_hours, {sr6('vph')} AS volume_per_hour, {sr6('ref_vph')} AS ref_volume_per_hour,
 {sr6('volume_c')} AS volume_component, {sr6('reach_c')} AS reach_component,
 {sr6('neg_c')} AS negativity_component, {sr6('rt_c')} AS rt_component, {sr6('risk_c')} AS risk_component,
 score AS crisis_velocity_score,
 CASE WHEN score >= 80 THEN 'CRISE FORTE' WHEN score >= 60 THEN 'CRISE ÉLEVÉE' WHEN score >= 40 THEN 'CRISE MODÉRÉE'
      ELSE 'SIGNAL FAIBLE / BRUIT' END AS niveau FROM f"""),
          "A9 crisis velocity per period vs corpus, X1 formula and rounding, C3 crisis level")
def crisis_velocity(spark, sf_dir):
    E, Ep = _periods(spark, sf_dir)
    return present(P.crisis_velocity(Ep, E), (
        "period_hours", "volume_per_hour", "ref_volume_per_hour", "volume_component", "reach_component",
        "negativity_component", "rt_component", "risk_component"))


@register("period_top_authors", with_e_ctes(PERIOD_CTES + f""",
a AS (SELECT period_id, author, count(*) AS messages, count_if(is_retweet) AS retweets, sum(likes) AS likes,
 sum(shares) AS shares, sum(reach) AS reach, sum(impressions) AS impressions, max(followers) AS followers,
 avg(risk_level) AS risk_mean FROM ep GROUP BY period_id, author),
s AS (SELECT *, {sln1p('reach')} * 0.35 + {sln1p('shares')} * 0.25 + {sln1p('likes')} * 0.20
   + {sln1p('messages')} * 0.10 + {sln1p('followers')} * 0.10 AS influence_score FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY period_id
   ORDER BY influence_score DESC, reach DESC, shares DESC, author) AS rank FROM s)""",
    f"""SELECT period_id, rank, author, messages, retweets, likes, shares, reach, impressions, followers,
 {sr6('risk_mean')} AS risk_mean, {sr6('influence_score')} AS influence_score FROM k WHERE rank <= 10"""),
          "R1 top authors per period (row_number per period_id)")
def period_top_authors(spark, sf_dir):
    _, Ep = _periods(spark, sf_dir)
    return present(M.top_authors(Ep, n=10, by=BY), ("risk_mean", "influence_score"))


@register("period_top_posts", with_e_ctes(PERIOD_CTES, """SELECT * FROM (SELECT period_id,
 row_number() OVER (PARTITION BY period_id ORDER BY engagement_total DESC, reach DESC, shares DESC, post_id) AS rank,
 post_id, dt, author, engagement_type, sentiment, likes, comments, shares, reach, risk_level, main_narrative, text_raw
 FROM ep) WHERE rank <= 10"""), "R1 top posts per period")
def period_top_posts(spark, sf_dir):
    _, Ep = _periods(spark, sf_dir)
    return present(M.top_posts(Ep, n=10, by=BY))


@register("period_top_hashtags", with_e_ctes(PERIOD_CTES + """,
h AS (SELECT period_id, hashtag, count(*) AS count FROM (SELECT period_id, unnest(hashtags_list) AS hashtag FROM ep)
 GROUP BY period_id, hashtag)""", """SELECT * FROM (SELECT period_id,
 row_number() OVER (PARTITION BY period_id ORDER BY count DESC, hashtag) AS rank, hashtag, count FROM h)
 WHERE rank <= 10"""), "R1 top hashtags per period")
def period_top_hashtags(spark, sf_dir):
    _, Ep = _periods(spark, sf_dir, with_risk=False)
    return present(M.top_hashtags(Ep, n=10, by=BY))


@register("period_narratives", with_e_ctes(PERIOD_CTES + """,
n AS (SELECT period_id, count(*) AS n_posts FROM ep GROUP BY period_id),
c AS (SELECT period_id, narrative, count(*) AS count FROM (SELECT period_id, unnest(narratives) AS narrative FROM ep)
 GROUP BY period_id, narrative)""", f"""SELECT c.period_id, narrative, count,
 {sr6('CAST(count AS DOUBLE) / greatest(1, n_posts) * 100')} AS pct_messages FROM c JOIN n USING (period_id)"""),
          "R1 narrative table per period")
def period_narratives(spark, sf_dir):
    _, Ep = _periods(spark, sf_dir, with_risk=False)
    return present(M.narratives_table(Ep, by=BY), ("pct_messages",))


@register("period_sentiments", with_e_ctes(PERIOD_CTES, f"""SELECT period_id, sentiment, count(*) AS count,
 {sr6('CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY period_id) * 100')} AS pct
 FROM ep GROUP BY period_id, sentiment"""), "R1 sentiment table per period")
def period_sentiments(spark, sf_dir):
    _, Ep = _periods(spark, sf_dir, with_risk=False)
    return present(M.sentiment_table(Ep, by=BY), ("pct",))


@register("period_hourly_timeline", with_e_ctes(PERIOD_CTES + """,
t AS (SELECT period_id, hour, count(*) AS messages, count(DISTINCT author) AS auteurs, count_if(is_retweet) AS retweets,
 sum(reach) AS reach, sum(impressions) AS impressions, sum(engagement_total) AS engagement, avg(risk_level) AS risk_mean
 FROM ep GROUP BY period_id, hour)""", f"""SELECT period_id, hour, messages, auteurs, retweets, reach, impressions,
 engagement, {sr6('risk_mean')} AS risk_mean,
 {sr6('CASE WHEN messages > 0 THEN retweets / messages * 100 ELSE 0 END')} AS retweets_pct,
 {sr6('avg(messages) OVER (PARTITION BY period_id ORDER BY hour ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)')} AS rolling_mean_6h,
 {sr6('(messages - avg(messages) OVER (PARTITION BY period_id)) / (stddev_pop(messages) OVER (PARTITION BY period_id) + 1e-9)')} AS zscore
 FROM t"""), "R1 hourly timeline per period (windows partitioned by period)")
def period_hourly_timeline(spark, sf_dir):
    _, Ep = _periods(spark, sf_dir)
    return present(TL.hourly_timeline(Ep, by=BY), TL_ROUND)


@register("focus_peak_days", with_e_ctes("""dt1 AS (SELECT day, count(*) AS messages FROM e GROUP BY day),
best AS (SELECT day FROM dt1 ORDER BY messages DESC, day LIMIT 2),
t AS (SELECT hour, count(*) AS messages, count(DISTINCT author) AS auteurs, count_if(is_retweet) AS retweets,
 sum(reach) AS reach, sum(impressions) AS impressions, sum(engagement_total) AS engagement, avg(risk_level) AS risk_mean
 FROM e WHERE day IN (SELECT day FROM best) GROUP BY hour)""", f"""SELECT hour, messages, auteurs, retweets, reach,
 impressions, engagement, {sr6('risk_mean')} AS risk_mean,
 {sr6('CASE WHEN messages > 0 THEN retweets / messages * 100 ELSE 0 END')} AS retweets_pct,
 {sr6('avg(messages) OVER (ORDER BY hour ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)')} AS rolling_mean_6h,
 {sr6('(messages - avg(messages) OVER ()) / (stddev_pop(messages) OVER () + 1e-9)')} AS zscore FROM t"""),
          "J2 semi join on the two busiest days, then A8 on them")
def focus_peak_days(spark, sf_dir):
    E = corpus(spark, sf_dir)
    return present(TL.hourly_timeline(P.focus_days(E, 2)), TL_ROUND)


def shared_tables(spark, sf_dir, *names):
    """The per-period tables of the five busiest days (the named ones, or all), each written once, for reports that read many of them."""
    from .tables import PeriodTables
    E, Ep = stored_periods(spark, sf_dir, *names)
    return PeriodTables(Ep, E, keep=True)
