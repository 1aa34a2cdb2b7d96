"""Queries: hundreds of overlapping periods from elementary segments, and roll-ups of stored sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import segments as SG
from ..operators import sketches as SK
from ..operators.enrich import exact_quantile
from .oracle import with_e_ctes
from .q_metrics import PCT_ROUND
from .q_periods import _CV_CTES, _NEG, PERIOD_CTES
from .registry import corpus, present, register, sln1p, spct, sr6
from .tables import store

WINDOWS = 300

# DuckDB: 300 windows of 8 to 72 hours, one every two hours, some of them open; and the posts of each
WINDOW_CTES = f"""wp AS (SELECT 'w_' || lpad(CAST(i AS VARCHAR), 3, '0') AS period_id,
   CASE WHEN i % 100 <> 98 THEN d0 + to_minutes(120 * i + i % 11) END AS "start",
   CASE WHEN i % 100 <> 99 THEN d0 + to_minutes(120 * i + i % 11 + (i % 9 + 1) * 480) - INTERVAL 1 SECOND END AS "end"
 FROM (SELECT min(day) AS d0 FROM e), (SELECT CAST(range AS INTEGER) AS i FROM range({WINDOWS}))),
ep AS (SELECT wp.period_id, e.* EXCLUDE (text_raw, text_norm) FROM e JOIN wp ON e.dt >= coalesce(wp."start", e.dt) AND e.dt <= coalesce(wp."end", e.dt))"""


def windows(E: DataFrame) -> DataFrame:
    """The overlapping periods of the queries, from the first day of the posts on."""
    x = E.agg(F.min("day").alias("d0")).select("d0", F.explode(F.sequence(F.lit(0), F.lit(WINDOWS - 1))).alias("i"))
    minutes = F.col("i") * 120 + F.col("i") % 11
    start = F.col("d0") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    end = F.col("d0") + F.make_dt_interval(F.lit(0), F.lit(0), minutes + (F.col("i") % 9 + 1) * 480) - F.expr("INTERVAL 1 SECOND")
    return x.select(F.concat(F.lit("w_"), F.lpad(F.col("i").cast("string"), 3, "0")).alias("period_id"),
                    F.when(F.col("i") % 100 != 98, start).alias("start"), F.when(F.col("i") % 100 != 99, end).alias("end"))


def _segments(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    E = corpus(spark, sf_dir)
    cuts = SG.Cuts(store(windows(E), "windows"))
    return store(SG.segment_table(E, cuts), "segments"), cuts.covered(), E


@register("period_segments_kpis", with_e_ctes(_CV_CTES.replace(PERIOD_CTES, WINDOW_CTES), f"""SELECT f.period_id, a.messages, auteurs_uniques, a.debut, a.fin,
 retweets, retweets_pct, originaux, originaux_pct, reponses, citations, likes, comments, shares, impressions, a.reach, engagement_total,
 sentiment_negatif_pct, a.risk_moyen, risk_max, f.score AS crisis_velocity_score,
 CASE WHEN f.score >= 80 THEN 'CRISE FORTE' WHEN f.score >= 60 THEN 'CRISE ÉLEVÉE' WHEN f.score >= 40 THEN 'CRISE MODÉRÉE' ELSE 'SIGNAL FAIBLE / BRUIT' END AS niveau
FROM f JOIN (SELECT period_id, count(*) AS messages, count(DISTINCT author) AS auteurs_uniques, min(dt) AS debut, max(dt) AS fin,
 count_if(is_retweet) AS retweets, {sr6(spct('count_if(is_retweet)', 'count(*)'))} AS retweets_pct,
 count_if(is_original) AS originaux, {sr6(spct('count_if(is_original)', 'count(*)'))} AS originaux_pct,
 count_if(is_reply) AS reponses, count_if(is_quote) AS citations,
 sum(likes) AS likes, sum(comments) AS comments, sum(shares) AS shares, sum(impressions) AS impressions,
 sum(reach) AS reach, sum(engagement_total) AS engagement_total,
 {sr6(spct(f'count_if(sentiment IN {_NEG})', 'count(*)'))} AS sentiment_negatif_pct,
 {sr6('avg(risk_level)')} AS risk_moyen, max(risk_level) AS risk_max FROM ep GROUP BY period_id) a USING (period_id)"""),
          "J3, A1, A9 KPIs and velocity of 300 overlapping periods from elementary segments")
def period_segments_kpis(spark, sf_dir):
    table, covered, E = _segments(spark, sf_dir)
    k = store(SG.segment_kpis(table, covered), "segment-kpis")
    score = SG.velocity(k, SG.corpus_span(E)).select("period_id", "crisis_velocity_score", "niveau")
    return present(k, PCT_ROUND).join(score, "period_id")


@register("period_segments_authors", with_e_ctes(WINDOW_CTES + f""",
a AS (SELECT period_id, author, count(*) AS messages, count_if(is_retweet) AS retweets, sum(likes) AS likes,
 sum(shares) AS shares, sum(reach) AS reach, sum(impressions) AS impressions, max(followers) AS followers,
 avg(risk_level) AS risk_mean FROM ep GROUP BY period_id, author),
s AS (SELECT *, {sln1p('reach')} * 0.35 + {sln1p('shares')} * 0.25 + {sln1p('likes')} * 0.20
   + {sln1p('messages')} * 0.10 + {sln1p('followers')} * 0.10 AS influence_score FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY period_id
   ORDER BY influence_score DESC, reach DESC, shares DESC, author) AS rank FROM s)""",
    f"""SELECT period_id, rank, author, messages, retweets, likes, shares, reach, impressions, followers,
 {sr6('risk_mean')} AS risk_mean, {sr6('influence_score')} AS influence_score FROM k WHERE rank <= 5"""),
          "J3, A2, T1 top authors of 300 overlapping periods from elementary segments")
def period_segments_authors(spark, sf_dir):
    table, covered, _ = _segments(spark, sf_dir)
    return present(SG.segment_authors(table, covered, 5), ("risk_mean", "influence_score"))


@register("period_segments_narratives", with_e_ctes(WINDOW_CTES + """,
n AS (SELECT period_id, count(*) AS n_posts FROM ep GROUP BY period_id),
c AS (SELECT period_id, narrative, count(*) AS count FROM (SELECT period_id, unnest(narratives) AS narrative FROM ep) GROUP BY period_id, narrative)""",
    f"""SELECT c.period_id, narrative, count, {sr6('CAST(count AS DOUBLE) / greatest(1, n_posts) * 100')} AS pct_messages FROM c JOIN n USING (period_id)"""),
          "J3, A4 narratives of 300 overlapping periods from elementary segments")
def period_segments_narratives(spark, sf_dir):
    table, covered, _ = _segments(spark, sf_dir)
    return present(SG.segment_narratives(table, covered), ("pct_messages",))


@register("author_rollup", with_e_ctes("", """SELECT date_trunc('week', day) AS week, count(*) AS messages, count(DISTINCT author) AS authors, true AS within_3_pct
 FROM e GROUP BY date_trunc('week', day)"""), "distinct authors of any period from stored hourly sketches, against the exact count")
def author_rollup(spark, sf_dir):
    E = corpus(spark, sf_dir, with_risk=False).select("hour", "day", "author")
    hours = store(SK.author_sketches(E), "author-sketches")
    week = lambda c: F.date_sub(F.to_date(c), (F.dayofweek(c) + 5) % 7).cast("timestamp_ntz")
    estimate = SK.author_estimates(hours.withColumn("week", week(F.col("hour"))), ("week",))         # reads the sketches alone
    exact = E.groupBy(week(F.col("day")).alias("week")).agg(F.countDistinct("author").alias("authors"))
    return estimate.join(exact, "week").select("week", "messages", "authors", (F.abs(F.col("authors_estimate") - F.col("authors")) <= 0.03 * F.col("authors")).alias("within_3_pct"))


QUANTILES = (0.25, 0.5, 0.9, 0.95, 0.99)


@register("reach_rollup", with_e_ctes("", "SELECT q, quantile AS reach, true AS within_1_pct FROM (" + " UNION ALL ".join(
    f"SELECT CAST({x} AS DOUBLE) AS q, {sr6(f'quantile_cont(reach, {x})')} AS quantile FROM e" for x in QUANTILES) + ")"),
          "P20 reach quantiles from stored daily sketches: rank error against the exact quantile")
def reach_rollup(spark, sf_dir):
    E = store(corpus(spark, sf_dir, with_risk=False).select("date", "reach"), "reach")
    merged = SK.merge_reach(store(SK.reach_sketches(E), "reach-sketches"))
    guess = merged.select(*[SK.quantile_of(F.col("sketch"), F.lit(q)) for q in QUANTILES]).first()           # one row
    exact = [exact_quantile(E, "reach", q) for q in QUANTILES]
    if guess is None or exact[0] is None:
        return spark.createDataFrame([], "q double, reach double, within_1_pct boolean")
    # the estimate's own rank among all values, counted exactly
    below, upto = ([F.avg(test(F.col("reach"), g).cast("int")) for g in guess] for test in (lambda c, g: c < g, lambda c, g: c <= g))
    rows = [F.struct(F.lit(q).alias("q"), F.lit(x).alias("reach"), ((b - 0.01 <= q) & (u + 0.01 >= q)).alias("within_1_pct"))
            for q, x, b, u in zip(QUANTILES, exact, below, upto, strict=True)]
    return present(E.agg(F.array(*rows).alias("r")).select(F.inline("r")), ("reach",))
