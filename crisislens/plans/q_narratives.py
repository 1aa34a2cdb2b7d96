"""Queries: narrative risk matrix, timeline, mutation, actors, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import NEGATIVE_SENTIMENTS
from ..operators import narratives as N
from .oracle import q, with_e_ctes
from .registry import corpus, present, register, sln1p, spct, sr6, sround_py

_NEG = "(" + ", ".join(q(s) for s in NEGATIVE_SENTIMENTS) + ")"


def _label_sql(score: str) -> str:
    return (f"CASE WHEN {score} >= 80 THEN 'Critique' WHEN {score} >= 60 THEN 'Élevé' "
            f"WHEN {score} >= 40 THEN 'Modéré' ELSE 'Faible' END")


def _angle_sql(label: str) -> str:
    parts = []
    for words, answer in N.ANGLE_RULES:
        cond = " OR ".join(f"contains(lower({label}), {q(w)})" for w in words)
        parts.append(f"WHEN {cond} THEN {q(answer)}")
    return "CASE " + " ".join(parts) + f" ELSE {q(N.ANGLE_DEFAULT)} END"


MATRIX_CTES = f"""x AS (SELECT unnest(narratives) AS narrative, reach, shares, sentiment, is_retweet, risk_level FROM e),
n AS (SELECT count(*) AS n_posts FROM e),
g AS (SELECT narrative, count(*) AS messages, sum(reach) AS r, sum(shares) AS s, count_if(sentiment IN {_NEG}) AS ng,
   count_if(is_retweet) AS rt, avg(risk_level) AS risk FROM x GROUP BY narrative),
h AS (SELECT g.*, {spct('messages', 'n_posts')} AS share, {spct('ng', 'messages')} AS neg,
   {spct('rt', 'messages')} AS rtp FROM g CROSS JOIN n),
sc AS (SELECT *, {sround_py('''least(25.0, share * 0.45)
   + CASE WHEN r > 0 THEN least(20.0, ln(1 + r) / 18 * 20) ELSE 0.0 END
   + CASE WHEN s > 0 THEN least(15.0, ln(1 + s) / 10 * 15) ELSE 0.0 END
   + least(20.0, neg * 0.20) + least(20.0, (risk / 5) * 20)''', 1)} AS score FROM h),
mx AS (SELECT row_number() OVER (ORDER BY score DESC, messages DESC, narrative) AS rank, narrative, messages,
   {sround_py('share', 1)} AS pct_messages, CAST(trunc(r) AS BIGINT) AS reach, CAST(trunc(s) AS BIGINT) AS shares,
   {sround_py('neg', 1)} AS negatif_pct, {sround_py('rtp', 1)} AS rt_pct, {sround_py('risk', 2)} AS risk_mean,
   score AS strategic_risk_score, {_label_sql('score')} AS risk_label, {_angle_sql('narrative')} AS angle_de_reponse
 FROM sc)"""


@register("narrative_matrix", with_e_ctes(MATRIX_CTES, "SELECT * FROM mx"),
          "A10 narrative matrix, X2 strategic score, C4 risk label, C6 response angle, T5 order")
def narrative_matrix(spark, sf_dir):
    return present(N.risk_matrix(N.narrative_matrix(corpus(spark, sf_dir))))


@register("narrative_recommendations", with_e_ctes(MATRIX_CTES, f"""SELECT
 CASE WHEN count(*) = 0 THEN {q(N.REC_EMPTY)} ELSE
 string_agg(narrative || ' : ' || angle_de_reponse || '.', chr(10) ORDER BY rank) || chr(10) || {q(N.REC_LAST)} END
 AS recommendations FROM mx WHERE rank <= 4"""), "C12 top-4 narrative recommendations + closing line")
def narrative_recommendations(spark, sf_dir):
    rm = N.risk_matrix(N.narrative_matrix(corpus(spark, sf_dir)))
    return N.recommendations(rm).select(F.array_join("recommendations", "\n").alias("recommendations"))


TIMELINE_CTE = """tl AS (SELECT hour, narrative, count(*) AS messages, sum(reach) AS reach, count_if(is_retweet) AS retweets,
 avg(risk_level) AS risk_mean FROM (SELECT hour, unnest(narratives) AS narrative, reach, is_retweet, risk_level FROM e)
 GROUP BY hour, narrative)"""


@register("narrative_timeline", with_e_ctes(TIMELINE_CTE, f"""SELECT hour, narrative, messages, reach, retweets,
 {sr6('risk_mean')} AS risk_mean, {sr6('CASE WHEN messages > 0 THEN retweets / messages * 100 ELSE 0 END')} AS rt_pct
 FROM tl"""), "A11 narrative x hour timeline")
def narrative_timeline(spark, sf_dir):
    return present(N.narrative_timeline(corpus(spark, sf_dir)), ("risk_mean", "rt_pct"))


@register("narrative_mutation", with_e_ctes(TIMELINE_CTE + """,
dom AS (SELECT hour, narrative, messages FROM (SELECT *, row_number() OVER (PARTITION BY hour
   ORDER BY messages DESC, narrative) AS r FROM tl) WHERE r = 1),
lg AS (SELECT *, lag(narrative) OVER (ORDER BY hour) AS previous FROM dom)""", """SELECT hour AS period,
 narrative AS dominant_narrative, messages, previous,
 CASE WHEN previous IS NOT NULL AND previous <> narrative THEN 'changement de narratif dominant' ELSE 'stable' END
 AS mutation FROM lg"""), "W5 dominant narrative per hour, W6 mutation (lag)")
def narrative_mutation(spark, sf_dir):
    return N.detect_mutation(N.narrative_timeline(corpus(spark, sf_dir)))


@register("actor_narratives", with_e_ctes(f"""a AS (SELECT author, narrative, count(*) AS messages, sum(reach) AS reach,
 sum(shares) AS shares, sum(likes) AS likes, avg(risk_level) AS risk_mean
 FROM (SELECT author, unnest(narratives) AS narrative, reach, shares, likes, risk_level FROM e) GROUP BY author, narrative),
s AS (SELECT *, {sln1p('reach')} * 0.35 + {sln1p('shares')} * 0.30 + {sln1p('likes')} * 0.20
   + {sln1p('messages')} * 0.15 AS sc FROM a),
k AS (SELECT *, row_number() OVER (ORDER BY sc DESC, author, narrative) AS rank FROM s)""",
    f"""SELECT rank, author, narrative, messages, reach, shares, likes, {sr6('risk_mean')} AS risk_mean,
 {sr6('sc')} AS actor_narrative_score FROM k WHERE rank <= 10"""), "A12 actor x narrative score, T6 top-10")
def actor_narratives(spark, sf_dir):
    return present(N.actor_narratives(corpus(spark, sf_dir), top_n=10), ("risk_mean", "actor_narrative_score"))


@register("narrative_samples", with_e_ctes("", """SELECT * FROM (SELECT narrative,
 row_number() OVER (PARTITION BY narrative ORDER BY engagement_total DESC, reach DESC, shares DESC, post_id) AS rank,
 post_id, dt, author, engagement_type, sentiment, likes, shares, reach, risk_level, text_raw
 FROM (SELECT unnest(narratives) AS narrative, * EXCLUDE (narratives) FROM e)) WHERE rank <= 3"""),
          "W7 top-3 sample posts per narrative")
def narrative_samples(spark, sf_dir):
    return present(N.sample_posts(corpus(spark, sf_dir), top_n=3))
