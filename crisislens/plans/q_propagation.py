"""Queries: propagation, concentration, copy templates, coordination."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import propagation as PR
from ..operators import timeline as TL
from .oracle import FINGERPRINT_SQL, q, with_e_ctes
from .registry import corpus, register, spct, sround_py
from .tables import store

PROP_CTES = f"""ph AS (SELECT hour, count(*) AS c FROM e GROUP BY hour),
pb AS (SELECT min(dt) AS "start", max(dt) AS "end", count(*) AS messages, count_if(is_retweet) AS rt,
   count(DISTINCT author) AS unique_authors, sum(reach) AS r, sum(impressions) AS i FROM e),
pp AS (SELECT pb.*, (SELECT max(c) FROM ph) AS peak_hour_messages,
   greatest(1.0, CAST(epoch_us("end") - epoch_us("start") AS DOUBLE) / 1e6 / 3600.0) AS hours FROM pb),
prop AS (SELECT "start", "end", {sround_py('hours', 2)} AS duration_hours, messages,
   {sround_py('messages / hours', 2)} AS messages_per_hour, peak_hour_messages,
   {sround_py('peak_hour_messages / greatest(messages / hours, 1e-9)', 2)} AS acceleration_ratio,
   {sround_py(spct('rt', 'messages'), 1)} AS retweet_pct, unique_authors,
   CAST(trunc(r) AS BIGINT) AS reach, CAST(trunc(i) AS BIGINT) AS impressions FROM pp)"""


@register("propagation", with_e_ctes(PROP_CTES, "SELECT * FROM prop"),
          "A13 propagation metrics (two-level hour aggregation), X5 acceleration")
def propagation(spark, sf_dir):
    return PR.propagation_metrics(corpus(spark, sf_dir))


CONC_CTES = """ca AS (SELECT author, count(*) AS messages, sum(reach) AS reach, sum(shares) AS shares, sum(likes) AS likes,
   count_if(is_retweet) AS retweets FROM e GROUP BY author),
ck AS (SELECT *, row_number() OVER (ORDER BY reach DESC, shares DESC, messages DESC, author) AS rank FROM ca),
ct AS (SELECT sum(messages) AS tm, sum(reach) AS tr, sum(shares) AS ts FROM ck WHERE rank <= 10),
cn AS (SELECT count(*) AS n, sum(reach) AS r, sum(shares) AS s, count(DISTINCT author) AS authors_total FROM e),
conc AS (SELECT round_even(CAST(tm AS DOUBLE) / greatest(n, 1) * 100 * 10, 0) / 10 AS top10_message_share_pct,
   round_even(tr / greatest(r, 1.0) * 100 * 10, 0) / 10 AS top10_reach_share_pct,
   round_even(ts / greatest(s, 1.0) * 100 * 10, 0) / 10 AS top10_share_share_pct, authors_total FROM ct CROSS JOIN cn)"""


@register("concentration", with_e_ctes(CONC_CTES, "SELECT * FROM conc"),
          "A14 concentration of posts/reach/shares in the top-10 authors by reach")
def concentration(spark, sf_dir):
    return PR.concentration_metrics(corpus(spark, sf_dir), top_n=10)


@register("concentration_authors", with_e_ctes(CONC_CTES, """SELECT rank, author, messages, reach, shares, likes,
 retweets FROM ck WHERE rank <= 10"""), "A14 top authors by reach, T9 order")
def concentration_authors(spark, sf_dir):
    return PR.concentration_table(corpus(spark, sf_dir), top_n=10)


COPY_CTES = f"""cf AS (SELECT {FINGERPRINT_SQL} AS fingerprint, author, dt, reach, post_id, text_raw FROM e),
cg AS (SELECT fingerprint, count(*) AS count, count(DISTINCT author) AS authors, min(dt) AS first_seen,
   max(dt) AS last_seen, sum(reach) AS reach, substr(arg_min(text_raw, post_id), 1, 260) AS example
 FROM cf GROUP BY fingerprint HAVING count(*) >= 3 AND length(fingerprint) > 40),
cp AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY count DESC, authors DESC, reach DESC, fingerprint) AS rank, *
 FROM cg) WHERE rank <= 15)"""


@register("copy_patterns", with_e_ctes(COPY_CTES, "SELECT * FROM cp"),
          "C5 copy fingerprint, A15 copy groups, F4 filter, T7 top-15")
def copy_patterns(spark, sf_dir):
    return PR.copy_patterns(corpus(spark, sf_dir))


BURST_CTES = """bt AS (SELECT hour, count(*) AS messages FROM e GROUP BY hour),
bz AS (SELECT *, (messages - avg(messages) OVER ()) /
   (CASE WHEN stddev_pop(messages) OVER () = 0 THEN 1 ELSE stddev_pop(messages) OVER () END) AS z FROM bt),
bk AS (SELECT *, row_number() OVER (ORDER BY z DESC, messages DESC, hour) AS rank FROM bz)"""

COORD_CTES = ",\n".join([PROP_CTES, CONC_CTES, COPY_CTES, BURST_CTES]) + f""",
cc AS (SELECT least(25.0, prop.retweet_pct * 0.25) AS rt_c, least(25.0, conc.top10_reach_share_pct * 0.35) AS conc_c,
   least(25.0, (SELECT count(*) FROM cp) * 3.5) AS copy_c,
   least(25.0, (SELECT count(*) FROM bk WHERE rank <= 12 AND z >= 2) * 4.0) AS burst_c,
   prop.retweet_pct, prop.acceleration_ratio FROM prop CROSS JOIN conc),
cs AS (SELECT *, {sround_py('rt_c + conc_c + copy_c + burst_c', 1)} AS raw FROM cc)"""


@register("coordination", with_e_ctes(COORD_CTES, f"""SELECT least(100.0, raw) AS score,
 CASE WHEN raw >= 75 THEN {q(PR.COORDINATION_LABELS[0][1])} WHEN raw >= 50 THEN {q(PR.COORDINATION_LABELS[1][1])}
      WHEN raw >= 25 THEN {q(PR.COORDINATION_LABELS[2][1])} ELSE {q(PR.COORDINATION_DEFAULT)} END AS label,
 {sround_py('rt_c', 1)} AS rt_component, {sround_py('conc_c', 1)} AS concentration_component,
 {sround_py('copy_c', 1)} AS copy_component, {sround_py('burst_c', 1)} AS burst_component,
 {q(PR.PRUDENCE)} AS prudence,
 array_to_string(list_filter([CASE WHEN retweet_pct >= 70 THEN {q(PR.READING_RT)} END,
   CASE WHEN acceleration_ratio >= 4 THEN {q(PR.READING_ACCEL)} END,
   CASE WHEN least(100.0, raw) >= 50 THEN {q(PR.READING_SCORE)} END, {q(PR.READING_ALWAYS)}],
   lambda x: x IS NOT NULL), '|') AS operational_reading FROM cs"""),
          "X3 coordination score, C9 label, C11 operational reading (from A13, A14, A15, A16)")
def coordination(spark, sf_dir):
    # the columns of its four tables, written once: of a text, the fingerprint and the example are all they read
    E = store(corpus(spark, sf_dir).select("post_id", "dt", "hour", "author", "is_retweet", "reach", "impressions", "shares", "likes", "fingerprint",
                                           F.substring("text_raw", 1, C.COPY_EXAMPLE_CHARS).alias("text_raw")), "coordination")
    out = PR.coordination(PR.propagation_metrics(E), PR.concentration_metrics(E), PR.copy_patterns(E), TL.bursts(E))
    return out.withColumn("operational_reading", F.array_join("operational_reading", "|"))
