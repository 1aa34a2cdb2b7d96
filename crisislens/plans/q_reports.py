"""Queries: report rows (text per period) and the fields of the JSON contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import texts as TX
from ..config import NEGATIVE_SENTIMENTS
from ..functions import rules as RU
from ..operators import narratives as N
from . import reports as RP
from .report_sql import _fint, _ts, fill_sql, narratives_report_parts, narratives_report_sql, shorten_sql
from .oracle import q, with_e_ctes
from .q_periods import _CV_CTES, PERIOD_CTES, shared_tables, stored_periods as _periods
from .registry import r6, register, sln1p, sr6
from .tables import BRIEF, COORDINATION, STRATEGY


_NEG = "(" + ", ".join(q(x) for x in NEGATIVE_SENTIMENTS) + ")"
_NL = "chr(10)"

_BRIEF_CTES = _CV_CTES + f""",
kp AS (SELECT period_id, count(*) AS messages, count(DISTINCT author) AS auteurs, min(dt) AS debut, max(dt) AS fin,
   100.0 * count_if(is_retweet) / count(*) AS rt_pct, sum(reach) AS reach, sum(impressions) AS impressions,
   100.0 * count_if(sentiment IN {_NEG}) / count(*) AS neg_pct, avg(risk_level) AS risk FROM ep GROUP BY period_id),
nn AS (SELECT period_id, count(*) AS n_posts FROM ep GROUP BY period_id),
nc AS (SELECT period_id, narrative, count(*) AS c FROM (SELECT period_id, unnest(narratives) AS narrative FROM ep)
   GROUP BY period_id, narrative),
nr AS (SELECT nc.*, row_number() OVER (PARTITION BY nc.period_id ORDER BY c DESC, narrative) AS r,
   CAST(c AS DOUBLE) / greatest(1, n_posts) * 100 AS p FROM nc JOIN nn USING (period_id)),
nl AS (SELECT period_id, string_agg('- ' || narrative || ' : ' || {_fint('c')} || ' occurrences (' ||
   printf('%.1f', p) || '% des messages).', {_NL} ORDER BY r) AS lines,
   max(CASE WHEN r = 1 THEN narrative END) AS dominant FROM nr WHERE r <= 5 GROUP BY period_id),
sc AS (SELECT period_id, sentiment, count(*) AS c FROM ep GROUP BY period_id, sentiment),
sd AS (SELECT period_id, sentiment AS dom_sent FROM (SELECT *, row_number() OVER (PARTITION BY period_id
   ORDER BY c DESC, sentiment) AS r FROM sc) WHERE r = 1),
au AS (SELECT period_id, author, count(*) AS messages, sum(likes) AS likes, sum(shares) AS shares,
   sum(reach) AS reach, max(followers) AS followers FROM ep GROUP BY period_id, author),
ai AS (SELECT *, {sln1p('reach')} * 0.35 + {sln1p('shares')} * 0.25 + {sln1p('likes')} * 0.20
   + {sln1p('messages')} * 0.10 + {sln1p('followers')} * 0.10 AS infl FROM au),
ar AS (SELECT *, row_number() OVER (PARTITION BY period_id ORDER BY infl DESC, reach DESC, shares DESC, author) AS r
   FROM ai),
al AS (SELECT period_id, string_agg('- @' || author || ' : ' || {_fint('messages')} || ' messages, reach ' ||
   {_fint('reach')} || ', shares ' || {_fint('shares')} || '.', {_NL} ORDER BY r) AS lines,
   max(CASE WHEN r = 1 THEN author END) AS top_author FROM ar WHERE r <= 5 GROUP BY period_id)"""

_BRIEF_TEXT = f"""{q(TX.BRIEF_TITLE)} || {_NL} || {_NL} ||
 '**Période analysée :** ' || {_ts('kp.debut')} || ' → ' || {_ts('kp.fin')} || {_NL} ||
 '**Niveau estimé :** ' || (CASE WHEN f.score >= 80 THEN 'CRISE FORTE' WHEN f.score >= 60 THEN 'CRISE ÉLEVÉE'
      WHEN f.score >= 40 THEN 'CRISE MODÉRÉE' ELSE 'SIGNAL FAIBLE / BRUIT' END) || {_NL} ||
 '**Crisis Velocity Score :** ' || CAST(f.score AS VARCHAR) || '/100' || {_NL} || {_NL} ||
 '### 1. Chiffres clés' || {_NL} ||
 '- ' || {_fint('kp.messages')} || ' messages publiés par ' || {_fint('kp.auteurs')} || ' auteurs uniques.' || {_NL} ||
 '- ' || printf('%.1f', kp.rt_pct) || '% de retweets/reposts : la crise fonctionne surtout par amplification.' || {_NL} ||
 '- Reach cumulé estimé : ' || {_fint('kp.reach')} || ' ; impressions : ' || {_fint('kp.impressions')} || '.' || {_NL} ||
 '- Sentiment négatif : ' || printf('%.1f', kp.neg_pct) || '% ; risque moyen : ' || printf('%.2f', kp.risk) || '/5.'
 || {_NL} || {_NL} || '### 2. Narratif dominant' || {_NL} ||
 '- Narratif principal détecté : **' || coalesce(nl.dominant, {q(TX.NOT_IDENTIFIED)}) || '**.' ||
 coalesce({_NL} || nl.lines, '') || {_NL} || {_NL} || '### 3. Acteurs et amplification' || {_NL} ||
 '- Compte le plus influent sur la période : **@' || coalesce(al.top_author, {q(TX.NOT_IDENTIFIED)}) ||
 '** selon le score d''influence calculé.' || coalesce({_NL} || al.lines, '') || {_NL} || {_NL} ||
 '### 4. Lecture stratégique' || {_NL} || {" || chr(10) || ".join(q(t) for t in TX.BRIEF_STRATEGY)} ||
 CASE WHEN sd.dom_sent IN {_NEG} THEN {_NL} || {q(TX.BRIEF_NEGATIVE)} ELSE '' END"""

BRIEF_SQL = with_e_ctes(_BRIEF_CTES, f"""SELECT kp.period_id, kp.debut, kp.fin, f.score AS crisis_velocity_score,
 CASE WHEN f.score >= 80 THEN 'CRISE FORTE' WHEN f.score >= 60 THEN 'CRISE ÉLEVÉE' WHEN f.score >= 40
      THEN 'CRISE MODÉRÉE' ELSE 'SIGNAL FAIBLE / BRUIT' END AS niveau,
 coalesce(nl.dominant, {q(TX.NOT_IDENTIFIED)}) AS dominant_narrative,
 coalesce(al.top_author, {q(TX.NOT_IDENTIFIED)}) AS top_author,
 {_BRIEF_TEXT} AS brief
FROM kp JOIN f USING (period_id) LEFT JOIN nl USING (period_id) LEFT JOIN sd USING (period_id)
 LEFT JOIN al USING (period_id)""")


@register("brief_rows", BRIEF_SQL, "R1 period analysis, R2 deterministic brief (text per period)")
def brief_rows(spark, sf_dir):
    E, Ep = _periods(spark, sf_dir, *BRIEF)
    return RP.brief_rows(Ep, E)


@register("narratives_report", narratives_report_sql(), "R3 narratives/actors report (markdown per period)")
def narratives_report(spark, sf_dir):
    _, Ep = _periods(spark, sf_dir, "risks", "actors", "mutations")
    return RP.narratives_report(Ep)


def _propagation_report_sql() -> str:
    ctes, select = _propagation_parts()
    return with_e_ctes(PERIOD_CTES + ctes, select)


def _propagation_parts() -> tuple[str, str]:
    """(CTEs behind those of the periods, select)."""
    from ..operators import propagation as PR
    from .oracle import FINGERPRINT_SQL
    from .registry import spct, sround_py
    n = _NL
    ctes = f""",
xph AS (SELECT period_id, hour, count(*) AS c FROM ep GROUP BY period_id, hour),
xpk AS (SELECT period_id, max(c) AS peak FROM xph GROUP BY period_id),
xpb AS (SELECT period_id, min(dt) AS st, max(dt) AS en, count(*) AS messages, count_if(is_retweet) AS rt,
   count(DISTINCT author) AS ua FROM ep GROUP BY period_id),
xpp AS (SELECT xpb.*, peak, greatest(1.0, CAST(epoch_us(en) - epoch_us(st) AS DOUBLE) / 1e6 / 3600.0) AS hours
   FROM xpb JOIN xpk USING (period_id)),
xprop AS (SELECT period_id, messages, ua, peak, {sround_py('hours', 2)} AS dur, {sround_py('messages / hours', 2)} AS mph,
   {sround_py('peak / greatest(messages / hours, 1e-9)', 2)} AS accel, {sround_py(spct('rt', 'messages'), 1)} AS rtp
   FROM xpp),
xca AS (SELECT period_id, author, count(*) AS messages, sum(reach) AS reach, sum(shares) AS shares FROM ep
   GROUP BY period_id, author),
xck AS (SELECT *, row_number() OVER (PARTITION BY period_id ORDER BY reach DESC, shares DESC, messages DESC, author)
   AS rank FROM xca),
xct AS (SELECT period_id, sum(messages) AS tm, sum(reach) AS tr, sum(shares) AS ts FROM xck WHERE rank <= 10
   GROUP BY period_id),
xcn AS (SELECT period_id, count(*) AS n, sum(reach) AS r, sum(shares) AS s FROM ep GROUP BY period_id),
xconc AS (SELECT period_id, round_even(CAST(tm AS DOUBLE) / greatest(n, 1) * 100 * 10, 0) / 10 AS msp,
   round_even(tr / greatest(r, 1.0) * 100 * 10, 0) / 10 AS rsp,
   round_even(ts / greatest(s, 1.0) * 100 * 10, 0) / 10 AS ssp FROM xct JOIN xcn USING (period_id)),
xcf AS (SELECT period_id, {FINGERPRINT_SQL} AS fingerprint, author, reach, post_id, text_raw FROM ep),
xcg AS (SELECT period_id, fingerprint, count(*) AS count, count(DISTINCT author) AS authors, sum(reach) AS reach,
   substr(arg_min(text_raw, post_id), 1, 260) AS example FROM xcf GROUP BY period_id, fingerprint
   HAVING count(*) >= 3 AND length(fingerprint) > 40),
xcp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period_id
   ORDER BY count DESC, authors DESC, reach DESC, fingerprint) AS rank FROM xcg) WHERE rank <= 15),
xbt AS (SELECT period_id, hour, count(*) AS messages, count_if(is_retweet) AS rt FROM ep GROUP BY period_id, hour),
xbz AS (SELECT *, (messages - avg(messages) OVER (PARTITION BY period_id)) /
   (CASE WHEN stddev_pop(messages) OVER (PARTITION BY period_id) = 0 THEN 1
         ELSE stddev_pop(messages) OVER (PARTITION BY period_id) END) AS z FROM xbt),
xbk AS (SELECT *, row_number() OVER (PARTITION BY period_id ORDER BY z DESC, messages DESC, hour) AS rank FROM xbz),
xbl AS (SELECT *, CASE WHEN z >= 3 THEN 'pic majeur' WHEN z >= 2 THEN 'pic notable' ELSE 'normal' END AS lvl,
   CASE WHEN messages > 0 THEN rt / messages * 100 ELSE 0 END AS brt FROM xbk WHERE rank <= 12),
xcc AS (SELECT p.period_id, p.messages, p.ua, p.peak, p.dur, p.mph, p.accel, p.rtp, c.msp, c.rsp, c.ssp,
   least(25.0, p.rtp * 0.25) AS rt_c, least(25.0, c.rsp * 0.35) AS conc_c,
   least(25.0, (SELECT count(*) FROM xcp WHERE xcp.period_id = p.period_id) * 3.5) AS copy_c,
   least(25.0, (SELECT count(*) FROM xbl WHERE xbl.period_id = p.period_id AND lvl <> 'normal') * 4.0) AS burst_c
 FROM xprop p JOIN xconc c USING (period_id)),
xcs AS (SELECT *, {sround_py('rt_c + conc_c + copy_c + burst_c', 1)} AS raw FROM xcc),
xcl AS (SELECT period_id, string_agg('- Gabarit repris ' || {_fint('count')} || ' fois par ' || {_fint('authors')} ||
   ' auteurs ; exemple : ' || substr(example, 1, 140) || '...', {n} ORDER BY rank) AS lines
   FROM xcp WHERE rank <= 5 GROUP BY period_id),
xbb AS (SELECT period_id, string_agg('- ' || {_ts('hour')} || ' : ' || {_fint('messages')} || ' messages, ' ||
   printf('%.1f', brt) || '% RT — ' || lvl || '.', {n} ORDER BY rank) AS lines FROM xbl WHERE rank <= 5
   GROUP BY period_id)"""
    labels = PR.COORDINATION_LABELS
    label = (f"CASE WHEN raw >= 75 THEN {q(labels[0][1])} WHEN raw >= 50 THEN {q(labels[1][1])} "
             f"WHEN raw >= 25 THEN {q(labels[2][1])} ELSE {q(PR.COORDINATION_DEFAULT)} END")
    reading = (f"array_to_string(list_filter([CASE WHEN rtp >= 70 THEN {q('- ' + PR.READING_RT)} END, "
               f"CASE WHEN accel >= 4 THEN {q('- ' + PR.READING_ACCEL)} END, "
               f"CASE WHEN least(100.0, raw) >= 50 THEN {q('- ' + PR.READING_SCORE)} END, "
               f"{q('- ' + PR.READING_ALWAYS)}], lambda x: x IS NOT NULL), {n})")
    score_txt = "CASE WHEN least(100.0, raw) >= 100 THEN '100' ELSE CAST(least(100.0, raw) AS VARCHAR) END"
    return ctes, (f"""SELECT xcs.period_id, least(100.0, raw) AS score, {label} AS label,
 '## Agent 3 — Propagation et coordination prudente' || {n} || {n} ||
 '**Score de coordination prudente :** ' || {score_txt} || '/100 — ' || {label} || '.' || {n} ||
 {q('_Prudence : ' + PR.PRUDENCE + '_')} || {n} || {n} || '### Propagation' || {n} ||
 '- ' || {_fint('messages')} || ' messages sur ' || CAST(dur AS VARCHAR) || ' h, soit ' || CAST(mph AS VARCHAR) ||
 ' messages/h en moyenne.' || {n} || '- Pic horaire : ' || {_fint('peak')} ||
 ' messages ; ratio d''accélération : ×' || CAST(accel AS VARCHAR) || '.' || {n} ||
 '- Retweets/reposts : ' || CAST(rtp AS VARCHAR) || '% ; auteurs uniques : ' || {_fint('ua')} || '.' || {n} || {n} ||
 '### Concentration' || {n} || '- Top comptes : ' || CAST(msp AS VARCHAR) || '% des messages, ' ||
 CAST(rsp AS VARCHAR) || '% du reach, ' || CAST(ssp AS VARCHAR) || '% des shares.' ||
 coalesce({n} || {n} || '### Copier-coller / gabarits' || {n} || xcl.lines, '') ||
 coalesce({n} || {n} || '### Pics horaires' || {n} || xbb.lines, '') ||
 {n} || {n} || '### Lecture opérationnelle' || {n} || {reading} AS markdown
FROM xcs LEFT JOIN xcl USING (period_id) LEFT JOIN xbb USING (period_id)""")


@register("propagation_report", _propagation_report_sql(), "R4 propagation report (markdown per period)")
def propagation_report(spark, sf_dir):
    _, Ep = _periods(spark, sf_dir, *COORDINATION)
    return RP.propagation_report(Ep)


def _strategy_sql() -> str:
    from .q_rules import STRATEGY_CTES
    ctes, select = _strategy_parts()
    return with_e_ctes(STRATEGY_CTES + ctes, select)


def _strategy_parts() -> tuple[str, str]:
    """(CTEs behind those of the strategy, select)."""
    from .q_rules import _POSTURE, _PRIORITY, _SENSITIVE
    axes = [f"- **{a}** — {b} {c}" for a, b, c in TX.MESSAGE_AXES]
    plan = [f"- **{t} — {a} :** {d}" for t, a, d in TX.ACTION_PLAN]
    tail = (["", "### Axes de réponse", *axes, "", "### Plan d'action", *plan, "", "### À éviter absolument",
             *[f"- {t}" for t in TX.AVOID], "", "### Déclencheurs d'escalade",
             *[f"- {t}" for t in TX.ESCALATION_TRIGGERS]])
    tail_sql = " || ".join(f"{_NL} || {q(t)}" for t in tail)
    return f""",
sk AS (SELECT period_id, min(dt) AS debut, max(dt) AS fin, count(*) AS messages,
   100.0 * count_if(is_retweet) / count(*) AS rt_pct FROM ep GROUP BY period_id),
sr AS (SELECT st.*, sk.debut, sk.fin, sk.messages, sk.rt_pct, {_PRIORITY} AS priority, {_POSTURE} AS posture,
   array_to_string({_SENSITIVE}, '|') AS sensitive_points FROM st LEFT JOIN sk USING (period_id))""", (
        f"""SELECT period_id, score, niveau, dominant_narrative, priority, posture, sensitive_points,
 '## Agent 4 — Stratégie de riposte' || {_NL} || {_NL} || '**Période source :** ' || {_ts('debut')} || ' → ' ||
 {_ts('fin')} || {_NL} || '**Niveau :** ' || niveau || ' — score ' || CAST(score AS VARCHAR) || '/100' || {_NL} ||
 '**Priorité :** ' || priority || {_NL} || {q('**Objectif :** ' + TX.DEFAULT_OBJECTIVE)} || {_NL} ||
 '**Posture recommandée :** ' || posture || {_NL} || {q('**Cibles :** ' + ', '.join(TX.DEFAULT_TARGETS))} ||
 {_NL} || {_NL} || '### Diagnostic stratégique' || {_NL} || '- Messages analysés : ' || {_fint('messages')} ||
 ' ; retweets/reposts : ' || printf('%.1f', rt_pct) || '%.' || {_NL} ||
 '- Le narratif dominant détecté est : ' || dominant_narrative || '.' || {_NL} ||
 {q("- Le risque prioritaire est la perte de contrôle du cadrage public, plus que la simple correction d'un fait.")}
 || {tail_sql} AS markdown FROM sr""")


@register("strategy_report", _strategy_sql(), "R6 strategy (priority, posture, axes, plan, avoid, triggers) per period")
def strategy_report(spark, sf_dir):
    E, Ep = _periods(spark, sf_dir, *STRATEGY)
    return RP.strategy_report(Ep, E).select("period_id", "score", "niveau", "dominant_narrative", "priority", "posture",
                                            F.array_join("sensitive_points", "|").alias("sensitive_points"), "markdown")


def _pack_report_sql() -> str:
    from .q_rules import pack_ctes
    return with_e_ctes(pack_ctes(), _pack_select())


def _pack_select() -> str:
    head = " || ".join(q(t) + f" || {_NL}" for t in (
        "## Agent 5 — Messages rédigés + garde-fou", "", f"**Ton :** {TX.DEFAULT_TONE}",
        f"**Porte-parole :** {TX.DEFAULT_SPOKESPERSON}", ""))
    return (f"""SELECT period_id, {head} ||
 string_agg('### ' || canal || {_NL} || text || {_NL}, {_NL} ORDER BY channel_order) || {_NL} || '### Garde-fou' ||
 {_NL} || string_agg('- **' || canal || '** : ' || statut || ' — ' || "risques_detectés" || '.', {_NL}
   ORDER BY channel_order) || {_NL} || {_NL} || {q(TX.PACK_FINAL_RULE)} AS markdown FROM pg GROUP BY period_id""")


@register("pack_report", _pack_report_sql(), "R7 message pack markdown with guardrail lines per period")
def pack_report(spark, sf_dir):
    E, Ep = _periods(spark, sf_dir, *STRATEGY)
    return RP.pack_report(Ep, E)


_CONTEXT_CTES = _BRIEF_CTES + """,
cn AS (SELECT period_id, string_agg(narrative || ':' || c, '|' ORDER BY r) AS narratives FROM nr WHERE r <= 8 GROUP BY period_id),
ca AS (SELECT period_id, string_agg(author || ':' || messages, '|' ORDER BY r) AS top_authors FROM ar WHERE r <= 8 GROUP BY period_id),
cpr AS (SELECT period_id, post_id, row_number() OVER (PARTITION BY period_id ORDER BY engagement_total DESC, reach DESC,
   shares DESC, post_id) AS r FROM ep),
cq AS (SELECT period_id, string_agg(CAST(post_id AS VARCHAR), '|' ORDER BY r) AS top_posts FROM cpr WHERE r <= 5 GROUP BY period_id)"""
_CONTEXT_FIELDS = f"""SELECT kp.period_id, {_ts('kp.debut')} AS debut, {_ts('kp.fin')} AS fin, kp.messages, f.score,
 CASE WHEN f.score >= 80 THEN 'CRISE FORTE' WHEN f.score >= 60 THEN 'CRISE ÉLEVÉE' WHEN f.score >= 40
      THEN 'CRISE MODÉRÉE' ELSE 'SIGNAL FAIBLE / BRUIT' END AS niveau,
 coalesce(nl.dominant, {q(TX.NOT_IDENTIFIED)}) AS dominant_narrative, coalesce(al.top_author, {q(TX.NOT_IDENTIFIED)}) AS top_author,
 cn.narratives, ca.top_authors, cq.top_posts"""
_CONTEXT_FROM = """
FROM kp JOIN f USING (period_id) LEFT JOIN nl USING (period_id) LEFT JOIN al USING (period_id)
 LEFT JOIN cn USING (period_id) LEFT JOIN ca USING (period_id) LEFT JOIN cq USING (period_id)"""


@register("crisis_context", with_e_ctes(_CONTEXT_CTES, _CONTEXT_FIELDS + _CONTEXT_FROM), "R5 typed crisis context of each period")
def crisis_context(spark, sf_dir):
    E, Ep = _periods(spark, sf_dir, *BRIEF, "posts")
    c = lambda name: F.col(f"context.{name}")
    pairs = lambda rows, a, b: F.array_join(F.transform(c(rows), lambda r: F.concat_ws(":", r[a], r[b].cast("string"))), "|")
    return RP.crisis_context(Ep, E).select(
        "period_id", c("periode.start").alias("debut"), c("periode.end").alias("fin"), c("kpis.messages").alias("messages"),
        c("score").alias("score"), c("niveau").alias("niveau"), c("dominant_narrative").alias("dominant_narrative"),
        c("top_author").alias("top_author"), pairs("narratives", "narrative", "count").alias("narratives"),
        pairs("top_authors", "author", "messages").alias("top_authors"),
        F.array_join(F.transform(c("top_posts"), lambda r: r["post_id"].cast("string")), "|").alias("top_posts"))


def _typed(df, column: str):
    """(df with ``column`` as a VARIANT in ``v``, a function for its typed fields)."""
    return df.withColumn("v", F.parse_json(column)), lambda path, kind: F.try_variant_get("v", path, kind)


def _rows(rows, *names: str):
    """Records as text: fields joined by colons, records by bars."""
    return F.array_join(F.transform(rows, lambda r: F.concat_ws(":", *[r[n].cast("string") for n in names])), "|")


@register("context_json", with_e_ctes(_CONTEXT_CTES, _CONTEXT_FIELDS + f""", {sr6('kp.rt_pct')} AS retweets_pct,
 kp.auteurs AS auteurs_uniques, CAST(trunc(kp.reach) AS BIGINT) AS reach, {_BRIEF_TEXT} AS brief""" + _CONTEXT_FROM + " LEFT JOIN sd USING (period_id)"),
          "K7, R5 the JSON context of each period, its fields read back as typed values")
def context_json(spark, sf_dir):
    df, get = _typed(RP.context_json(shared_tables(spark, sf_dir, *BRIEF, "posts")), "context_json")
    return df.select(
        "period_id", get("$.periode.start", "string").alias("debut"), get("$.periode.end", "string").alias("fin"), get("$.kpis.messages", "bigint").alias("messages"),
        get("$.score", "double").alias("score"), get("$.niveau", "string").alias("niveau"), get("$.dominant_narrative", "string").alias("dominant_narrative"),
        get("$.top_author", "string").alias("top_author"),
        _rows(get("$.narratives", "array<struct<narrative string, count bigint>>"), "narrative", "count").alias("narratives"),
        _rows(get("$.top_authors", "array<struct<author string, messages bigint>>"), "author", "messages").alias("top_authors"),
        _rows(get("$.top_posts", "array<struct<post_id bigint>>"), "post_id").alias("top_posts"),
        r6(get("$.kpis.retweets_pct", "double")).alias("retweets_pct"), get("$.kpis.auteurs_uniques", "bigint").alias("auteurs_uniques"),
        get("$.kpis.reach", "double").cast("bigint").alias("reach"), get("$.brief_agent1", "string").alias("brief"))


def _all_ctes() -> str:
    """The CTEs of every report."""
    from .q_rules import STRATEGY_CTES, pack_parts
    strategy = ",\ndn AS" + STRATEGY_CTES.split(",\ndn AS", 1)[1]
    return _BRIEF_CTES + strategy + _strategy_parts()[0] + pack_parts() + narratives_report_parts()[0] + _propagation_parts()[0] + f""",
r2 AS ({narratives_report_parts()[1]}),
r3 AS ({_propagation_parts()[1]}),
r4 AS ({_strategy_parts()[1]}),
r5 AS ({_pack_select()})"""


def _answers_sql() -> str:
    from .q_rules import _route_sql
    number = lambda c: f"CAST({c} AS VARCHAR)"
    metrics = ", ".join(f"'\"{name}\":' || {value}" for name, value in (
        ("start", f"'\"' || {_ts('xpp.st')} || '\"'"), ("end", f"'\"' || {_ts('xpp.en')} || '\"'"), ("duration_hours", number("dur")),
        ("messages", number("xprop.messages")), ("messages_per_hour", number("mph")), ("peak_hour_messages", number("xprop.peak")), ("acceleration_ratio", number("accel")),
        ("retweet_pct", number("rtp")), ("unique_authors", number("xprop.ua")), ("reach", number("CAST(trunc(kp.reach) AS BIGINT)")),
        ("impressions", number("CAST(trunc(kp.impressions) AS BIGINT)"))))
    line = fill_sql(TX.ANSWER_NARRATIVE_LINE, narratif="narrative", messages="CAST(messages AS VARCHAR)", score="CAST(score AS VARCHAR)", angle="angle")
    parts = dict(debut=_ts("debut"), fin=_ts("fin"), niveau="niveau", score="CAST(score AS VARCHAR)", messages=_fint("messages"), auteurs=_fint("auteurs"),
                 retweets="printf('%.1f', rt_pct)", negatif="printf('%.1f', neg_pct)", dominant="dominant_narrative", narratifs="coalesce(a2, '')",
                 coordination="CASE WHEN coord >= 100 THEN '100' ELSE CAST(coord AS VARCHAR) END", label="label", metriques="substr(metrics, 1, 900)",
                 rapport3=shorten_sql("md3", 1600), priorite="priority", posture="posture", rapport4=shorten_sql("md4", 2200), rapport5=shorten_sql("md5", 2600))
    parts["coordination"] = f"({parts['coordination']})"
    sources = [src for src, _ in RU.ROUTES] + [RU.ROUTE_FALLBACK]
    sections = ", ".join(f"CASE WHEN list_contains(s, {q(src)}) THEN coalesce(sec{i}, {q(TX.NOT_AVAILABLE)}) END" for i, src in enumerate(sources))
    columns = ", ".join(f"{fill_sql(text, **parts)} AS sec{i}" for i, text in enumerate(TX.ANSWER_SECTIONS))
    return with_e_ctes(_all_ctes() + f""",
w2 AS (SELECT period_id, string_agg({line}, '' ORDER BY rank) AS a2 FROM ym WHERE rank <= 5 GROUP BY period_id),
w AS (SELECT kp.period_id, kp.debut, kp.fin, r4.niveau, f.score, kp.messages, kp.auteurs, kp.rt_pct, kp.neg_pct, coalesce(nl.dominant, {q(TX.NOT_IDENTIFIED)}) AS dominant_narrative,
   a2, r3.score AS coord, r3.label, r3.markdown AS md3, r4.priority, r4.posture, r4.markdown AS md4, r5.markdown AS md5, '{{' || concat_ws(',', {metrics}) || '}}' AS metrics
 FROM kp JOIN f USING (period_id) JOIN xprop USING (period_id) JOIN xpp USING (period_id) LEFT JOIN nl USING (period_id) LEFT JOIN w2 USING (period_id)
 LEFT JOIN r3 USING (period_id) LEFT JOIN r4 USING (period_id) LEFT JOIN r5 USING (period_id)),
ws AS (SELECT period_id, {columns} FROM w),
wq AS (SELECT conv_id, turn, 'peak_day_' || CAST(conv_id % 5 + 1 AS VARCHAR) AS period_id, {_route_sql('text')} AS s FROM conversations WHERE role = 'user')""",
        f"""SELECT conv_id, turn, wq.period_id, array_to_string(s, '|') AS sources,
 CASE WHEN len(s) = 0 THEN {q(TX.ANSWER_EMPTY)} ELSE
  array_to_string(list_filter([{sections}], lambda x: x IS NOT NULL), chr(10) || chr(10)) || {q(TX.ANSWER_SOURCES_PREFIX)} || array_to_string(s, ', ') || '.' END AS answer,
 'déterministe' AS mode
FROM wq LEFT JOIN ws ON ws.period_id = wq.period_id""")


@register("answers", _answers_sql(), "R9, C16, C17 deterministic answers to every user turn, each about one of five periods")
def answers(spark, sf_dir):
    qs = (spark.read.parquet(f"{sf_dir}/conversations.parquet").where(F.col("role") == "user")
          .select("conv_id", "turn", F.col("text").alias("question"), F.concat(F.lit("peak_day_"), (F.col("conv_id") % 5 + 1).cast("string")).alias("period_id")))
    return RP.answers(qs, shared_tables(spark, sf_dir, *BRIEF, "risks", *COORDINATION), keys=("conv_id", "turn"))


def _agent_context_sql() -> str:
    agg = lambda cte, record, order, top, name: (
        f"(SELECT period_id, string_agg({record}, '|' ORDER BY {order}) AS {name} FROM {cte} WHERE {top} <= 8 GROUP BY period_id)")
    text = lambda c: f"CAST({c} AS VARCHAR)"
    joins = " ".join(f"LEFT JOIN {x} USING (period_id)" for x in (
        agg("ym", f"narrative || ':' || {text('score')}", "rank", "rank", "narratives"),
        agg("yas", f"author || ':' || narrative || ':' || {text('messages')}", "rank", "rank", "actors"),
        agg("(SELECT *, row_number() OVER (PARTITION BY period_id ORDER BY hour) AS k FROM yl)",
            f"{_ts('hour')} || ':' || narrative || ':' || CASE WHEN prev IS NOT NULL AND prev <> narrative THEN {q(N.MUTATION_CHANGE)} ELSE {q(N.MUTATION_STABLE)} END", "hour", "k", "mutations"),
        agg("xbl", f"{_ts('hour')} || ':' || {text('messages')} || ':' || lvl", "rank", "rank", "bursts"),
        agg("xcp", f"{text('count')} || ':' || {text('authors')}", "rank", "rank", "copies"),
        agg("pg", "canal || ':' || statut", "channel_order", "channel_order", "guardrail"),
        f"(SELECT period_id, string_agg(narrative || ' : ' || angle || '.', chr(10) ORDER BY rank) || chr(10) || {q(N.REC_LAST)} AS recommendations FROM ym WHERE rank <= 4 GROUP BY period_id)"))
    plan = "|".join(f"{t}:{a}" for t, a, _ in TX.ACTION_PLAN)
    return with_e_ctes(_all_ctes(), f"""SELECT kp.period_id, f.score, r4.niveau, r4.dominant_narrative, kp.messages, narratives, actors, mutations, recommendations,
 {shorten_sql('r2.markdown', 3600)} AS narratives_markdown, r3.score AS coordination, r3.label, xprop.mph AS messages_per_hour, bursts, copies,
 {shorten_sql('r3.markdown', 3600)} AS propagation_markdown, r4.priority, r4.posture, {q(plan)} AS plan, {shorten_sql('r4.markdown', 4200)} AS strategy_markdown,
 guardrail, {shorten_sql('r5.markdown', 5200)} AS messages_markdown, {q('|'.join(TX.SOURCE_PRIORITY))} AS source_priority
FROM kp JOIN f USING (period_id) JOIN xprop USING (period_id) LEFT JOIN r2 USING (period_id) LEFT JOIN r3 USING (period_id) LEFT JOIN r4 USING (period_id)
 LEFT JOIN r5 USING (period_id) {joins}""")


@register("agent_context", _agent_context_sql(), "R8 per-period context of the answering step (all report parts, bounded), its fields read back as typed values")
def agent_context(spark, sf_dir):
    df, get = _typed(RP.agent_context(shared_tables(spark, sf_dir)), "agent_context")
    a1, a2, a3, a4, a5 = "$.agent1_diagnostic", "$.agent2_narratifs", "$.agent3_propagation", "$.agent4_strategie", "$.agent5_redaction"
    text = lambda path: get(path, "string")
    return df.select(
        "period_id", get(f"{a1}.score", "double").alias("score"), text(f"{a1}.niveau").alias("niveau"), text(f"{a1}.dominant_narrative").alias("dominant_narrative"),
        get(f"{a1}.kpis.messages", "bigint").alias("messages"),
        _rows(get(f"{a2}.risk_matrix", "array<struct<narrative string, strategic_risk_score double>>"), "narrative", "strategic_risk_score").alias("narratives"),
        _rows(get(f"{a2}.actor_narratives", "array<struct<author string, narrative string, messages bigint>>"), "author", "narrative", "messages").alias("actors"),
        _rows(get(f"{a2}.mutation_signals", "array<struct<period string, dominant_narrative string, mutation string>>"), "period", "dominant_narrative", "mutation").alias("mutations"),
        F.array_join(get(f"{a2}.recommendations", "array<string>"), "\n").alias("recommendations"), text(f"{a2}.markdown").alias("narratives_markdown"),
        get(f"{a3}.coordination_score.score", "double").alias("coordination"), text(f"{a3}.coordination_score.label").alias("label"),
        get(f"{a3}.propagation_metrics.messages_per_hour", "double").alias("messages_per_hour"),
        _rows(get(f"{a3}.burst_patterns", "array<struct<hour string, messages bigint, burst_level string>>"), "hour", "messages", "burst_level").alias("bursts"),
        _rows(get(f"{a3}.copy_patterns", "array<struct<count bigint, authors bigint>>"), "count", "authors").alias("copies"),
        text(f"{a3}.markdown").alias("propagation_markdown"), text(f"{a4}.priority").alias("priority"), text(f"{a4}.posture").alias("posture"),
        _rows(get(f"{a4}.plan_action", "array<struct<temps string, action string>>"), "temps", "action").alias("plan"), text(f"{a4}.markdown").alias("strategy_markdown"),
        _rows(get(f"{a5}.guardrail", "array<struct<canal string, statut string>>"), "canal", "statut").alias("guardrail"), text(f"{a5}.markdown").alias("messages_markdown"),
        F.array_join(get("$.source_priority", "array<string>"), "|").alias("source_priority"))
