"""Queries: guardrail, question routing, strategy rows, message pack."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as RU
from ..functions.text import SPACE, portable_regex
from ..operators import strategy as ST
from ..texts import CHANNEL_TEMPLATES, DEFAULT_CHANNELS, DEFAULT_SPOKESPERSON
from .oracle import q, with_e_ctes
from .q_periods import _CV_CTES, _periods, stored_periods
from .registry import register
from .tables import STRATEGY

_TRIM = f"'^{SPACE}+|{SPACE}+$'"


def _contains_any_sql(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def guardrail_sql(text: str) -> str:
    """Guardrail columns for DuckDB, same fixed values as the Spark side."""
    low = f"lower(coalesce({text}, ''))"
    search = lambda p: f"regexp_matches({low}, {q('(?i)' + portable_regex(p))})"
    flags = "list_filter([" + ", ".join(
        f"CASE WHEN {search(p)} THEN {q(RU.RISK_PREFIX + label)} END" for label, p in RU.FORBIDDEN_PATTERNS
    ) + "], lambda x: x IS NOT NULL)"
    missing = "list_filter([" + ", ".join(
        f"CASE WHEN NOT {search(p)} THEN {q(label)} END" for label, p in RU.EXPECTED_PATTERNS
    ) + "], lambda x: x IS NOT NULL)"
    return f"""CASE WHEN len({flags}) > 0 THEN {q(RU.STATUS_FIX)} WHEN len({missing}) <= 1 THEN {q(RU.STATUS_CLEAN)}
   ELSE {q(RU.STATUS_REVIEW)} END AS statut,
 CASE WHEN len({flags}) > 0 THEN array_to_string({flags}, '; ') ELSE {q(RU.NO_RISK)} END AS "risques_detectés",
 CASE WHEN len({missing}) > 0 THEN array_to_string({missing}, '; ') ELSE {q(RU.NOTHING_MISSING)} END
   AS "points_à_renforcer",
 CAST(length(coalesce({text}, '')) AS BIGINT) AS "longueur_caractères\""""


@register("guardrail", f"SELECT conv_id, turn, role, {guardrail_sql('text')} FROM conversations",
          "C14 guardrail (forbidden / expected patterns, status) over every conversation turn")
def guardrail(spark, sf_dir):
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    g = RU.guardrail(F.col("text"))
    return conv.select("conv_id", "turn", "role", *[c.alias(k) for k, c in g.items()])


def _route_sql(text: str) -> str:
    qn = f"regexp_replace(regexp_replace(lower(coalesce({text}, '')), {_TRIM}, '', 'g'), '{SPACE}+', ' ', 'g')"
    hits = "list_filter([" + ", ".join(
        f"CASE WHEN {_contains_any_sql(qn, words)} THEN {q(src)} END" for src, words in RU.ROUTES
    ) + "], lambda x: x IS NOT NULL)"
    return (f"CASE WHEN {qn} = '' THEN [] WHEN len({hits}) = 0 THEN [{q(RU.ROUTE_FALLBACK)}] "
            f"ELSE {hits} END")


@register("question_routing", f"""SELECT conv_id, turn, array_to_string(s, '|') AS sources,
 CAST(len(s) AS BIGINT) AS n_sources FROM (SELECT conv_id, turn, {_route_sql('text')} AS s
 FROM conversations WHERE role = 'user')""", "C15 routing of every user question to answer sections")
def question_routing(spark, sf_dir):
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").where(F.col("role") == "user")
    s = RU.route_question(F.col("text"))
    return conv.select("conv_id", "turn", F.array_join(s, "|").alias("sources"),
                       F.size(s).cast("bigint").alias("n_sources"))


def _rules_sql(x: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_contains_any_sql(x, w)} THEN {q(a)}" for w, a in rules) + f" ELSE {default} END"


STRATEGY_CTES = _CV_CTES + """,
nc AS (SELECT period_id, narrative, count(*) AS c FROM (SELECT period_id, unnest(narratives) AS narrative FROM ep)
 GROUP BY period_id, narrative),
dn AS (SELECT period_id, narrative AS dominant_narrative FROM (SELECT *, row_number() OVER (PARTITION BY period_id
 ORDER BY c DESC, narrative) AS r FROM nc) WHERE r = 1),
st AS (SELECT f.period_id, f.score,
 CASE WHEN score >= 80 THEN 'CRISE FORTE' WHEN score >= 60 THEN 'CRISE ÉLEVÉE' WHEN score >= 40 THEN 'CRISE MODÉRÉE'
      ELSE 'SIGNAL FAIBLE / BRUIT' END AS niveau,
 coalesce(dn.dominant_narrative, 'non identifié') AS dominant_narrative FROM f LEFT JOIN dn USING (period_id))"""

_LOWDOM = "lower(dominant_narrative)"
_PRIORITY = "CASE " + " ".join(f"WHEN score >= {t} THEN {q(x)}" for t, x in RU.PRIORITIES) + \
    f" ELSE {q(RU.PRIORITY_DEFAULT)} END"
_POSTURE = _rules_sql(_LOWDOM, RU.POSTURE_RULES,
                      f"CASE WHEN score >= 60 THEN {q(RU.POSTURE_HIGH)} ELSE {q(RU.POSTURE_DEFAULT)} END")
_SENSITIVE = ("list_concat([" + ", ".join(q(t) for t in RU.SENSITIVE_ALWAYS) + "], list_filter([" + ", ".join(
    f"CASE WHEN {_contains_any_sql(_LOWDOM, w)} THEN {q(t)} END" for w, t in RU.SENSITIVE_RULES)
    + "], lambda x: x IS NOT NULL))")


@register("strategy_rows", with_e_ctes(STRATEGY_CTES, f"""SELECT period_id, score, niveau, dominant_narrative,
 {_PRIORITY} AS priority, {_POSTURE} AS posture, array_to_string({_SENSITIVE}, '|') AS sensitive_points FROM st"""),
          "R5 dominant narrative, C7 priority, C8 posture, C13 sensitive points, per peak-day period")
def strategy_rows(spark, sf_dir):
    E, Ep = _periods(spark, sf_dir)
    return ST.strategy_rows(Ep, E).withColumn("sensitive_points", F.array_join("sensitive_points", "|"))


def pack_ctes(channels=DEFAULT_CHANNELS) -> str:
    """CTEs up to ``pg``: every period's messages with guardrail columns."""
    return STRATEGY_CTES + pack_parts(channels)


def pack_parts(channels=DEFAULT_CHANNELS) -> str:
    """CTEs behind those of the strategy."""
    values = ",\n ".join(f"({i}, {q(c)}, {q(t)})" for i, (c, t) in enumerate(CHANNEL_TEMPLATES)
                         if c in channels)
    text = ("replace(replace(replace(replace(template, '{spokesperson}', " + q(DEFAULT_SPOKESPERSON) + "), "
            "'{niveau}', niveau), '{score}', CAST(score AS VARCHAR)), '{dominant}', dominant_narrative)")
    return f""",
tp(channel_order, canal, template) AS (VALUES
 {values}),
pk AS (SELECT period_id, channel_order, canal, {text} AS text FROM st CROSS JOIN tp),
pg AS (SELECT period_id, channel_order, canal, text, {guardrail_sql('text')} FROM pk)"""


def _pack_sql() -> str:
    return with_e_ctes(pack_ctes(), "SELECT * FROM pg")


@register("message_pack", _pack_sql(),
          "R7 message pack: periods x channel templates (J4), substitution, then C14 guardrail")
def message_pack(spark, sf_dir):
    E, Ep = stored_periods(spark, sf_dir, *STRATEGY)
    return ST.message_pack(ST.strategy_rows(Ep, E))


ALL_CHANNELS = tuple(c for c, _ in CHANNEL_TEMPLATES)


@register("message_pack_all_channels", with_e_ctes(pack_ctes(ALL_CHANNELS), "SELECT * FROM pg"),
          "R7 message pack in all seven channels, each checked by C14")
def message_pack_all_channels(spark, sf_dir):
    E, Ep = stored_periods(spark, sf_dir, *STRATEGY)
    return ST.message_pack(ST.strategy_rows(Ep, E), ALL_CHANNELS)


_SCORES = """SELECT p.period_id, p.score AS crisis_score, crisis_level(p.score) AS niveau, crisis_priority(p.score) AS priority, n.narrative, n.messages,
  n.strategic_risk_score, narrative_risk_label(n.strategic_risk_score) AS risk_label, response_angle(n.narrative) AS angle_de_reponse,
  response_posture(n.narrative, p.score) AS posture
FROM (SELECT period_id, crisis_velocity_score(count(*), span_hours(min(dt), max(dt)), max(r.ref_messages), max(span_hours(r.ref_start, r.ref_end)), sum(reach),
        max(r.ref_reach), 100D * count_if(sentiment IN {negative}) / count(*), 100D * count_if(is_retweet) / count(*), avg(risk_level)) AS score
      FROM {posts} CROSS JOIN {span} r GROUP BY period_id) p
JOIN (SELECT x.period_id, narrative, count(*) AS messages, strategic_risk_score(100D * count(*) / max(n_posts), sum(reach), sum(shares),
        100D * count_if(sentiment IN {negative}) / count(*), avg(risk_level)) AS strategic_risk_score
      FROM (SELECT period_id, explode_outer(narratives) AS narrative, reach, shares, sentiment, risk_level FROM {posts}) x
      JOIN (SELECT period_id, count(*) AS n_posts FROM {posts} GROUP BY period_id) t ON t.period_id = x.period_id
      GROUP BY x.period_id, narrative) n ON n.period_id = p.period_id"""


def _scores_sql() -> str:
    from .q_narratives import _angle_sql, _label_sql
    from .report_sql import narratives_report_parts
    posture = _rules_sql("lower(narrative)", RU.POSTURE_RULES, f"CASE WHEN f.score >= 60 THEN {q(RU.POSTURE_HIGH)} ELSE {q(RU.POSTURE_DEFAULT)} END")
    return with_e_ctes(_CV_CTES + narratives_report_parts()[0], f"""SELECT f.period_id, f.score AS crisis_score,
 CASE WHEN f.score >= 80 THEN 'CRISE FORTE' WHEN f.score >= 60 THEN 'CRISE ÉLEVÉE' WHEN f.score >= 40 THEN 'CRISE MODÉRÉE' ELSE 'SIGNAL FAIBLE / BRUIT' END AS niveau,
 {_PRIORITY.replace('score', 'f.score')} AS priority, narrative, ys.messages, ys.score AS strategic_risk_score, {_label_sql('ys.score')} AS risk_label,
 {_angle_sql('narrative')} AS angle_de_reponse, {posture} AS posture FROM f JOIN ys USING (period_id)""")


@register("scores_sql", _scores_sql(), "X1, X2, C3, C4, C6, C7, C8 as SQL functions in a query written in SQL")
def scores_sql(spark, sf_dir):
    from ..config import NEGATIVE_SENTIMENTS
    from ..functions.sql_functions import register_sql_functions
    from ..operators.periods import corpus_span
    register_sql_functions(spark)
    E, Ep = stored_periods(spark, sf_dir, *STRATEGY, "risks")
    negative = "(" + ", ".join(q(x) for x in NEGATIVE_SENTIMENTS) + ")"
    return spark.sql(_SCORES.replace("{negative}", negative), posts=Ep, span=corpus_span(E))
