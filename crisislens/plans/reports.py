"""Report rows: one row of text (markdown / JSON) per period.

Every list that goes into a report is cut to its top-k *before* it is
collected into an array (``collect_list`` over at most k rows per period), so
a report row is bounded whatever the corpus size, and hundreds of periods
are reported by one job.  Numbers follow the reference formats: integers
with space thousands separators, ``%.1f`` with Python's exact rounding,
timestamps as ``YYYY-MM-DD HH:MM:SS[.ffffff]``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import texts as TX
from ..config import NEGATIVE_SENTIMENTS
from ..functions import rules as RU
from ..functions.numbers import fmt_py, format_int
from ..functions.text import shorten
from ..operators import narratives as N
from ..operators import strategy as ST
from ..operators.common import top_k
from .tables import PeriodTables, tables

BY = ("period_id",)
NL = "\n"


def ts_str(c: Column) -> Column:
    """Timestamp text as pandas prints it (microseconds only when non-zero)."""
    return F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd HH:mm:ss")) \
        .otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def s(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string")


def fill(template: str, **parts: Column) -> Column:
    """A text with its {names} replaced by columns."""
    return F.concat(*[parts[x] if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\{(\w+)\}", template)) if i % 2 or x])


def lines_per_group(df: DataFrame, line: Column, k: int | None, order: list[Column], by=BY,
                    name: str = "lines") -> DataFrame:
    """(by, array of ``line``) for the first ``k`` rows of each group."""
    ranked = top_k(df, order, k, by) if k is not None else top_k(df, order, None, by)
    g = ranked.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("rank"), line.alias("l")))).alias("_a"))
    return g.select(*by, F.transform("_a", lambda x: x["l"]).alias(name))


def _join_all(base: DataFrame, *parts: DataFrame, by=BY) -> DataFrame:
    out = base
    for p in parts:
        out = out.join(p, list(by), "left")
    return out


def _arr(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


# ---------------------------------------------------------------- R2 brief

def brief_rows(Ep: DataFrame | PeriodTables, E: DataFrame | None = None, top_n: int = 5) -> DataFrame:
    t = tables(Ep, E)
    k = t.kpis
    cv = t.velocity.select(*BY, "crisis_velocity_score", "niveau")
    narr = t.narratives
    order_n = [F.desc("count"), F.asc("narrative")]
    narr_lines = lines_per_group(narr, F.concat(
        F.lit("- "), F.col("narrative"), F.lit(" : "), format_int(F.col("count")), F.lit(" occurrences ("),
        fmt_py(F.col("pct_messages"), 1), F.lit("% des messages).")), top_n, order_n, name="narr_lines")
    dom = top_k(narr, order_n, 1, BY).select(*BY, F.col("narrative").alias("dominant"))
    sent = top_k(t.sentiments, [F.desc("count"), F.asc("sentiment")], 1, BY) \
        .select(*BY, F.col("sentiment").alias("dominant_sentiment"))
    ta = t.authors(top_n)
    author_lines = lines_per_group(ta, F.concat(
        F.lit("- @"), F.col("author"), F.lit(" : "), format_int(F.col("messages")), F.lit(" messages, reach "),
        format_int(F.col("reach")), F.lit(", shares "), format_int(F.col("shares")), F.lit(".")),
        None, [F.asc("rank")], name="author_lines")
    top_author = ta.where(F.col("rank") == 1).select(*BY, F.col("author").alias("top_author"))
    x = _join_all(k, cv, narr_lines, dom, sent, author_lines, top_author)
    text = F.concat_ws(NL, F.array_compact(F.concat(
        F.array(
            F.lit(TX.BRIEF_TITLE), F.lit(""),
            F.concat(F.lit("**Période analysée :** "), ts_str(F.col("debut")), F.lit(" → "), ts_str(F.col("fin"))),
            F.concat(F.lit("**Niveau estimé :** "), F.col("niveau")),
            F.concat(F.lit("**Crisis Velocity Score :** "), s("crisis_velocity_score"), F.lit("/100")),
            F.lit(""), F.lit("### 1. Chiffres clés"),
            F.concat(F.lit("- "), format_int(F.col("messages")), F.lit(" messages publiés par "),
                     format_int(F.col("auteurs_uniques")), F.lit(" auteurs uniques.")),
            F.concat(F.lit("- "), fmt_py(F.col("retweets_pct"), 1),
                     F.lit("% de retweets/reposts : la crise fonctionne surtout par amplification.")),
            F.concat(F.lit("- Reach cumulé estimé : "), format_int(F.col("reach")), F.lit(" ; impressions : "),
                     format_int(F.col("impressions")), F.lit(".")),
            F.concat(F.lit("- Sentiment négatif : "), fmt_py(F.col("sentiment_negatif_pct"), 1),
                     F.lit("% ; risque moyen : "), fmt_py(F.col("risk_moyen"), 2), F.lit("/5.")),
            F.lit(""), F.lit("### 2. Narratif dominant"),
            F.concat(F.lit("- Narratif principal détecté : **"),
                     F.coalesce(F.col("dominant"), F.lit(TX.NOT_IDENTIFIED)), F.lit("**."))),
        _arr("narr_lines"),
        F.array(F.lit(""), F.lit("### 3. Acteurs et amplification"),
                F.concat(F.lit("- Compte le plus influent sur la période : **@"),
                         F.coalesce(F.col("top_author"), F.lit(TX.NOT_IDENTIFIED)),
                         F.lit("** selon le score d'influence calculé."))),
        _arr("author_lines"),
        F.array(F.lit(""), F.lit("### 4. Lecture stratégique"), *[F.lit(t) for t in TX.BRIEF_STRATEGY],
                F.when(F.col("dominant_sentiment").isin(*NEGATIVE_SENTIMENTS),
                       F.lit(TX.BRIEF_NEGATIVE))),
    )))
    return x.select(*BY, "debut", "fin", "crisis_velocity_score", "niveau",
                    F.coalesce(F.col("dominant"), F.lit(TX.NOT_IDENTIFIED)).alias("dominant_narrative"),
                    F.coalesce(F.col("top_author"), F.lit(TX.NOT_IDENTIFIED)).alias("top_author"),
                    text.alias("brief"))


# ------------------------------------------------- R3 narratives / actors

def narratives_report(Ep: DataFrame | PeriodTables, bucket: str = "hour", top_n: int = 10) -> DataFrame:
    t = tables(Ep)
    rm = t.risks
    mat_lines = lines_per_group(rm, F.concat(
        F.lit("- **"), F.col("narrative"), F.lit("** : "), format_int(F.col("messages")), F.lit(" occurrences, "),
        s("pct_messages"), F.lit("% des messages, risque "), F.col("risk_label"), F.lit(" — "),
        F.col("angle_de_reponse")), 6, [F.asc("rank")], name="mat_lines")
    head = rm.where(F.col("rank") == 1).select(*BY, F.concat(
        F.lit("**Narratif prioritaire :** "), F.col("narrative"), F.lit(" — risque "), F.col("risk_label"),
        F.lit(" ("), s("strategic_risk_score"), F.lit("/100).")).alias("head"))
    actors = t.actors(top_n)
    act_lines = lines_per_group(actors, F.concat(
        F.lit("- @"), F.col("author"), F.lit(" porte surtout **"), F.col("narrative"), F.lit("** : "),
        format_int(F.col("messages")), F.lit(" messages, reach "), format_int(F.col("reach")), F.lit(".")),
        6, [F.asc("rank")], name="act_lines")
    mut = t.mutations(bucket)
    changes = lines_per_group(mut.where(F.col("mutation") != N.MUTATION_STABLE), F.concat(
        F.lit("- "), ts_str(F.col("period")), F.lit(" : passage de **"), F.col("previous"), F.lit("** vers **"),
        F.col("dominant_narrative"), F.lit("**.")), 5, [F.asc("period")], name="mut_lines")
    recs = N.recommendations(rm, BY)
    x = _join_all(head, mat_lines, act_lines, changes, recs)
    md = F.concat_ws(NL, F.concat(
        F.array(F.lit("## Agent 2 — Cartographie des narratifs et acteurs"), F.lit(""), F.col("head"), F.lit(""),
                F.lit("### Matrice narratifs")), _arr("mat_lines"),
        F.when(F.size(_arr("act_lines")) > 0,
               F.concat(F.array(F.lit(""), F.lit("### Acteurs par narratif")), _arr("act_lines")))
         .otherwise(F.array().cast("array<string>")),
        F.array(F.lit(""), F.lit("### Mutation narrative")),
        F.when(F.size(_arr("mut_lines")) > 0, _arr("mut_lines")).otherwise(F.array(F.lit(
            "- Pas de changement majeur du narratif dominant sur la période sélectionnée."))),
        F.array(F.lit(""), F.lit("### Recommandations Agent 2")),
        F.transform(_arr("recommendations"), lambda r: F.concat(F.lit("- "), r)),
    ))
    return x.select(*BY, md.alias("markdown"))


# ------------------------------------------------------ R4 propagation

def propagation_report(Ep: DataFrame | PeriodTables, top_n: int = 10) -> DataFrame:
    t = tables(Ep)
    prop, conc, copies, bursts, coord = t.propagation, t.concentration(top_n), t.copies, t.bursts, t.coordination(top_n)
    copy_lines = lines_per_group(copies, F.concat(
        F.lit("- Gabarit repris "), format_int(F.col("count")), F.lit(" fois par "), format_int(F.col("authors")),
        F.lit(" auteurs ; exemple : "), F.substring("example", 1, 140), F.lit("...")), 5, [F.asc("rank")],
        name="copy_lines")
    burst_lines = lines_per_group(bursts, F.concat(
        F.lit("- "), ts_str(F.col("hour")), F.lit(" : "), format_int(F.col("messages")), F.lit(" messages, "),
        fmt_py(F.col("retweet_pct"), 1), F.lit("% RT — "), F.col("burst_level"), F.lit(".")), 5, [F.asc("rank")],
        name="burst_lines")
    x = _join_all(prop, conc, coord, copy_lines, burst_lines)
    score_txt = F.when(F.col("score") >= 100, F.lit("100")).otherwise(s("score"))
    md = F.concat_ws(NL, F.concat(
        F.array(
            F.lit("## Agent 3 — Propagation et coordination prudente"), F.lit(""),
            F.concat(F.lit("**Score de coordination prudente :** "), score_txt, F.lit("/100 — "), F.col("label"),
                     F.lit(".")),
            F.concat(F.lit("_Prudence : "), F.col("prudence"), F.lit("_")), F.lit(""), F.lit("### Propagation"),
            F.concat(F.lit("- "), format_int(F.col("messages")), F.lit(" messages sur "), s("duration_hours"),
                     F.lit(" h, soit "), s("messages_per_hour"), F.lit(" messages/h en moyenne.")),
            F.concat(F.lit("- Pic horaire : "), format_int(F.col("peak_hour_messages")),
                     F.lit(" messages ; ratio d'accélération : ×"), s("acceleration_ratio"), F.lit(".")),
            F.concat(F.lit("- Retweets/reposts : "), s("retweet_pct"), F.lit("% ; auteurs uniques : "),
                     format_int(F.col("unique_authors")), F.lit(".")),
            F.lit(""), F.lit("### Concentration"),
            F.concat(F.lit("- Top comptes : "), s("top10_message_share_pct"), F.lit("% des messages, "),
                     s("top10_reach_share_pct"), F.lit("% du reach, "), s("top10_share_share_pct"),
                     F.lit("% des shares."))),
        F.when(F.size(_arr("copy_lines")) > 0,
               F.concat(F.array(F.lit(""), F.lit("### Copier-coller / gabarits")), _arr("copy_lines")))
         .otherwise(F.array().cast("array<string>")),
        F.when(F.size(_arr("burst_lines")) > 0,
               F.concat(F.array(F.lit(""), F.lit("### Pics horaires")), _arr("burst_lines")))
         .otherwise(F.array().cast("array<string>")),
        F.array(F.lit(""), F.lit("### Lecture opérationnelle")),
        F.transform(F.col("operational_reading"), lambda r: F.concat(F.lit("- "), r)),
    ))
    return x.select(*BY, "score", "label", md.alias("markdown"))


# ------------------------------------------------------- R6 strategy

def strategy_report(Ep: DataFrame | PeriodTables, E: DataFrame | None = None, posture: str | None = None, objective: str = TX.DEFAULT_OBJECTIVE,
                    targets: Sequence[str] = TX.DEFAULT_TARGETS) -> DataFrame:
    """One row per period: the strategy's fields, its lists as columns, and the text."""
    t = tables(Ep, E)
    st = t.strategy(posture)
    k = t.kpis.select(*BY, "debut", "fin", "messages", "retweets_pct")
    x = st.join(k, list(BY), "left")
    axes = [F.lit(f"- **{a}** — {b} {c}") for a, b, c in TX.MESSAGE_AXES]
    plan = [F.lit(f"- **{t} — {a} :** {d}") for t, a, d in TX.ACTION_PLAN]
    md = F.concat_ws(NL, F.array(
        F.lit("## Agent 4 — Stratégie de riposte"), F.lit(""),
        F.concat(F.lit("**Période source :** "), ts_str(F.col("debut")), F.lit(" → "), ts_str(F.col("fin"))),
        F.concat(F.lit("**Niveau :** "), F.col("niveau"), F.lit(" — score "), s("score"), F.lit("/100")),
        F.concat(F.lit("**Priorité :** "), F.col("priority")),
        F.lit(f"**Objectif :** {objective}"),
        F.concat(F.lit("**Posture recommandée :** "), F.col("posture")),
        F.lit("**Cibles :** " + ", ".join(targets)),
        F.lit(""), F.lit("### Diagnostic stratégique"),
        F.concat(F.lit("- Messages analysés : "), format_int(F.col("messages")), F.lit(" ; retweets/reposts : "),
                 fmt_py(F.col("retweets_pct"), 1), F.lit("%.")),
        F.concat(F.lit("- Le narratif dominant détecté est : "), F.col("dominant_narrative"), F.lit(".")),
        F.lit("- Le risque prioritaire est la perte de contrôle du cadrage public, plus que la simple correction "
              "d'un fait."),
        F.lit(""), F.lit("### Axes de réponse"), *axes,
        F.lit(""), F.lit("### Plan d'action"), *plan,
        F.lit(""), F.lit("### À éviter absolument"), *[F.lit(f"- {t}") for t in TX.AVOID],
        F.lit(""), F.lit("### Déclencheurs d'escalade"), *[F.lit(f"- {t}") for t in TX.ESCALATION_TRIGGERS],
    ))
    texts = lambda items: F.array(*[F.lit(t) for t in items])
    return x.select(*BY, "score", "niveau", "dominant_narrative", "priority", "posture", "sensitive_points",
                    md.alias("markdown"), F.lit(objective).alias("objectif"), texts(targets).alias("cibles"),
                    _axes().alias("axes"), _plan().alias("plan_action"), texts(TX.AVOID).alias("a_eviter"),
                    texts(TX.RISKS_IF_SILENT).alias("risques_silence"),
                    texts(TX.RISKS_IF_OVERREACTING).alias("risques_sur_reaction"),
                    texts(TX.ESCALATION_TRIGGERS).alias("declencheurs"))


def _axes() -> Column:
    return F.array(*[F.struct(F.lit(a).alias("axe"), F.lit(b).alias("but"), F.lit(c).alias("formulation"))
                     for a, b, c in TX.MESSAGE_AXES])


def _plan() -> Column:
    return F.array(*[F.struct(F.lit(t).alias("temps"), F.lit(a).alias("action"), F.lit(d).alias("détail"))
                     for t, a, d in TX.ACTION_PLAN])


# ------------------------------------------------------ R7 message pack

def pack_report(Ep: DataFrame | PeriodTables, E: DataFrame | None = None, tone: str = TX.DEFAULT_TONE,
                spokesperson: str = TX.DEFAULT_SPOKESPERSON,
                channels: Sequence[str] = ST.DEFAULT_CHANNELS) -> DataFrame:
    pack = ST.message_pack(tables(Ep, E).strategy(), channels, spokesperson=spokesperson)
    msgs = lines_per_group(pack, F.concat_ws(NL, F.concat(F.lit("### "), F.col("canal")), F.col("text"), F.lit("")),
                           None, [F.asc("channel_order")], name="msg_blocks")
    checks = lines_per_group(pack, F.concat(F.lit("- **"), F.col("canal"), F.lit("** : "), F.col("statut"),
                                            F.lit(" — "), F.col("risques_detectés"), F.lit(".")),
                             None, [F.asc("channel_order")], name="check_lines")
    x = msgs.join(checks, list(BY), "left")
    md = F.concat_ws(NL, F.concat(
        F.array(F.lit("## Agent 5 — Messages rédigés + garde-fou"), F.lit(""), F.lit(f"**Ton :** {tone}"),
                F.lit(f"**Porte-parole :** {spokesperson}"), F.lit("")),
        _arr("msg_blocks"), F.array(F.lit("### Garde-fou")), _arr("check_lines"),
        F.array(F.lit(""), F.lit(TX.PACK_FINAL_RULE))))
    return x.select(*BY, md.alias("markdown"))


# ------------------------------------------- R5 / R8 / K7 JSON contexts

def crisis_context(Ep: DataFrame | PeriodTables, E: DataFrame | None = None, max_posts: int = 5, max_rows: int = 8) -> DataFrame:
    """(period_id, context): one typed struct per period with the period's
    bounds, KPIs, score, level, dominant narrative, top author, top-8
    narratives, top-8 authors, top-5 posts (each cut before it is collected)
    and the brief."""
    t = tables(Ep, E)
    k = t.kpis
    brief = brief_rows(t).select(*BY, "crisis_velocity_score", "niveau", "dominant_narrative", "top_author", "brief")
    narr = _records(t.narratives, max_rows, [F.desc("count"), F.asc("narrative")],
                    ["narrative", "count", "pct_messages"], "narratives")
    authors = t.authors(max_rows)
    posts = t.top_posts(max_posts).withColumn("dt", ts_str(F.col("dt")))

    def listed(df: DataFrame, name: str) -> DataFrame:
        cols = [c for c in df.columns if c not in (*BY, "rank")]
        g = df.groupBy(*BY).agg(F.sort_array(F.collect_list(F.struct("rank", *cols))).alias("_r"))
        return g.select(*BY, F.transform("_r", lambda r: r.dropFields("rank")).alias(name))

    x = _join_all(k, brief, narr, listed(authors, "top_authors"), listed(posts, "top_posts"))
    kp = [c for c in k.columns if c not in (*BY, "debut", "fin")]
    return x.select(*BY, F.struct(
        F.struct(ts_str(F.col("debut")).alias("start"), ts_str(F.col("fin")).alias("end")).alias("periode"),
        F.struct(*kp).alias("kpis"), F.col("crisis_velocity_score").alias("score"), "niveau", "dominant_narrative",
        "top_author", "narratives", "top_authors", "top_posts", F.col("brief").alias("brief_agent1")).alias("context"))


def context_json(Ep: DataFrame | PeriodTables, E: DataFrame | None = None, max_posts: int = 5, max_rows: int = 8) -> DataFrame:
    """The crisis context of each period as JSON text."""
    return crisis_context(Ep, E, max_posts, max_rows).select(*BY, F.to_json("context").alias("context_json"))


# ----------------------------------------------------------- R9 answers

def answers(questions: DataFrame, Ep: DataFrame | PeriodTables, E: DataFrame | None = None, text_col: str = "question",
            keys: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """Deterministic answers: every question routed (C15), then the sections
    of the matching reports of its period filled in.  ``questions`` carries
    ``period_id``; the per-period report rows it joins are bounded."""
    t = tables(Ep, E)
    brief = brief_rows(t).select(*BY, "debut", "fin", "crisis_velocity_score", "niveau", "dominant_narrative")
    kp = t.kpis.select(*BY, "messages", "auteurs_uniques", "retweets_pct", "sentiment_negatif_pct")
    rm = t.risks
    a2 = lines_per_group(rm, fill(TX.ANSWER_NARRATIVE_LINE, narratif=F.col("narrative"), messages=s("messages"), score=s("strategic_risk_score"),
                                  angle=F.col("angle_de_reponse")), 5, [F.asc("rank")], name="a2_lines")
    a3 = propagation_report(t).select(*BY, F.col("score").alias("coord_score"), F.col("label").alias("coord_label"),
                                       F.col("markdown").alias("a3_md"))
    prop = t.propagation
    prop_json = prop.select(*BY, F.to_json(F.struct(*[
        (ts_str(F.col(c)) if c in ("start", "end") else F.col(c)).alias(c) for c in prop.columns if c not in BY]))
        .alias("prop_json"))
    a4 = strategy_report(t).select(*BY, "priority", "posture", F.col("markdown").alias("a4_md"))
    a5 = pack_report(t).select(*BY, F.col("markdown").alias("a5_md"))
    ctx = _join_all(brief, kp, a2, a3, prop_json, a4, a5)
    known = F.col("niveau").isNotNull()
    na = F.lit(TX.NOT_AVAILABLE)
    route = F.col("_route")
    srcs = [*(r[0] for r in RU.ROUTES), RU.ROUTE_FALLBACK]
    # sections are made once a period and routes once a question, in front of the join
    sections_by_source = [fill(
        text, debut=ts_str(F.col("debut")), fin=ts_str(F.col("fin")), niveau=F.col("niveau"), score=s("crisis_velocity_score"),
        messages=format_int(F.col("messages")), auteurs=format_int(F.col("auteurs_uniques")), retweets=fmt_py(F.col("retweets_pct"), 1),
        negatif=fmt_py(F.col("sentiment_negatif_pct"), 1), dominant=F.col("dominant_narrative"), narratifs=F.array_join(_arr("a2_lines"), ""),
        coordination=F.when(F.col("coord_score") >= 100, F.lit("100")).otherwise(s("coord_score")), label=F.col("coord_label"),
        metriques=F.substring("prop_json", 1, 900), rapport3=shorten(F.col("a3_md"), 1600), priorite=F.col("priority"), posture=F.col("posture"),
        rapport4=shorten(F.col("a4_md"), 2200), rapport5=shorten(F.col("a5_md"), 2600)) for text in TX.ANSWER_SECTIONS]
    per_period = ctx.select(*BY, *[F.when(known, sec).otherwise(na).alias(f"_section{i}") for i, sec in enumerate(sections_by_source)])
    # one row per period on this side; a hot period is a skewed key, which AQE splits
    x = questions.withColumn("_route", RU.route_question(F.col(text_col))).join(per_period, list(BY), "left")
    sections = F.array_compact(F.array(*[F.when(F.array_contains(route, src), F.coalesce(F.col(f"_section{i}"), na)) for i, src in enumerate(srcs)]))
    answer = F.when(F.size(route) == 0, F.lit(TX.ANSWER_EMPTY)).otherwise(F.concat(
        F.concat_ws("\n\n", sections), F.lit(TX.ANSWER_SOURCES_PREFIX), F.concat_ws(", ", route), F.lit(".")))
    return x.select(*keys, *BY, F.array_join(route, "|").alias("sources"), answer.alias("answer"),
                    F.lit("déterministe").alias("mode"))


# ------------------------------------------------ R8 full agent context

def _records(df: DataFrame, k: int, order: list[Column], cols: list[str], name: str) -> DataFrame:
    """(period_id, array of the first ``k`` rows as structs) - bounded."""
    ranked = top_k(df, order, k, BY)
    g = ranked.groupBy(*BY).agg(F.sort_array(F.collect_list(F.struct("rank", *cols))).alias("_r"))
    return g.select(*BY, F.transform("_r", lambda r: r.dropFields("rank")).alias(name))


def agent_context(Ep: DataFrame | PeriodTables, E: DataFrame | None = None) -> DataFrame:
    """Per period, the context every answer draws on, as one JSON document:
    diagnosis, narratives, propagation, strategy, messages, source priority.
    Every list is cut before it is collected.  The strategy keys read by the
    answering step (priority messages, action plan, risks) are filled from
    the response axes, the action plan and the two risk lists."""
    t = tables(Ep, E)
    base = crisis_context(t).select(*BY, F.col("context").alias("agent1"))
    a2 = _join_all(
        narratives_report(t).select(*BY, shorten(F.col("markdown"), 3600).alias("markdown")),
        _records(t.risks, 8, [F.asc("rank")], ["narrative", "messages", "pct_messages", "strategic_risk_score",
                                               "risk_label", "angle_de_reponse"], "risk_matrix"),
        _records(t.actors(10), 8, [F.asc("rank")],
                 ["author", "narrative", "messages", "reach", "actor_narrative_score"], "actor_narratives"),
        _records(t.mutations().withColumn("period", ts_str(F.col("period"))), 8, [F.asc("period")],
                 ["period", "dominant_narrative", "messages", "previous", "mutation"], "mutation_signals"),
        N.recommendations(t.risks, BY))
    prop, copies, coord = t.propagation, t.copies, t.coordination()
    bursts = t.bursts.withColumn("hour", ts_str(F.col("hour")))
    a3 = _join_all(
        propagation_report(t).select(*BY, shorten(F.col("markdown"), 3600).alias("markdown")),
        coord.select(*BY, F.struct(*[c for c in coord.columns if c not in BY]).alias("coordination_score")),
        prop.select(*BY, F.struct(*[F.col(c) for c in prop.columns if c not in BY]).alias("propagation_metrics")),
        _records(bursts, 8, [F.asc("rank")], ["hour", "messages", "zscore", "retweet_pct", "burst_level"],
                 "burst_patterns"),
        _records(copies, 8, [F.asc("rank")], ["fingerprint", "count", "authors", "example"], "copy_patterns"))
    risks = F.struct(F.array(*[F.lit(x) for x in TX.RISKS_IF_SILENT]).alias("silence"),
                     F.array(*[F.lit(x) for x in TX.RISKS_IF_OVERREACTING]).alias("sur_reaction"))
    a4 = strategy_report(t).select(
        *BY, shorten(F.col("markdown"), 4200).alias("markdown"), "priority", "posture",
        _axes().alias("messages_prioritaires"), _plan().alias("plan_action"), risks.alias("risques"),
        F.array(*[F.lit(x) for x in TX.AVOID]).alias("avoid"))
    pack = ST.message_pack(t.strategy())
    msgs = pack.groupBy(*BY).agg(
        F.map_from_entries(F.collect_list(F.struct("canal", "text"))).alias("messages"),
        F.sort_array(F.collect_list(F.struct("channel_order", "canal", "statut", "risques_detectés",
                                             "points_à_renforcer", "longueur_caractères"))).alias("_g"))
    a5 = pack_report(t).select(*BY, shorten(F.col("markdown"), 5200).alias("markdown")).join(
        msgs.select(*BY, "messages", F.slice(F.transform("_g", lambda r: r.dropFields("channel_order")), 1, 12)
                    .alias("guardrail")), list(BY), "left")
    ctx = _join_all(base, _nest(a2, "agent2_narratifs"), _nest(a3, "agent3_propagation"),
                    _nest(a4, "agent4_strategie"), _nest(a5, "agent5_redaction"))
    doc = F.struct(F.col("agent1").alias("agent1_diagnostic"), "agent2_narratifs", "agent3_propagation",
                   "agent4_strategie", "agent5_redaction",
                   F.array(*[F.lit(x) for x in TX.SOURCE_PRIORITY]).alias("source_priority"))
    return ctx.select(*BY, F.to_json(doc).alias("agent_context"))


def _nest(df: DataFrame, name: str) -> DataFrame:
    return df.select(*BY, F.struct(*[c for c in df.columns if c not in BY]).alias(name))
