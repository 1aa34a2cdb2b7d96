"""DuckDB twin of the narratives report (per period)."""

from __future__ import annotations

import re

from ..config import NEGATIVE_SENTIMENTS
from ..functions.text import SHORTENED, SPACE
from ..operators import narratives as N
from .oracle import q, with_e_ctes
from .q_narratives import _angle_sql, _label_sql
from .q_periods import PERIOD_CTES
from .registry import sln1p, spct, sround_py

_NL = "chr(10)"
_NEG = "(" + ", ".join(q(x) for x in NEGATIVE_SENTIMENTS) + ")"

_SCORE = """least(25.0, share * 0.45)
   + CASE WHEN r > 0 THEN least(20.0, ln(1 + r) / 18 * 20) ELSE 0.0 END
   + CASE WHEN s > 0 THEN least(15.0, ln(1 + s) / 10 * 15) ELSE 0.0 END
   + least(20.0, neg * 0.20) + least(20.0, (risk / 5) * 20)"""


def _fint(x: str) -> str:
    return f"replace(format('{{:,}}', CAST(round_even(CAST({x} AS DOUBLE), 0) AS BIGINT)), ',', ' ')"


def _ts(x: str) -> str:
    us = f"(epoch_us({x}) % 1000000)"
    return (f"(strftime({x}, '%Y-%m-%d %H:%M:%S') || CASE WHEN {us} = 0 THEN '' "
            f"ELSE '.' || lpad(CAST({us} AS VARCHAR), 6, '0') END)")


def narratives_report_sql() -> str:
    ctes, select = narratives_report_parts()
    return with_e_ctes(PERIOD_CTES + ctes, select)


def narratives_report_parts() -> tuple[str, str]:
    """(CTEs behind those of the periods, select)."""
    n = _NL
    ctes = f""",
yx AS (SELECT period_id, unnest(narratives) AS narrative, reach, shares, sentiment, is_retweet, risk_level FROM ep),
yn AS (SELECT period_id, count(*) AS n_posts FROM ep GROUP BY period_id),
yg AS (SELECT period_id, narrative, count(*) AS messages, sum(reach) AS r, sum(shares) AS s,
   count_if(sentiment IN {_NEG}) AS ng, avg(risk_level) AS risk FROM yx GROUP BY period_id, narrative),
yh AS (SELECT yg.*, {spct('messages', 'n_posts')} AS share, {spct('ng', 'messages')} AS neg
   FROM yg JOIN yn USING (period_id)),
ys AS (SELECT *, {sround_py(_SCORE, 1)} AS score FROM yh),
ym AS (SELECT period_id, narrative, messages, {sround_py('share', 1)} AS pct, score, {_label_sql('score')} AS lbl,
   {_angle_sql('narrative')} AS angle,
   row_number() OVER (PARTITION BY period_id ORDER BY score DESC, messages DESC, narrative) AS rank FROM ys),
ymat AS (SELECT period_id, string_agg('- **' || narrative || '** : ' || {_fint('messages')} || ' occurrences, ' ||
   CAST(pct AS VARCHAR) || '% des messages, risque ' || lbl || ' — ' || angle, {n} ORDER BY rank) AS lines,
   max(CASE WHEN rank = 1 THEN '**Narratif prioritaire :** ' || narrative || ' — risque ' || lbl || ' (' ||
       CAST(score AS VARCHAR) || '/100).' END) AS head,
   string_agg(CASE WHEN rank <= 4 THEN '- ' || narrative || ' : ' || angle || '.' END, {n} ORDER BY rank) AS recs
   FROM ym WHERE rank <= 6 GROUP BY period_id),
ya AS (SELECT period_id, author, narrative, count(*) AS messages, sum(reach) AS reach, sum(shares) AS shares,
   sum(likes) AS likes FROM (SELECT period_id, author, unnest(narratives) AS narrative, reach, shares, likes FROM ep)
   GROUP BY period_id, author, narrative),
yas AS (SELECT *, row_number() OVER (PARTITION BY period_id ORDER BY {sln1p('reach')} * 0.35 + {sln1p('shares')} * 0.30
   + {sln1p('likes')} * 0.20 + {sln1p('messages')} * 0.15 DESC, author, narrative) AS rank FROM ya),
yal AS (SELECT period_id, string_agg('- @' || author || ' porte surtout **' || narrative || '** : ' ||
   {_fint('messages')} || ' messages, reach ' || {_fint('reach')} || '.', {n} ORDER BY rank) AS lines
   FROM yas WHERE rank <= 6 GROUP BY period_id),
yt AS (SELECT period_id, hour, narrative, count(*) AS messages FROM (SELECT period_id, hour, unnest(narratives)
   AS narrative FROM ep) GROUP BY period_id, hour, narrative),
yd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period_id, hour ORDER BY messages DESC, narrative)
   AS r FROM yt) WHERE r = 1),
yl AS (SELECT *, lag(narrative) OVER (PARTITION BY period_id ORDER BY hour) AS prev FROM yd),
ych AS (SELECT *, row_number() OVER (PARTITION BY period_id ORDER BY hour) AS k FROM yl
   WHERE prev IS NOT NULL AND prev <> narrative),
ymu AS (SELECT period_id, string_agg('- ' || {_ts('hour')} || ' : passage de **' || prev || '** vers **' ||
   narrative || '**.', {n} ORDER BY hour) AS lines FROM ych WHERE k <= 5 GROUP BY period_id)"""
    no_change = q("- Pas de changement majeur du narratif dominant sur la période sélectionnée.")
    return ctes, (f"""SELECT ymat.period_id,
 '## Agent 2 — Cartographie des narratifs et acteurs' || {n} || {n} || head || {n} || {n} ||
 '### Matrice narratifs' || {n} || ymat.lines ||
 coalesce({n} || {n} || '### Acteurs par narratif' || {n} || yal.lines, '') ||
 {n} || {n} || '### Mutation narrative' || {n} || coalesce(ymu.lines, {no_change}) ||
 {n} || {n} || '### Recommandations Agent 2' || {n} || recs || {n} || {q('- ' + N.REC_LAST)} AS markdown
FROM ymat LEFT JOIN yal USING (period_id) LEFT JOIN ymu USING (period_id)""")


def fill_sql(template: str, **parts: str) -> str:
    """A text with its {names} replaced by SQL expressions."""
    return " || ".join(parts[x] if i % 2 else q(x) for i, x in enumerate(re.split(r"\{(\w+)\}", template)) if i % 2 or x)


def shorten_sql(x: str, limit: int) -> str:
    t = f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"
    cut = f"regexp_replace(substr({t}, 1, {limit}), '{SPACE}+$', '')"
    return f"(CASE WHEN length({t}) <= {limit} THEN {t} ELSE {cut} || {q(SHORTENED)} END)"
