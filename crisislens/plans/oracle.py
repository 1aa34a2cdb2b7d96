"""DuckDB SQL twins of the engine's plans (the correctness oracle).

These strings are written independently of the DataFrame code; only the
fixed values (lexicon, labels, regex classes) are shared, so a wrong
operator shows up as a hash mismatch.  Dialect notes: RE2 regexes,
``'g'`` for global replace, ``lambda x: ...`` list lambdas, ``round_even``.
"""

from __future__ import annotations

from collections.abc import Sequence

from .. import config as C
from ..functions.text import NON_SPACE, SPACE, WORD, alternation
from ..operators.enrich import narrative_flag_name
from ..sources.fixtures import raw_posts_sql


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + SPACE + '+|' + SPACE + '+$')}, '', 'g')"


def _tokens(x: str, sigil: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(sigil + WORD + '+')})"


def _in_list(values: Sequence[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def enriched_ctes(lexicon: Sequence[C.Narrative] = C.DEFAULT_LEXICON) -> str:
    """CTEs ``raw``, ``pre`` and ``e`` (the enriched corpus) for DuckDB."""
    flags = ",\n  ".join(
        f"regexp_matches(text_norm, {q(alternation(n.patterns))}) AS {narrative_flag_name(n.label)}"
        for n in lexicon)
    labels = ", ".join(f"CASE WHEN {narrative_flag_name(n.label)} THEN {q(n.label)} END" for n in lexicon)
    sensitive = " + ".join(f"CAST({narrative_flag_name(n.label)} AS INTEGER)" for n in lexicon if n.sensitive) or "0"
    author = f"regexp_replace({_trim('coalesce(author_src, ' + q(C.DEFAULT_AUTHOR) + ')')}, '^@+', '')"
    return f"""raw AS ({raw_posts_sql()}
),
pre0 AS (
 SELECT post_id, dt,
  CAST(dt AS DATE) AS date,
  CAST(CAST(dt AS DATE) AS TIMESTAMP) AS day,
  date_trunc('hour', dt) AS hour,
  CAST(hour(dt) AS INTEGER) AS hour_of_day,
  strftime(CAST(dt AS DATE) - CAST(isodow(dt) - 1 AS INTEGER), '%Y-%m-%d') || '/' ||
    strftime(CAST(dt AS DATE) - CAST(isodow(dt) - 1 AS INTEGER) + 6, '%Y-%m-%d') AS week,
  coalesce(full_text, '') AS text_raw,
  lower(strip_accents(coalesce(full_text, ''))) AS text_norm,
  {author} AS author0,
  coalesce(likes, 0.0) AS likes, coalesce(comments, 0.0) AS comments, coalesce(shares, 0.0) AS shares,
  coalesce(impressions, 0.0) AS impressions, coalesce(reach, 0.0) AS reach,
  coalesce(followers, 0.0) AS followers, CAST(0.0 AS DOUBLE) AS following, CAST(0.0 AS DOUBLE) AS x_posts,
  upper({_trim("coalesce(engagement_src, 'ORIGINAL')")}) AS engagement_type,
  repost_src IS NOT NULL AS reposted,
  lower({_trim("coalesce(sentiment_src, 'unknown')")}) AS sentiment
 FROM raw WHERE dt IS NOT NULL
),
pre1 AS (
 SELECT * EXCLUDE (author0, reposted),
  CASE WHEN author0 = '' THEN 'unknown' ELSE author0 END AS author,
  likes + comments + shares AS engagement_total,
  (regexp_matches(engagement_type, {q(C.RETWEET_TYPE_PATTERN)}) OR reposted OR starts_with(text_raw, 'RT ')) AS is_retweet,
  regexp_matches(engagement_type, {q(C.REPLY_TYPE_PATTERN)}) AS is_reply,
  regexp_matches(engagement_type, {q(C.QUOTE_TYPE_PATTERN)}) AS is_quote,
  list_sort(list_distinct({_tokens('text_raw', '#')})) AS hashtags_list,
  list_sort(list_distinct({_tokens('text_raw', '@')})) AS mentions_list,
  {flags}
 FROM pre0
),
pre AS (
 SELECT *, NOT (is_retweet OR is_reply OR is_quote) AS is_original,
  array_to_string(hashtags_list, ' ') AS hashtags_joined,
  CASE WHEN len(list_filter([{labels}], lambda x: x IS NOT NULL)) = 0 THEN [{q(C.DEFAULT_NARRATIVE)}]
       ELSE list_filter([{labels}], lambda x: x IS NOT NULL) END AS narratives
 FROM pre1
),
p95 AS (SELECT quantile_cont(reach, {C.REACH_QUANTILE}) AS reach_p95 FROM pre),
e AS (
 SELECT pre.*, narratives[1] AS main_narrative,
  CAST(least(5, greatest(1, round_even(
     1.0 + {sensitive}
     + CASE WHEN sentiment IN {_in_list(C.NEGATIVE_SENTIMENTS)} THEN 1.0 ELSE 0.0 END
     + CASE WHEN is_retweet THEN 0.5 ELSE 0.0 END
     + CASE WHEN coalesce(p95.reach_p95, 0) <> 0 AND reach >= p95.reach_p95 THEN 1.0 ELSE 0.0 END, 0))) AS INTEGER)
   AS risk_level
 FROM pre CROSS JOIN p95
)"""


def with_e_ctes(ctes: str, select: str, lexicon: Sequence[C.Narrative] = C.DEFAULT_LEXICON) -> str:
    """Enriched-corpus CTEs, then extra CTEs, then the final SELECT."""
    extra = (",\n" + ctes) if ctes.strip() else ""
    return "WITH " + enriched_ctes(lexicon) + extra + "\n" + select


FINGERPRINT_SQL = (
    "substr(" + _trim(
        f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text_raw), "
        f"{q('https?://' + NON_SPACE + '+')}, ' URL ', 'g'), {q('@' + WORD + '+')}, ' @user ', 'g'), "
        f"{q('#' + WORD + '+')}, ' #tag ', 'g'), {q(SPACE + '+')}, ' ', 'g')") + ", 1, 220)"
)
