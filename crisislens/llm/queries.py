"""The registered queries of the corpus operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, decontaminate, filter_audit, fingerprints, html_extract, language_id, ngram_join, quality_fm, secret_scan, suffix_dedup, token_counts, url_filter

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"

# The rules of the URL query, (verdict, host, path).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
MIRROR_HOSTS = 2                 # the URL query lists paths that so many hosts or more serve


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; workers started from now on find this package even if it is not installed."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key, n: int):
    """crc32 of the key as text, modulo n."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.cluster(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(remainder("doc_id", 4) != 2))
    out = language_id.classify(docs, model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """The blocklist: URLs of mirrored paths, which MIRROR_HOSTS or more hosts serve; home pages are none."""
    u = F.col("url")
    placed = pages.select("url", F.regexp_replace(url_filter.url_host(u), r"^www\.", "").alias("_h"), F.regexp_replace(url_filter.url_path(u), "/+$", "").alias("_p")).where("_p <> ''")
    mirrored = placed.select("_p", "_h").distinct().groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIRROR_HOSTS).select("_p")
    return placed.join(mirrored, "_p", "left_semi").select("url")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, listed_urls(pages), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def quality_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, quality) of the rows that labels may be learned from."""
    usable = labels.where(remainder("doc_id", 5) != 0).select("doc_id", "quality")
    return docs.select("doc_id", "text").join(usable, "doc_id")


def op8_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_fm.fit(quality_labels(docs, table(spark, sf_dir, "labels")))
    return quality_fm.score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


# The five filters of the audit query, as what makes a document fail.
AUDIT_FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 3 * n_chars",
    "D": "has_symbol",
    "E": filter_audit.REPEATED,
}


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), AUDIT_FILTERS, table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_language_id": op2_language_id,
    "op3_html_extract": op3_html_extract,
    "op4_fingerprints": op4_fingerprints,
    "op5_url_filter": op5_url_filter,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_fm": op8_quality_fm,
    "op9_decontaminate": op9_decontaminate,
    "op10_secret_scan": op10_secret_scan,
    "op11_filter_audit": op11_filter_audit,
    "op12_collocations": op12_collocations,
    "op13_token_counts": op13_token_counts,
}

# words: A-Z in lower case, split at space, tab, LF, VT, FF and CR; the shingles of a text as a set
SHINGLES_SQL = """
{name}_words AS (
  SELECT {key} AS k, list_filter_empty AS w FROM (
    SELECT {key}, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS list_filter_empty FROM {source})),
{name}_sh AS (
  SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS s FROM (
    SELECT k, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM {name}_words)),
{name}_n AS (SELECT k, count(*) AS n FROM {name}_sh GROUP BY k)"""

OP1_SQL = "WITH RECURSIVE " + SHINGLES_SQL.format(name="d", key="doc_id", source="documents") + """,
pairs AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM d_sh a JOIN d_sh b ON a.s = b.s AND a.k <> b.k GROUP BY a.k, b.k),
links AS (SELECT p.a, p.b FROM pairs p JOIN d_n x ON x.k = p.a JOIN d_n y ON y.k = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
reach(a, b) AS (SELECT k, k FROM d_words UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.k AS doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id
FROM d_words d LEFT JOIN d_n n ON n.k = d.k JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.k"""

OP9_SQL = "WITH " + SHINGLES_SQL.format(name="d", key="doc_id", source="documents") + "," + SHINGLES_SQL.format(name="b", key="item_id", source="benchmark") + """,
met AS (SELECT d.k AS doc_id, b.k AS item_id, count(*) AS c FROM d_sh d JOIN b_sh b ON d.s = b.s GROUP BY d.k, b.k)
SELECT x.doc_id, x.item_id, n.n AS n_item, x.c AS n_shared, x.c / n.n AS containment
FROM met x JOIN b_n n ON n.k = x.item_id WHERE 100 * x.c >= 75 * n.n"""

_FITS = {h + p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in URL_RULES}
_LONGEST = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
OP5_SQL = f"""WITH parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_replace(regexp_replace(regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS query
  FROM pages),
canon AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS c FROM parts),
placed AS (SELECT c, regexp_replace(host, '^www\\.', '') AS h, regexp_replace(path, '/+$', '') AS p FROM canon WHERE regexp_replace(path, '/+$', '') <> ''),
listed AS (SELECT DISTINCT c FROM placed WHERE c IS NOT NULL AND p IN (SELECT p FROM placed GROUP BY p HAVING count(DISTINCT h) >= {MIRROR_HOSTS}))
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_FITS[h + p]} THEN '{h + p}'" for _, h, p in _LONGEST)} END AS rule,
  CASE {" ".join(f"WHEN {_FITS[h + p]} THEN '{v}'" for v, h, p in _LONGEST)}
    WHEN EXISTS (SELECT 1 FROM listed l WHERE l.c = canon.c) THEN 'block' ELSE 'allow' END AS verdict,
  EXISTS (SELECT 1 FROM listed l WHERE l.c = canon.c) AS listed
FROM canon"""

OP11_SQL = r"""WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM w GROUP BY t),
said AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, false)::BIGINT AS good, coalesce(toxic, false)::BIGINT AS toxic,
    (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first_id, false)::INT AS mask
  FROM w JOIN firsts USING (t) LEFT JOIN said ON said.doc_id = w.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, mask),
f(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM f p, f q, f r, f s, f t
  WHERE p.b + q.b + r.b + s.b + t.b = 31 AND (p.b | q.b | r.b | s.b | t.b) = 31),
steps AS (SELECT filter_order, i::INT AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM orders, range(1, 6) AS x(i)),
sums AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM sums"""

OP12_SQL = r"""WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
f AS (
  SELECT lang, m, p, count(*) AS c FROM (
    SELECT lang, 1 AS m, unnest(w) AS p FROM pieces
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM pieces
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM pieces)
  GROUP BY lang, m, p),
totals AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, p, c, string_split(p, ' ') AS w FROM f WHERE m > 1 AND c >= 10),
cuts AS (SELECT lang, m, p, c AS a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM cand, range(1, 3) AS t(k) WHERE k < m),
rated AS (
  SELECT cuts.*, fx.c AS l, fy.c AS r, ((1000000::HUGEINT * a * a) // (fx.c::HUGEINT * fy.c))::BIGINT AS score
  FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.p = x JOIN f fy ON fy.lang = cuts.lang AND fy.p = y),
cut AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (
  SELECT lang, q, max(c) AS most FROM (
    SELECT lang, w[1] || ' ' || w[2] AS q, c FROM cand WHERE m = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], c FROM cand WHERE m = 3)
  GROUP BY lang, q),
kept AS (SELECT cut.* FROM cut LEFT JOIN longer ON longer.lang = cut.lang AND longer.q = cut.p WHERE most IS NULL OR 100 * most < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept)
SELECT ranked.lang, rank, p AS phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

ORACLE: dict[str, str] = {
    "op12_collocations": OP12_SQL,
    "op11_filter_audit": OP11_SQL,
    "op5_url_filter": OP5_SQL,
    "op9_decontaminate": OP9_SQL,
    "op1_ngram_join": OP1_SQL,
}
