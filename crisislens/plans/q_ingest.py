"""Queries: reading mixed CSV files, messy values, and export bundles that are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import periods as P
from ..operators.enrich import enrich
from ..session import checkpoint_root, delete, shuffles_released
from ..sources.fixtures import POSTS_MAPPING, raw_posts
from ..sources.readers import read_data_directory
from .oracle import with_e_ctes
from .q_periods import PERIOD_CTES
from .registry import corpus, register
from .tables import PeriodTables


def _folder(spark, name: str) -> str:
    master = spark.sparkContext.master
    root = checkpoint_root(spark, allow_local=master.startswith("local") and not master.startswith("local-cluster"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _csv(df: DataFrame, path: str, sep: str, encoding: str) -> None:
    df.write.options(header=True, sep=sep, encoding=encoding, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


SHARE_BYTES = 8 << 30            # text in the CSV files of one share


def _shares(spark, sf_dir: str) -> int:
    """How many shares the posts are written and read in, so that the files of one have about SHARE_BYTES, whatever the corpus."""
    posts = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    mean = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.avg(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-int(posts * mean) // SHARE_BYTES))


def _write_mixed(posts: DataFrame, path: str) -> None:
    """A folder with comma files in UTF-8, semicolon files in Latin-1 with other column orders, and a dictionary."""
    spark = posts.sparkSession
    posts = posts.select("post_id", F.date_format("dt", "yyyy-MM-dd HH:mm:ss").alias("Date"), F.col("author_src").alias("Author"), F.col("full_text").alias("Full Text"))
    latin = posts["Full Text"].rlike(r"^[\x00-\xFF]*$") & (F.col("post_id") % 2 == 0)
    with shuffles_released(spark):
        _csv(posts.where(~latin), f"{path}/utf8", ",", "UTF-8")
        _csv(posts.where(latin).select("Author", "Full Text", "Date", "post_id"), f"{path}/latin", ";", "ISO-8859-1")
        _csv(spark.createDataFrame([("Author", "who wrote")], "field string, meaning string").coalesce(1), f"{path}/dictionary", ",", "UTF-8")


@register("ingest_csv_mixed", """SELECT post_id, strftime(dt, '%Y-%m-%d %H:%M:%S') AS dt, author, n_chars, text_md5 FROM (
 SELECT post_id, date_trunc('second', dt) AS dt, author_src AS author, length(full_text) AS n_chars, md5(full_text) AS text_md5 FROM (""" + __import__(
    "crisislens.sources.fixtures", fromlist=["raw_posts_sql"]).raw_posts_sql() + "))",
          "S1, S2 a folder of CSV files with two encodings, separators and column orders, and a dictionary that is no data")
def ingest_csv_mixed(spark, sf_dir):
    path, n = _folder(spark, "mixed-csv"), _shares(spark, sf_dir)
    for i in range(n):
        _write_mixed(raw_posts(spark, sf_dir, (i, n)), f"{path}/{i}")
        got = read_data_directory(spark, f"{path}/{i}", exclude=("dictionary",))
        got = got.select(F.col("post_id").cast("bigint").alias("post_id"), F.col("Date").alias("dt"), F.coalesce("Author", F.lit("")).alias("author"),
                         F.length("Full Text").cast("bigint").alias("n_chars"), F.md5("Full Text").alias("text_md5"))
        if n == 1:
            return got
        got.write.mode("append").parquet(f"{path}/read")
        delete(spark, f"{path}/{i}")
    return spark.read.parquet(f"{path}/read")


# What an export tool makes of numbers: by post id, blanks, separators, words, missing values.
def _dirty(c: str) -> F.Column:
    n, x = F.col("post_id") % 7, F.col(c).cast("string")
    return F.when(n == 0, F.concat(F.lit("  "), x, F.lit(" "))).when(n == 1, F.format_number(F.col(c) * 1000, 0)).when(n == 2, F.lit("n/a")).when(n == 3, F.lit(None)) \
        .when(n == 4, F.lit("NaN")).when(n == 5, F.concat(F.lit("+"), x)).otherwise(F.concat(x, F.lit("d")))


def _clean_sql(c: str) -> str:
    return f"CASE post_id % 7 WHEN 0 THEN {c} WHEN 1 THEN CASE WHEN {c} * 1000 >= 1000 THEN 0.0 ELSE {c} * 1000 END WHEN 5 THEN {c} ELSE 0.0 END AS {c}"


@register("ingest_dirty", with_e_ctes("", f"""SELECT post_id, date_trunc('second', dt) AS dt, CAST(date_trunc('hour', dt) AS TIMESTAMP) AS hour,
 {_clean_sql('likes')}, {_clean_sql('shares')}, {_clean_sql('reach')} FROM e WHERE post_id % 13 <> 0"""),
          "P1 day-first text dates with bad ones, P8 numbers with blanks, separators, words and gaps")
def ingest_dirty(spark, sf_dir):
    posts = raw_posts(spark, sf_dir)
    date = F.when(F.col("post_id") % 13 == 0, F.lit("hier")).otherwise(F.date_format("dt", "dd/MM/yyyy HH:mm:ss"))
    messy = posts.withColumns({"dt": date, **{c: _dirty(c) for c in ("likes", "shares", "reach")}})
    return enrich(messy, POSTS_MAPPING, with_risk=False, day_first=True).select("post_id", "dt", "hour", "likes", "shares", "reach")


_TOP = lambda key, n: f"(SELECT sum(least({n}, c)) FROM (SELECT period_id, count(DISTINCT {key}) AS c FROM ep GROUP BY period_id))"


def _bundle_sql() -> str:
    from .q_reports import _propagation_parts
    narr = "(SELECT period_id, unnest(narratives) AS narrative, author, hour FROM ep)"
    pairs = f"(SELECT count(*) FROM (SELECT DISTINCT period_id, narrative FROM {narr}))"
    tags = "(SELECT unnest(hashtags_list) AS h FROM e)"
    rows = {
        ("analysis", "agent1_analyse_rapport.md"): "5", ("analysis", "agent1_analyse_top_authors.csv"): _TOP("author", 10),
        ("analysis", "agent1_analyse_top_hashtags.csv"): "(SELECT sum(least(10, c)) FROM (SELECT period_id, count(DISTINCT h) AS c FROM (SELECT period_id, unnest(hashtags_list) AS h FROM ep) GROUP BY period_id))",
        ("analysis", "agent1_analyse_top_posts.csv"): _TOP("post_id", 10), ("analysis", "agent1_analyse_narratives.csv"): pairs,
        ("analysis", "agent1_analyse_hourly_timeline.csv"): "(SELECT count(*) FROM (SELECT DISTINCT period_id, hour FROM ep))",
        ("global", "timeline_journaliere.csv"): "(SELECT count(DISTINCT day) FROM e)", ("global", "timeline_horaire.csv"): "(SELECT count(DISTINCT hour) FROM e)",
        ("global", "pics_journaliers_detectes.csv"): "(SELECT least(10, count(DISTINCT day)) FROM e)", ("global", "pics_horaires_detectes.csv"): "(SELECT least(20, count(DISTINCT hour)) FROM e)",
        ("global", "narratifs_globaux.csv"): "(SELECT count(DISTINCT n) FROM (SELECT unnest(narratives) AS n FROM e))",
        ("global", "top_50_auteurs_influence.csv"): "(SELECT least(50, count(DISTINCT author)) FROM e)", ("global", "top_50_hashtags.csv"): f"(SELECT least(50, count(DISTINCT h)) FROM {tags})",
        ("narratives", "agent2_matrice_narratifs.csv"): pairs, ("narratives", "agent2_risk_matrix.csv"): pairs,
        ("narratives", "agent2_timeline_narratifs.csv"): f"(SELECT count(*) FROM (SELECT DISTINCT period_id, hour, narrative FROM {narr}))",
        ("narratives", "agent2_acteurs_par_narratif.csv"): f"(SELECT sum(least(10, c)) FROM (SELECT period_id, count(*) AS c FROM (SELECT DISTINCT period_id, author, narrative FROM {narr}) GROUP BY period_id))",
        ("narratives", "agent2_mutations_narratives.csv"): "(SELECT count(*) FROM (SELECT DISTINCT period_id, hour FROM ep))",
        ("narratives", "agent2_narratifs_acteurs.md"): "5", ("narratives", "agent2_resume.json"): "5",
        ("propagation", "agent3_copier_coller_gabarits.csv"): "(SELECT count(*) FROM xcp)", ("propagation", "agent3_pics_horaires.csv"): _TOP("hour", 12),
        ("propagation", "agent3_top_comptes_concentration.csv"): _TOP("author", 10), ("propagation", "agent3_propagation_coordination.md"): "5", ("propagation", "agent3_resume.json"): "5",
        ("strategy", "agent5_gardefou.csv"): "25", ("strategy", "agent4_strategie_riposte.md"): "5", ("strategy", "agent5_messages_gardefou.md"): "5",
        ("strategy", "agent4_strategie_riposte.json"): "5", ("strategy", "agent5_messages.json"): "5",
        ("corpus", "corpus_enrichi"): "(SELECT count(*) FROM e)"}
    return with_e_ctes(PERIOD_CTES + _propagation_parts()[0], " UNION ALL ".join(
        f"SELECT '{b}' AS bundle, '{t}' AS \"table\", CAST({n} AS BIGINT) AS rows, true AS read_back" for (b, t), n in rows.items()))


@register("export_bundles", _bundle_sql(), "K1-K6 the export bundles: written, published by a manifest, read back and counted")
def export_bundles(spark, sf_dir):
    from . import sinks as SK
    from .analysis import analysis_of, period_posts
    root = _folder(spark, "bundles")
    # the published corpus, by date, is what the other bundles read: one enrichment, written once
    SK.export_corpus_bundle(corpus(spark, sf_dir), f"{root}/corpus")
    _, E = SK.read_bundle(spark, f"{root}/corpus")["corpus_enrichi"]
    Ep = period_posts(E, P.peak_day_periods(E, top=5))
    t = PeriodTables(Ep, E, keep=True)
    SK.export_analysis(analysis_of(t), f"{root}/analysis")
    SK.export_global_tables(E, f"{root}/global")
    SK.export_narratives(t, f"{root}/narratives")
    SK.export_propagation(t, f"{root}/propagation")
    SK.export_strategy(t, None, f"{root}/strategy")
    out = None
    for bundle in SK.published(spark, root):
        for name, (n, df) in SK.read_bundle(spark, f"{root}/{bundle}").items():
            row = df.agg(F.count(F.lit(1)).alias("c")).select(F.lit(bundle).alias("bundle"), F.lit(name).alias("table"), F.lit(n).cast("bigint").alias("rows"), (F.col("c") == n).alias("read_back"))
            out = row if out is None else out.unionAll(row)
    return out
