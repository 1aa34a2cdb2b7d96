"""Sinks: Parquet for the enriched corpus, CSV / JSON for report tables.

Tables are written by the executors as part files under a directory.  Only
tables the caller declares *bounded* (top-k tables, one row per period) are
coalesced to one part; the corpus never is.  CSV has no arrays or structs,
so those columns are written as JSON text.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import metrics as M
from ..operators import narratives as N
from ..operators import propagation as PR
from ..operators import strategy as ST
from ..operators import timeline as TL
from ..session import cluster_for_write, shuffles_released
from . import reports as RP
from .tables import PeriodTables, store

BY = ("period_id",)

# Columns of the enriched-corpus export, in order.
CORPUS_EXPORT_COLUMNS = (
    "dt", "author", "engagement_type", "sentiment", "likes", "comments", "shares", "reach", "impressions",
    "is_retweet", "is_reply", "is_quote", "is_original", "main_narrative", "narratives", "risk_level",
    "text_raw", "text_norm",
)


def csv_safe(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs become JSON text so CSV can hold them."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f"`{f.name}`")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def write_table(df: DataFrame, path: str, fmt: str = "csv", bounded: bool = False,
                partition_by: list[str] | None = None, mode: str = "overwrite") -> str:
    out = csv_safe(df) if fmt == "csv" else df
    if bounded:
        out = out.coalesce(1)
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    with shuffles_released(df.sparkSession):
        if fmt == "csv":
            w.option("header", "true").option("escape", '"').csv(path)
        elif fmt == "json":
            w.json(path)
        elif fmt == "parquet":
            w.option("compression", "zstd").parquet(path)
        else:
            raise ValueError(f"unknown format {fmt}")
    return path


MAX_FILES = 20_000               # files of a corpus by date, before its rows are clustered by a shuffle


def by_date(E: DataFrame) -> DataFrame:
    """``E`` as it is written by ``date``.

    Each task writes a file for every date it meets, so whole texts stay where they
    are: a shuffle would put all of them on disk once more.  Only if that made more
    than MAX_FILES files are rows clustered by date ranges first.
    """
    tasks = int(E.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dates = E.select("date").distinct().count()
    return E if dates * tasks <= MAX_FILES else cluster_for_write(E, "date", "post_id")


def export_corpus(E: DataFrame, out_dir: str, fmt: str = "parquet") -> str:
    """Enriched corpus: Parquet partitioned by ``date`` (period filters then
    prune files), or the 18-column CSV export."""
    if fmt == "parquet":
        return write_table(by_date(E), os.path.join(out_dir, "corpus_enrichi"), "parquet", partition_by=["date"])
    cols = [c for c in CORPUS_EXPORT_COLUMNS if c in E.columns]
    return write_table(E.select(*cols), os.path.join(out_dir, "corpus_enrichi_csv"), "csv")


def export_tables(tables: dict[str, DataFrame], out_dir: str, fmt: str = "csv") -> dict[str, str]:
    """Write bounded report tables (one directory each, one part file)."""
    return {name: write_table(df, os.path.join(out_dir, name), fmt, bounded=True) for name, df in tables.items()}


def write_text(df: DataFrame, column: str, path: str) -> str:
    """One text file of a one-column report (a row per period)."""
    with shuffles_released(df.sparkSession):
        df.select(F.col(column).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


# ---------------------------------------------------------------- bundles

MANIFEST = "manifest.json"


def _counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _publish(spark: SparkSession, out_dir: str, rows: dict[str, int]) -> None:
    """The manifest: what makes a bundle visible, written when all its tables are."""
    spark.createDataFrame(list(rows.items()), "name string, rows bigint").coalesce(1).write.mode("overwrite").json(os.path.join(out_dir, MANIFEST))


def _bundle(out_dir: str, tables: dict[str, DataFrame], texts: dict[str, tuple[DataFrame, str]],
            documents: dict[str, DataFrame]) -> dict[str, str]:
    """Tables as CSV, texts as .md, other rows as JSON lines, each under its file name, then the manifest.

    Rows are counted while they are written.  A bundle that fails half way has no
    manifest, nor has one that is being written anew.
    """
    parts = {f"{n}.csv": (df, None) for n, df in tables.items()} | {f"{n}.md": x for n, x in texts.items()} | {f"{n}.json": (df, None) for n, df in documents.items()}
    spark = next(iter(parts.values()))[0].sparkSession
    _publish(spark, out_dir, {"": -1})                   # an older manifest no longer counts
    out, rows = {}, {}
    for i, (name, (df, column)) in enumerate(parts.items()):
        counted, seen = _counted(df, f"{name}-{i}")
        path = os.path.join(out_dir, name)
        out[name] = write_text(counted, column, path) if column else write_table(counted, path, name.rsplit(".", 1)[-1], bounded=True)
        rows[name] = seen.get["rows"]
    _publish(spark, out_dir, rows)
    return out


def _manifest(spark: SparkSession, out_dir: str) -> dict[str, int]:
    """Rows by table of a published bundle; empty without a manifest that counts."""
    try:
        rows = spark.read.schema("name string, rows bigint").json(os.path.join(out_dir, MANIFEST)).collect()     # a row a table
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {} if any(r["rows"] is None or r["rows"] < 0 for r in rows) else {r["name"]: r["rows"] for r in rows}


def published(spark: SparkSession, root: str) -> list[str]:
    """The bundles under a folder that are whole."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root).select("path")
    folders = found.where(F.col("path").contains(f"/{MANIFEST}/")).select(F.element_at(F.split(F.regexp_replace("path", f"/{MANIFEST}/.*$", ""), "/"), -1).alias("b")).distinct()
    return sorted(r["b"] for r in folders.collect() if _manifest(spark, os.path.join(root, r["b"])))


def read_bundle(spark: SparkSession, out_dir: str) -> dict[str, tuple[int, DataFrame]]:
    """(rows, table) by name of a whole bundle; any other is an error."""
    rows = _manifest(spark, out_dir)
    if not rows:
        raise ValueError(f"no whole bundle at {out_dir}")

    def read(name: str) -> DataFrame:
        path = os.path.join(out_dir, name)
        if name.endswith(".csv"):
            return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
        if name.endswith(".md"):                         # a report of many lines a period, told apart by its title
            return spark.read.text(path).where(F.col("value").startswith("## "))
        return spark.read.json(path) if name.endswith(".json") else spark.read.parquet(path)

    return {name: (n, read(name)) for name, n in rows.items()}


def export_corpus_bundle(E: DataFrame, out_dir: str) -> dict[str, str]:
    """The enriched corpus as a bundle of one Parquet table."""
    spark = E.sparkSession
    _publish(spark, out_dir, {"": -1})
    counted, seen = _counted(by_date(E), "corpus")
    path = write_table(counted, os.path.join(out_dir, "corpus_enrichi"), "parquet", partition_by=["date"])
    _publish(spark, out_dir, {"corpus_enrichi": seen.get["rows"]})
    return {"corpus_enrichi": path}


def export_analysis(analysis: dict[str, DataFrame], out_dir: str, prefix: str = "agent1_analyse") -> dict[str, str]:
    """The period analysis of ``analysis.analyze_periods``: the report and five tables."""
    names = ("top_authors", "top_hashtags", "top_posts", "narratives", "hourly_timeline")
    return _bundle(out_dir, {f"{prefix}_{n}": analysis[n] for n in names}, {f"{prefix}_rapport": (analysis["brief_deterministe"], "brief")}, {})


GLOBAL_COLUMNS = ("dt", "day", "hour", "author", "is_retweet", "likes", "shares", "reach", "impressions", "engagement_total", "followers", "risk_level",
                  "narratives", "hashtags_list")


def export_global_tables(E: DataFrame, out_dir: str) -> dict[str, str]:
    """Seven tables of the whole corpus, from one stored set of narrow columns."""
    E = store(E.select(*GLOBAL_COLUMNS), "global-columns")
    days, hours = store(TL.daily_timeline(E), "days"), store(TL.hourly_timeline(E), "hours")
    return _bundle(out_dir, {
        "timeline_journaliere": days, "timeline_horaire": hours,
        "pics_journaliers_detectes": TL.peaks(days, "day", 10), "pics_horaires_detectes": TL.peaks(hours, "hour", 20),
        "narratifs_globaux": M.narratives_table(E), "top_50_auteurs_influence": M.top_authors(E, 50),
        "top_50_hashtags": M.top_hashtags(E, 50)}, {}, {})


def _kept(Ep: DataFrame | PeriodTables, E: DataFrame | None = None) -> PeriodTables:
    """Per-period tables that are written once, as a bundle reads them again in its reports."""
    return Ep if isinstance(Ep, PeriodTables) else PeriodTables(Ep, E, keep=True)


def export_narratives(Ep: DataFrame | PeriodTables, out_dir: str, top_n: int = 10) -> dict[str, str]:
    """Narratives and actors of each period: five tables, the report, a summary."""
    t = _kept(Ep)
    return _bundle(out_dir, {
        "agent2_matrice_narratifs": t.risks.drop("angle_de_reponse"), "agent2_timeline_narratifs": N.narrative_timeline(t.posts, "hour", BY),
        "agent2_acteurs_par_narratif": t.actors(top_n), "agent2_risk_matrix": t.risks,
        "agent2_mutations_narratives": t.mutations()},
        {"agent2_narratifs_acteurs": (RP.narratives_report(t), "markdown")}, {"agent2_resume": N.recommendations(t.risks, BY)})


def export_propagation(Ep: DataFrame | PeriodTables, out_dir: str, top_n: int = 10) -> dict[str, str]:
    """Propagation of each period: three tables, the report, a summary."""
    t = _kept(Ep)
    summary = t.propagation.join(t.concentration(top_n), list(BY)).join(t.coordination(top_n), list(BY))
    return _bundle(out_dir, {
        "agent3_copier_coller_gabarits": t.copies, "agent3_pics_horaires": t.bursts,
        "agent3_top_comptes_concentration": PR.concentration_table(t.posts, top_n, BY)},
        {"agent3_propagation_coordination": (RP.propagation_report(t), "markdown")}, {"agent3_resume": summary})


def export_strategy(Ep: DataFrame | PeriodTables, E: DataFrame | None, out_dir: str) -> dict[str, str]:
    """Strategy and messages of each period: both reports, the strategy and the messages as JSON, the guard-rail table."""
    t = _kept(Ep, E)
    strategy, pack = RP.strategy_report(t), ST.message_pack(t.strategy())
    guard = pack.drop("text")
    messages = pack.groupBy(*BY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("canal", "text")))).alias("messages"))
    return _bundle(out_dir, {"agent5_gardefou": guard},
                   {"agent4_strategie_riposte": (strategy, "markdown"), "agent5_messages_gardefou": (RP.pack_report(t), "markdown")},
                   {"agent4_strategie_riposte": strategy.drop("markdown"), "agent5_messages": messages})
