"""Readers for raw post tables (CSV, Parquet, JSON) and the enriched corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from functools import reduce

SNIFF_DELIMITERS = (",", ";", "\t", "|")
DATA_EXCLUDE_WORDS = ("dictionnaire", "bdd")


def _options(reader, recursive: bool, glob: str | None):
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", glob) if glob else reader


def file_facts(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None) -> list[dict]:
    """One entry per CSV file: path, encoding, separator, header line, and whether a value spans lines.

    One distributed pass over the raw lines; what reaches the driver is a row
    per file.  A file is UTF-8 if all its lines are valid, else Latin-1.  A
    line with an odd number of quotes opens or closes a value of several lines.
    """
    lines = _options(spark.read, recursive, glob).text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    header = F.hex(F.min_by(F.col("value").cast("binary"), F.when(F.col("block") == 0, F.col("at"))))
    facts = lines.groupBy("path").agg(F.min(F.expr("is_valid_utf8(value)")).alias("utf8"), F.max(quotes % 2).alias("odd"), header.alias("header"))
    out = []
    for r in facts.where("header IS NOT NULL").collect():
        encoding = "UTF-8" if r["utf8"] else "ISO-8859-1"
        line = bytes.fromhex(r["header"]).decode(encoding).lstrip("\ufeff").rstrip("\r")
        counts = {d: line.count(d) for d in SNIFF_DELIMITERS}
        best = max(SNIFF_DELIMITERS, key=lambda d: counts[d])
        # UTF-8 files are comma files unless their header has no comma at all
        sep = "," if not counts[best] or (r["utf8"] and counts[","]) else best
        out.append({"path": r["path"], "encoding": encoding, "sep": sep, "header": line, "multiline": bool(r["odd"])})
    return sorted(out, key=lambda f: f["path"])


def read_csv_files(spark: SparkSession, facts: list[dict], multiline: bool | None = None) -> DataFrame:
    """Files of one header, encoding and separator are read together; the groups are united by column name.

    ``multiline`` makes a file one task, so by default only files with a value of
    several lines are read that way, apart from the rest of their group.
    """
    groups: dict[tuple, list[dict]] = {}
    for f in facts:
        groups.setdefault((f["header"], f["encoding"], f["sep"], f["multiline"] if multiline is None else multiline), []).append(f)
    parts = []
    for (_, encoding, sep, whole), files in groups.items():
        parts.append(spark.read.option("header", "true").option("multiLine", str(whole).lower()).option("escape", '"')
                     .option("encoding", encoding).option("sep", sep).option("inferSchema", "false").csv([f["path"] for f in files]))
    if not parts:
        raise ValueError("no CSV file found")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_dataset(spark: SparkSession, path: str, fmt: str | None = None, recursive: bool = False,
                 glob: str | None = None, multiline: bool | None = None) -> DataFrame:
    """Read a raw post table; every CSV column stays a string.

    A directory is read whole, optionally filtered by ``glob``; encoding,
    separator and header are those of each file.
    """
    kind = (fmt or path.rsplit(".", 1)[-1]).lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("json", "jsonl"):
        return spark.read.json(path)
    if kind in ("xlsx", "xls"):
        raise ValueError("Excel files are not read by the engine; convert to CSV or Parquet first")
    return read_csv_files(spark, file_facts(spark, path, recursive, glob), multiline)


def read_data_directory(spark: SparkSession, root: str, glob: str = "*.csv", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Read every data file under ``root`` (recursively), leaving out data
    dictionaries (file names containing one of ``DATA_EXCLUDE_WORDS``) and files
    with one of ``exclude`` in their path below ``root``."""
    facts = file_facts(spark, root, True, glob)
    below = lambda f: f["path"].rsplit(root.rstrip("/").rsplit("/", 1)[-1] + "/", 1)[-1].lower()
    left_out = lambda f: any(w in below(f).rsplit("/", 1)[-1] for w in DATA_EXCLUDE_WORDS) or any(w in below(f) for w in exclude)
    return read_csv_files(spark, [f for f in facts if not left_out(f)])
