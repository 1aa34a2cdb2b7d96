"""Registry of named queries: a Spark builder and (when SQL can say it) the
DuckDB oracle statement producing the same columns.

Presentation rule shared by both sides: non-integer doubles are rounded
half-even at 6 decimals, arrays are joined with '|', ranks are BIGINT, so
an order-insensitive value hash can compare the engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import round_even
from ..operators.enrich import enrich
from ..sources.fixtures import POSTS_MAPPING, raw_posts


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, covers: str):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = Query(name, fn, sql, covers)
        return fn
    return deco


def corpus(spark: SparkSession, sf_dir: str, with_risk: bool = True) -> DataFrame:
    """Enriched corpus of the posts derived from the driver tables."""
    return enrich(raw_posts(spark, sf_dir), POSTS_MAPPING, with_risk=with_risk)


# --- presentation, Spark side -------------------------------------------------

def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return round_even(c.cast("double"), 6)


def joined(c: str) -> Column:
    return F.array_join(F.col(c), "|")


def present(df: DataFrame, round_cols: tuple[str, ...] = ()) -> DataFrame:
    """Round the listed doubles and make ``rank`` a BIGINT."""
    out = []
    for c in df.columns:
        if c in round_cols:
            out.append(r6(c).alias(c))
        elif c == "rank":
            out.append(F.col(c).cast("bigint").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# --- presentation, SQL side ---------------------------------------------------

def sr6(x: str) -> str:
    return f"(round_even(CAST({x} AS DOUBLE) * CAST(1000000 AS DOUBLE), 0) / CAST(1000000 AS DOUBLE))"


def spct(part: str, total: str) -> str:
    return f"(CASE WHEN {total} = 0 THEN 0.0 ELSE CAST(100 AS DOUBLE) * {part} / {total} END)"


def sround_py(x: str, digits: int) -> str:
    """DuckDB twin of ``round_py`` (same double arithmetic)."""
    s = f"CAST({10 ** digits} AS DOUBLE)"
    v = f"CAST({x} AS DOUBLE)"
    p = f"({v} * {s})"
    big = f"({v} * CAST(134217729 AS DOUBLE))"
    hi = f"({big} - ({big} - {v}))"
    lo = f"({v} - {hi})"
    err = f"(({hi} * {s} - {p}) + {lo} * {s})"
    f = f"CAST(floor({p}) AS DOUBLE)"
    return (f"((CASE WHEN {p} - {f} = 0.5 THEN (CASE WHEN {err} > 0 THEN {f} + 1 WHEN {err} < 0 THEN {f} "
            f"ELSE round_even({p}, 0) END) ELSE round_even({p}, 0) END) / {s})")


def sln1p(x: str) -> str:
    return f"ln(1 + greatest(CAST({x} AS DOUBLE), 0))"
