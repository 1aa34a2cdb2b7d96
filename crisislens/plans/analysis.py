"""The tables of one or many periods, computed from one stored set of posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import timeline as TL
from ..operators.periods import assign_periods, peak_day_period
from .reports import brief_rows
from .tables import PeriodTables, store

BY = ("period_id",)


def period_posts(E: DataFrame, periods: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The posts of every period, written once, so that many tables share one pass over the texts (folded texts are left out).

    With ``columns`` only these are worked out and written; see ``tables.read_by``.  A post is written once for each period that holds it; for many overlapping
    periods see ``operators.segments``."""
    Ep = assign_periods(E.drop("text_norm"), periods.select("period_id", "start", "end"))
    return store(Ep if columns is None else Ep.select(*BY, *columns), "period-posts")


def analyze_periods(E: DataFrame, periods: DataFrame, top_n: int = 10) -> dict[str, DataFrame]:
    """The analysis of each period, by table name; every table has ``period_id``.

    A period without any post is an error.
    """
    periods = store(periods.select("period_id", "start", "end"), "periods")
    Ep = period_posts(E, periods)
    seen = Ep.select("period_id").distinct()
    empty = periods.select("period_id").distinct().join(seen, "period_id", "left_anti").orderBy("period_id").limit(5).collect()
    if empty:
        raise ValueError("no post in period " + ", ".join(r["period_id"] for r in empty))
    return analysis_of(PeriodTables(Ep, E), top_n)


def analysis_of(t: PeriodTables, top_n: int = 10) -> dict[str, DataFrame]:
    """The analysis from per-period tables."""
    Ep = t.posts
    return {
        "periode": t.kpis.select(*BY, F.col("debut").alias("start"), F.col("fin").alias("end")),
        "kpis": t.kpis,
        "crisis_velocity_score": t.velocity,
        "top_authors": t.authors(top_n),
        "top_hashtags": M.top_hashtags(Ep, top_n, BY),
        "top_posts": t.top_posts(top_n),
        "narratives": t.narratives,
        "sentiments": t.sentiments,
        "engagement_types": M.engagement_type_table(Ep, BY),
        "hourly_timeline": TL.hourly_timeline(Ep, BY),
        "period_data": Ep,
        "brief_deterministe": brief_rows(t),
    }


def analyze_peak_day(E: DataFrame, rank: int = 1, top_n: int = 10) -> dict[str, DataFrame]:
    """The analysis of the ``rank``-th busiest day; a rank beyond the days is an error."""
    return analyze_periods(E, peak_day_period(E, rank), top_n)
