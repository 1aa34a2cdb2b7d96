"""Periods: slicing the corpus into any number of [start, end] windows in one
job, peak-day periods, and the crisis velocity score of each period against
the whole corpus.

A ``periods`` table has ``period_id string, start timestamp_ntz, end
timestamp_ntz``; both bounds are inclusive and either may be null (open).
Periods may overlap: a post then belongs to each of them.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import round_even, round_py
from .metrics import kpis
from .timeline import daily_timeline, peaks

PERIOD_SCHEMA = "period_id string, start timestamp_ntz, end timestamp_ntz"


def periods_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Small helper to declare periods from Python values."""
    return spark.createDataFrame(rows, PERIOD_SCHEMA)


def corpus_span(E: DataFrame) -> DataFrame:
    """One row: first and last post time, count and total reach of the corpus."""
    return E.agg(F.min("dt").alias("ref_start"), F.max("dt").alias("ref_end"),
                 F.count(F.lit(1)).alias("ref_messages"), F.sum("reach").alias("ref_reach"))


KNOWN_PERIODS = 1000             # rows of a period table that the driver holds at most
KNOWN_DAYS = 1000                # days in a filter at most
BROADCAST_DAYS = 100_000         # (period, day) rows sent to every executor at most


def _days_of(known: list) -> tuple[list, int] | None:
    """The days that closed periods touch, and the days of all periods together; None if the former are too many for a filter."""
    days: set = set()
    pairs = 0
    for r in known:
        n = (r["end"].date() - r["start"].date()).days + 1
        if n > KNOWN_DAYS:
            return None
        days |= {r["start"].date() + timedelta(days=i) for i in range(n)}
        pairs += max(n, 0)
        if len(days) > KNOWN_DAYS:
            return None
    return sorted(days), pairs


def assign_periods(E: DataFrame, periods: DataFrame) -> DataFrame:
    """E rows tagged with every period that contains them (inclusive bounds).

    Each period is expanded to the days it touches (open bounds clamp to the
    corpus span), then joined to posts on ``date`` with the exact bounds as a
    residual condition: an equi-join, so thousands of periods cost one hash
    probe per post-day instead of a nested loop.  Up to ``BROADCAST_DAYS``
    expanded rows of known periods are broadcast, so posts stay where they are: a
    shuffle by ``date`` would send whole texts to as many tasks as there are
    days.  Else the planner broadcasts the expanded side if its measured size
    allows, or shuffles both sides (AQE splits a hot day).

    The days that the periods touch are also a plain filter on ``date``: it goes
    below the text work of a corpus that is still being enriched, so the texts of
    other days are not read.  Period tables of more than ``KNOWN_PERIODS`` rows, or
    that touch more than ``KNOWN_DAYS`` days, are only joined.
    """
    known = periods.select("period_id", "start", "end").limit(KNOWN_PERIODS + 1).collect()
    few = len(known) <= KNOWN_PERIODS and all(t == "timestamp_ntz" for c, t in periods.dtypes if c in ("start", "end"))
    if few:                                  # the periods' own plan (peaks, say) is not run again
        periods = E.sparkSession.createDataFrame([tuple(r) for r in known], periods.select("period_id", "start", "end").schema)
        has_open = any(r["start"] is None or r["end"] is None for r in known)
    else:
        has_open = not periods.where(F.col("start").isNull() | F.col("end").isNull()).isEmpty()
    touched = _days_of(known) if few and not has_open else None
    if touched is not None:
        E = E.where(E["date"].isin(touched[0]))
    if has_open:
        span = corpus_span(E).select("ref_start", "ref_end")
        periods = periods.crossJoin(F.broadcast(span)).withColumns({
            "start": F.coalesce(F.col("start"), F.col("ref_start")),
            "end": F.coalesce(F.col("end"), F.col("ref_end"))})
    p = periods.select("period_id", F.col("start").alias("p_start"), F.col("end").alias("p_end")) \
        .where(F.col("p_start") <= F.col("p_end"))
    days = p.select(
        "period_id", "p_start", "p_end",
        F.explode(F.sequence(F.to_date("p_start"), F.to_date("p_end"), F.expr("INTERVAL 1 DAY"))).alias("p_date"),
    )
    if touched is not None and touched[1] <= BROADCAST_DAYS:
        days = F.broadcast(days)
    # Keyed on ``date``, the partition column of a materialized corpus, so a
    # small side also prunes the corpus files (dynamic partition pruning).
    joined = E.join(days, (E["date"] == days["p_date"]) & (E["dt"] >= days["p_start"]) & (E["dt"] <= days["p_end"]))
    return joined.drop("p_date", "p_start", "p_end")


def peak_day_periods(E: DataFrame, top: int = 5, prefix: str = "peak_day_") -> DataFrame:
    """The ``top`` busiest days as periods [day 00:00:00, day 23:59:59]
    (whole seconds, so a post in the last sub-second of a day is outside)."""
    pk = peaks(daily_timeline(E), "day", top)
    return pk.select(
        F.concat(F.lit(prefix), F.col("rank").cast("string")).alias("period_id"),
        F.col("day").alias("start"),
        (F.col("day") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 SECOND")).alias("end"),
        F.col("rank").alias("peak_rank"),
    )


def peak_day_period(E: DataFrame, rank: int, prefix: str = "peak_day_") -> DataFrame:
    """The period of the ``rank``-th busiest day; a rank outside 1..#days
    is an error (the day count is one small aggregate)."""
    n_days = E.select("day").distinct().count()
    if rank < 1 or rank > n_days:
        raise ValueError(f"peak rank {rank} outside 1..{n_days}")
    return peak_day_periods(E, top=rank, prefix=prefix).where(F.col("peak_rank") == rank)


# FIXED VALUES — crisis levels of the velocity score.
CRISIS_LEVELS = ((80, "CRISE FORTE"), (60, "CRISE ÉLEVÉE"), (40, "CRISE MODÉRÉE"))
CRISIS_DEFAULT = "SIGNAL FAIBLE / BRUIT"


def crisis_level(score: Column) -> Column:
    out = None
    for threshold, label in CRISIS_LEVELS:
        out = F.when(score >= threshold, label) if out is None else out.when(score >= threshold, label)
    return out.otherwise(CRISIS_DEFAULT)


def _hours(start: Column, end: Column) -> Column:
    """Hours between two timestamps, at least 1 (no time zone involved)."""
    secs = F.timestamp_diff("MICROSECOND", start, end) / 1e6
    return F.greatest(F.lit(1.0), secs / 3600.0)


def crisis_velocity(Ep: DataFrame, E: DataFrame, by: tuple[str, ...] = ("period_id",)) -> DataFrame:
    """Crisis velocity score (0-100) of each period against the corpus.

    volume  = min(30, 10 ln1p(vph / (vph_ref + 1e-9)))
    reach   = min(20, 20 ln1p(reach) / ln1p(reach_ref + 1))   (0 if reach_ref <= 0)
    negative= min(15, 0.15 neg%) ; retweets = min(15, 0.15 rt%) ; risk = min(20, 4 mean risk)
    The sum is rounded to 0.1 (numpy rule when the reach term is the
    uncapped log ratio, Python's exact rule otherwise)."""
    return velocity(kpis(Ep, by=by), corpus_span(E), by)


def velocity(k: DataFrame, ref: DataFrame, by: tuple[str, ...] = ("period_id",)) -> DataFrame:
    """The velocity score from the KPIs of each period and the one row of :func:`corpus_span`."""
    x = k.crossJoin(F.broadcast(ref))
    vph = F.col("messages") / _hours(F.col("debut"), F.col("fin"))
    ref_vph = F.col("ref_messages") / _hours(F.col("ref_start"), F.col("ref_end"))
    volume = F.least(F.lit(30.0), 10.0 * F.log1p(vph / (ref_vph + 1e-9)))
    reach_raw = 20.0 * (F.log1p(F.col("reach")) / F.log1p(F.col("ref_reach") + 1))
    reach_c = F.when(F.col("ref_reach") > 0, F.least(F.lit(20.0), reach_raw)).otherwise(F.lit(0.0))
    neg = F.least(F.lit(15.0), F.col("sentiment_negatif_pct") / 100.0 * 15.0)
    rt = F.least(F.lit(15.0), F.col("retweets_pct") / 100.0 * 15.0)
    risk = F.least(F.lit(20.0), (F.col("risk_moyen") / 5.0) * 20.0)
    total = volume + reach_c + neg + rt + risk
    numpy_typed = (F.col("ref_reach") > 0) & (reach_raw < 20.0)
    score = F.when(numpy_typed, round_even(total, 1)).otherwise(round_py(total, 1))
    return x.select(
        *by, "messages", "debut", "fin",
        _hours(F.col("debut"), F.col("fin")).alias("period_hours"),
        vph.alias("volume_per_hour"), ref_vph.alias("ref_volume_per_hour"),
        volume.alias("volume_component"), reach_c.alias("reach_component"),
        neg.alias("negativity_component"), rt.alias("rt_component"), risk.alias("risk_component"),
        score.alias("crisis_velocity_score"),
    ).withColumn("niveau", crisis_level(F.col("crisis_velocity_score")))


def focus_days(E: DataFrame, top_days: int = 2) -> DataFrame:
    """Posts of the ``top_days`` busiest days (left-semi join on ``day``;
    the key side holds ``top_days`` rows by construction)."""
    best = peaks(daily_timeline(E), "day", top_days).select("day")
    return E.join(F.broadcast(best), "day", "left_semi")
