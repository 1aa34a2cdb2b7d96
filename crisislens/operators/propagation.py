"""Propagation speed, concentration, copy-paste templates and the prudent
coordination score (grouped by optional ``by`` keys)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numbers import pct, round_even, round_py
from ..functions.text import copy_fingerprint
from .common import By, attach, top_k
from .timeline import BURST_NORMAL


def _hours(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(1.0), F.timestamp_diff("MICROSECOND", start, end) / 1e6 / 3600.0)


def propagation_metrics(E: DataFrame, by: By = ()) -> DataFrame:
    """Span, volume per hour, busiest hour and acceleration ratio.
    Two-level aggregation: posts per hour, then per group."""
    per_hour = E.groupBy(*by, "hour").agg(F.count(F.lit(1)).alias("_h"))
    peak = per_hour.groupBy(*by).agg(F.max("_h").alias("peak_hour_messages"))
    base = E.groupBy(*by).agg(
        F.min("dt").alias("start"), F.max("dt").alias("end"), F.count(F.lit(1)).alias("messages"),
        F.count_if("is_retweet").alias("_rt"), F.countDistinct("author").alias("unique_authors"),
        F.sum("reach").alias("_reach"), F.sum("impressions").alias("_impr"),
    )
    x = attach(base, peak, by)
    hours = _hours(F.col("start"), F.col("end"))
    avg = F.col("messages") / hours
    return x.select(
        *by, "start", "end",
        round_py(hours, 2).alias("duration_hours"),
        "messages",
        round_py(avg, 2).alias("messages_per_hour"),
        "peak_hour_messages",
        round_py(F.col("peak_hour_messages") / F.greatest(avg, F.lit(1e-9)), 2).alias("acceleration_ratio"),
        round_py(pct(F.col("_rt"), F.col("messages")), 1).alias("retweet_pct"),
        "unique_authors",
        F.col("_reach").cast("bigint").alias("reach"),
        F.col("_impr").cast("bigint").alias("impressions"),
    )


def concentration_table(E: DataFrame, top_n: int = 10, by: By = ()) -> DataFrame:
    """Authors ranked by reach, shares, messages (author ascending on ties)."""
    t = E.groupBy(*by, "author").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("reach").alias("reach"), F.sum("shares").alias("shares"),
        F.sum("likes").alias("likes"), F.count_if("is_retweet").alias("retweets"))
    order = [F.desc("reach"), F.desc("shares"), F.desc("messages"), F.asc("author")]
    return top_k(t, order, top_n, by)


def concentration_metrics(E: DataFrame, top_n: int = 10, by: By = ()) -> DataFrame:
    """Share of posts, reach and shares held by the top ``top_n`` authors by
    reach (names say top10 whatever ``top_n`` is); denominators at least 1."""
    top = concentration_table(E, top_n, by).groupBy(*by).agg(
        F.sum("messages").alias("_tm"), F.sum("reach").alias("_tr"), F.sum("shares").alias("_ts"))
    tot = E.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("reach").alias("_r"), F.sum("shares").alias("_s"),
        F.countDistinct("author").alias("authors_total"))
    x = attach(tot, top, by)
    return x.select(
        *by,
        round_even(F.col("_tm") / F.greatest(F.col("_n"), F.lit(1)) * 100, 1).alias("top10_message_share_pct"),
        round_even(F.col("_tr") / F.greatest(F.col("_r"), F.lit(1.0)) * 100, 1).alias("top10_reach_share_pct"),
        round_even(F.col("_ts") / F.greatest(F.col("_s"), F.lit(1.0)) * 100, 1).alias("top10_share_share_pct"),
        "authors_total",
    )


def copy_patterns(E: DataFrame, min_count: int = C.COPY_MIN_COUNT, top: int | None = C.COPY_TOP,
                  by: By = ()) -> DataFrame:
    """Posts sharing one normalised template (links, mentions, hashtags
    masked; first 220 characters): groups of at least ``min_count`` posts
    whose fingerprint is longer than 40 characters.

    All aggregates combine map-side (a hot template is reduced before the
    shuffle); the example is the text of the earliest post (lowest post_id)."""
    # an enriched corpus carries the fingerprint (computed in its one text
    # pass); otherwise derive it here
    fingerprint = F.col("fingerprint") if "fingerprint" in E.columns else \
        copy_fingerprint(F.col("text_raw"), C.COPY_FINGERPRINT_CHARS)
    example = F.substring("text_raw", 1, C.COPY_EXAMPLE_CHARS)
    fp = E.select(*by, fingerprint.alias("fingerprint"), "author", "dt", "reach", "post_id", example.alias("_text"))
    # the earliest post's bounded example rides along, so the corpus is read once
    # and a post that occurs in several groups counts once in each
    g = fp.groupBy(*by, "fingerprint").agg(
        F.count(F.lit(1)).alias("count"),
        F.countDistinct("author").alias("authors"),
        F.min("dt").alias("first_seen"),
        F.max("dt").alias("last_seen"),
        F.sum("reach").alias("reach"),
        F.min_by("_text", F.struct("post_id", "dt", "_text")).alias("example"),
    ).where((F.col("count") >= min_count) & (F.length("fingerprint") > C.COPY_MIN_FINGERPRINT_LEN))
    order = [F.desc("count"), F.desc("authors"), F.desc("reach"), F.asc("fingerprint")]
    return top_k(g, order, top, by)


# FIXED VALUES — coordination labels, prudence note and operational reading.
COORDINATION_LABELS = (
    (75, "Signaux forts d'amplification structurée"),
    (50, "Signaux modérés d'amplification synchronisée"),
    (25, "Quelques signaux faibles à surveiller"),
)
COORDINATION_DEFAULT = "Propagation surtout organique ou non démontrée"
PRUDENCE = ("Ce score ne prouve pas l'existence de bots. Il mesure des signaux de concentration, synchronie "
            "et copier-coller à vérifier humainement.")
READING_RT = ("La crise est portée par amplification : surveiller les sources reprises plutôt que répondre "
              "à tous les retweets.")
READING_ACCEL = "La vitesse de pic est forte : préparer une réponse courte et une FAQ avant le prochain rebond."
READING_SCORE = "Formuler 'signaux d'amplification synchronisée' et éviter d'accuser des bots sans preuve."
READING_ALWAYS = "Prioriser les publications sources, les relais médias et les comptes passerelles entre communautés."


def coordination_label(score: Column) -> Column:
    out = None
    for threshold, label in COORDINATION_LABELS:
        out = F.when(score >= threshold, label) if out is None else out.when(score >= threshold, label)
    return out.otherwise(COORDINATION_DEFAULT)


def coordination(prop: DataFrame, conc: DataFrame, copies: DataFrame, burst_rows: DataFrame,
                 by: By = ()) -> DataFrame:
    """Prudent coordination score from already-computed (small) tables:
    retweet share, top-author reach share, copy templates (<= 15 rows) and
    non-normal bursts among the top-12 hours."""
    n_copy = copies.groupBy(*by).agg(F.count(F.lit(1)).alias("_copies"))
    n_burst = burst_rows.groupBy(*by).agg(F.count_if(F.col("burst_level") != BURST_NORMAL).alias("_bursts"))
    x = prop.select(*by, "retweet_pct", "acceleration_ratio").join(
        conc.select(*by, "top10_reach_share_pct"), list(by), "inner") if by else \
        prop.select("retweet_pct", "acceleration_ratio").crossJoin(F.broadcast(conc.select("top10_reach_share_pct")))
    if by:
        x = x.join(n_copy, list(by), "left").join(n_burst, list(by), "left")
    else:
        x = x.crossJoin(F.broadcast(n_copy)).crossJoin(F.broadcast(n_burst))
    rt_c = F.least(F.lit(25.0), F.col("retweet_pct") * 0.25)
    conc_c = F.least(F.lit(25.0), F.col("top10_reach_share_pct") * 0.35)
    copy_c = F.least(F.lit(25.0), F.coalesce(F.col("_copies"), F.lit(0)) * 3.5)
    burst_c = F.least(F.lit(25.0), F.coalesce(F.col("_bursts"), F.lit(0)) * 4.0)
    raw = round_py(rt_c + conc_c + copy_c + burst_c, 1)
    score = F.least(F.lit(100.0), raw)
    reading = F.array_compact(F.array(
        F.when(F.col("retweet_pct") >= 70, F.lit(READING_RT)),
        F.when(F.col("acceleration_ratio") >= 4, F.lit(READING_ACCEL)),
        F.when(score >= 50, F.lit(READING_SCORE)),
        F.lit(READING_ALWAYS)))
    return x.select(
        *by, score.alias("score"), coordination_label(raw).alias("label"),
        round_py(rt_c, 1).alias("rt_component"), round_py(conc_c, 1).alias("concentration_component"),
        round_py(copy_c, 1).alias("copy_component"), round_py(burst_c, 1).alias("burst_component"),
        F.lit(PRUDENCE).alias("prudence"), reading.alias("operational_reading"))
