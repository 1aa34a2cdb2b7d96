"""Many overlapping periods from one pass over the posts.

The time axis is cut at every period bound: at each start, and one microsecond
(the resolution of a timestamp) behind each inclusive end.  Between two cuts no
period begins or ends, so such an elementary segment lies in a period whole or not
at all.  Posts are aggregated once by segment; what a period needs is then a sum
over the segments it covers, of small rows.  Posts are never multiplied, however
many periods hold them, and their texts are not read.

``segment_table`` has one row for each (segment, author, narratives) with additive
measures; KPIs, authors, narratives and the velocity score of all periods come from
it.  Distinct authors are exact, as the author is part of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import neg_flag, top_k
from .metrics import kpi_columns, with_influence
from .periods import corpus_span, velocity

SUMS = ("messages", "retweets", "originaux", "reponses", "citations", "likes", "comments", "shares", "impressions", "reach",
        "engagement_total", "_neg", "_risk")
FIRST, LAST, MOST = ("debut",), ("fin",), ("risk_max", "followers")


def _behind(end: Column) -> Column:
    return end + F.expr("INTERVAL '0.000001' SECOND")


class Cuts:
    """The cuts of a period table: by day, the number of cuts before it and those within it."""

    def __init__(self, periods: DataFrame):
        """``periods`` has period_id, start, end; null bounds are open, periods that end before they start are empty."""
        self.periods = periods.select("period_id", "start", "end").where("start IS NULL OR end IS NULL OR start <= end")
        at = self.periods.select(F.col("start").alias("at")).unionAll(self.periods.select(_behind(F.col("end")))).where("at IS NOT NULL").distinct()
        by_day = at.groupBy(F.to_date("at").alias("_day")).agg(F.sort_array(F.collect_list("at")).alias("_cuts"))
        span = by_day.agg(F.min("_day").alias("lo"), F.max("_day").alias("hi"), F.sum(F.size("_cuts")).alias("n"))
        calendar = span.where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("_day"))
        before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)           # one row a calendar day
        self.days = (calendar.join(by_day, "_day", "left").withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<timestamp_ntz>")))
                     .withColumn("_before", F.coalesce(F.sum(F.size("_cuts")).over(before), F.lit(0)).cast("int")))
        self.span = span.select(F.col("lo").alias("_lo"), F.coalesce("n", F.lit(0)).cast("int").alias("_n"))

    def number(self, df: DataFrame, at: str, name: str = "segment", date: str | None = None) -> DataFrame:
        """``df`` with the number of the segment that holds the timestamp ``at``: the cuts at or before it.

        An equi-join on the day, with one row a day on the other side.
        """
        day = F.col(date) if date else F.to_date(at)
        met = df.withColumn("_d", day).join(self.days, F.col("_d") == F.col("_day"), "left").crossJoin(F.broadcast(self.span))
        within = F.col("_before") + F.size(F.filter("_cuts", lambda c: c <= F.col(at)))
        return met.withColumn(name, F.coalesce(within, F.when(F.col("_lo").isNull() | (F.col("_d") < F.col("_lo")), 0).otherwise(F.col("_n")))).drop(
            "_d", "_day", "_cuts", "_before", "_lo", "_n")

    def covered(self) -> DataFrame:
        """(period_id, segment): the segments of each period."""
        x = self.number(self.number(self.periods, "start", "lo"), "end", "hi").crossJoin(F.broadcast(self.span))
        lo = F.when(F.col("start").isNull(), 0).otherwise(F.col("lo"))
        hi = F.when(F.col("end").isNull(), F.col("_n")).otherwise(F.col("hi"))
        return x.select("period_id", F.explode(F.sequence(lo, hi)).alias("segment"))


def segment_table(E: DataFrame, cuts: Cuts) -> DataFrame:
    """(segment, author, narratives, measures): the one pass over the posts."""
    count, total = F.count(F.lit(1)), [c for c in ("likes", "comments", "shares", "impressions", "reach", "engagement_total")]
    narrow = E.select("dt", "date", "author", "narratives", "is_retweet", "is_original", "is_reply", "is_quote", "sentiment", "risk_level", "followers", *total)
    return cuts.number(narrow, "dt", date="date").groupBy("segment", "author", "narratives").agg(
        count.alias("messages"), F.count_if("is_retweet").alias("retweets"), F.count_if("is_original").alias("originaux"),
        F.count_if("is_reply").alias("reponses"), F.count_if("is_quote").alias("citations"), *[F.sum(c).alias(c) for c in total],
        F.count_if(neg_flag()).alias("_neg"), F.sum("risk_level").alias("_risk"), F.max("risk_level").alias("risk_max"),
        F.max("followers").alias("followers"), F.min("dt").alias("debut"), F.max("dt").alias("fin"))


def _together(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS], *[F.min(c).alias(c) for c in FIRST], *[F.max(c).alias(c) for c in (*LAST, *MOST)])


def period_authors(table: DataFrame, covered: DataFrame) -> DataFrame:
    """(period_id, author, measures)."""
    return _together(_together(table, "segment", "author").join(covered, "segment"), "period_id", "author")


def segment_kpis(table: DataFrame, covered: DataFrame) -> DataFrame:
    """The KPIs of every period, as ``metrics.kpis`` has them."""
    authors = period_authors(table, covered)
    k = _together(authors, "period_id").join(authors.groupBy("period_id").agg(F.count(F.lit(1)).alias("auteurs_uniques")), "period_id")
    return kpi_columns(k.withColumn("risk_moyen", F.col("_risk") / F.col("messages")), ("period_id",))


def segment_authors(table: DataFrame, covered: DataFrame, n: int | None = 10) -> DataFrame:
    """The top authors of every period, as ``metrics.top_authors`` has them."""
    t = period_authors(table, covered).select("period_id", "author", "messages", "retweets", "likes", "shares", "reach", "impressions", "followers",
                                              (F.col("_risk") / F.col("messages")).alias("risk_mean"))
    order = [F.desc("influence_score"), F.desc("reach"), F.desc("shares"), F.asc("author")]
    return top_k(with_influence(t), order, n, ("period_id",))


def segment_narratives(table: DataFrame, covered: DataFrame) -> DataFrame:
    """(period_id, narrative, count, pct_messages), as ``metrics.narratives_table`` has it."""
    # narratives are taken apart behind the sum, so each list of a segment is one row
    lists = table.groupBy("segment", "narratives").agg(F.sum("messages").alias("m")).join(covered, "segment").groupBy("period_id", "narratives").agg(F.sum("m").alias("m"))
    total = lists.groupBy("period_id").agg(F.sum("m").alias("n_posts"))
    counts = lists.select("period_id", "m", F.explode_outer("narratives").alias("narrative")).groupBy("period_id", "narrative").agg(F.sum("m").alias("count"))
    return counts.join(total, "period_id").select("period_id", "narrative", "count", (F.col("count") / F.greatest(F.lit(1), F.col("n_posts")) * 100.0).alias("pct_messages"))


def segment_velocity(table: DataFrame, covered: DataFrame, E: DataFrame) -> DataFrame:
    """The crisis velocity score of every period, as ``periods.crisis_velocity`` has it."""
    return velocity(segment_kpis(table, covered), corpus_span(E))
