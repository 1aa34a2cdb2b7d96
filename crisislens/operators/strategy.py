"""Per-period strategy rows, message pack and guardrail (report inputs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as RU
from ..texts import CHANNEL_TEMPLATES, DEFAULT_CHANNELS, DEFAULT_SPOKESPERSON
from .common import top_k
from .metrics import narratives_table
from .periods import crisis_velocity

BY = ("period_id",)


def dominant_narrative(Ep: DataFrame, by=BY) -> DataFrame:
    """Most frequent narrative of each group (ties: name ascending)."""
    return dominant_of(narratives_table(Ep, by), by)


def dominant_of(narratives: DataFrame, by=BY) -> DataFrame:
    """The first narrative of each group of a narratives table."""
    return top_k(narratives, [F.desc("count"), F.asc("narrative")], 1, by).select(
        *by, F.col("narrative").alias("dominant_narrative"))


def strategy_rows(Ep: DataFrame, E: DataFrame, posture: str | None = None) -> DataFrame:
    """One row per period: score, level, dominant narrative, priority,
    posture (derived unless given) and sensitive points."""
    return strategy_of(crisis_velocity(Ep, E), dominant_narrative(Ep), posture)


def strategy_of(velocity: DataFrame, dominant: DataFrame, posture: str | None = None) -> DataFrame:
    """The strategy rows from the velocity scores and the dominant narratives of the periods."""
    cv = velocity.select(*BY, F.col("crisis_velocity_score").alias("score"), "niveau")
    x = cv.join(dominant, list(BY), "left")
    dom = F.coalesce(F.col("dominant_narrative"), F.lit("non identifié"))
    chosen = F.lit(posture) if posture else RU.response_posture(dom, F.col("score"))
    return x.select(*BY, "score", "niveau", dom.alias("dominant_narrative"),
                    RU.priority_from_score(F.col("score")).alias("priority"),
                    chosen.alias("posture"),
                    RU.sensitive_points(dom).alias("sensitive_points"))


def channel_templates(spark: SparkSession, channels: Sequence[str] = DEFAULT_CHANNELS) -> DataFrame:
    """Bounded lookup table (at most 7 rows): the requested channels."""
    rows = [(i, c, t) for i, (c, t) in enumerate(CHANNEL_TEMPLATES) if c in channels]
    return spark.createDataFrame(rows, "channel_order int, canal string, template string")


def message_pack(strategy: DataFrame, channels: Sequence[str] = DEFAULT_CHANNELS,
                 spokesperson: str = DEFAULT_SPOKESPERSON) -> DataFrame:
    """Periods x channel templates (broadcast of <= 7 rows), placeholders
    filled, then every message checked by the guardrail."""
    tpl = channel_templates(strategy.sparkSession, channels)
    x = strategy.crossJoin(F.broadcast(tpl))
    text = F.col("template")
    for key, value in (("{spokesperson}", F.lit(spokesperson)), ("{niveau}", F.col("niveau")),
                       ("{score}", F.col("score").cast("string")), ("{dominant}", F.col("dominant_narrative"))):
        text = F.replace(text, F.lit(key), value)
    out = x.select(*BY, "channel_order", "canal", text.alias("text"))
    g = RU.guardrail(F.col("text"))
    return out.select("*", *[c.alias(k) for k, c in g.items()])
