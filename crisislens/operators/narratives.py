"""Narrative risk matrix, narrative timeline and mutation, actors per
narrative, sample posts per narrative (all grouped by optional ``by`` keys)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ln1p_pos, pct, round_py
from .common import By, attach, explode_list, group_totals, neg_flag, top_k

# FIXED VALUES — risk labels of the strategic narrative score.
RISK_LABELS = ((80, "Critique"), (60, "Élevé"), (40, "Modéré"))
RISK_DEFAULT = "Faible"
MAX_NARRATIVES = 1000              # rows of a matrix without groups; a lexicon has a handful of labels

# FIXED VALUES — response angle by narrative label (first rule that matches
# a lower-case substring of the label wins).
ANGLE_RULES: tuple[tuple[tuple[str, ...], str], ...] = (
    (("harc", "menace"), "Réponse sécurité + condamnation des menaces"),
    (("argent", "subvention", "copinage", "favoritisme"), "Transparence sur critères, gouvernance et garde-fous"),
    (("censure", "idéologie", "ideologie"), "Neutralité institutionnelle, éviter le débat partisan"),
    (("cnc", "institution"), "Clarification factuelle et preuve de cohérence institutionnelle"),
)
ANGLE_DEFAULT = "Monitoring, réponse seulement si le narratif monte"

# FIXED VALUES — narrative recommendations.
REC_LAST = "Ne pas répondre à tous les messages : prioriser les narratifs qui attaquent la confiance institutionnelle."
REC_EMPTY = "Continuer le monitoring : aucun narratif dominant exploitable."
MUTATION_CHANGE, MUTATION_STABLE = "changement de narratif dominant", "stable"


def risk_label(score: Column) -> Column:
    out = None
    for threshold, label in RISK_LABELS:
        out = F.when(score >= threshold, label) if out is None else out.when(score >= threshold, label)
    return out.otherwise(RISK_DEFAULT)


def rule_text(text: Column, rules, default: str) -> Column:
    """First rule whose keywords occur in lower(text) gives the answer."""
    low = F.lower(text)
    out = None
    for words, answer in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, answer) if out is None else out.when(hit, answer)
    return out.otherwise(default)


def response_angle(narrative: Column) -> Column:
    return rule_text(narrative, ANGLE_RULES, ANGLE_DEFAULT)


def narrative_matrix(E: DataFrame, by: By = ()) -> DataFrame:
    """Per narrative: volume, reach, shares, negativity, retweets, mean risk
    and the strategic risk score (0-100), ordered by score then volume."""
    x = explode_list(E.select(*by, "narratives", "reach", "shares", "sentiment", "is_retweet", "risk_level"),
                     "narratives", "narrative", (*by, "reach", "shares", "sentiment", "is_retweet", "risk_level"))
    g = x.groupBy(*by, "narrative").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum("reach").alias("_reach"),
        F.sum("shares").alias("_shares"),
        F.count_if(neg_flag()).alias("_neg"),
        F.count_if("is_retweet").alias("_rt"),
        F.avg("risk_level").alias("_risk"),
    )
    g = attach(g, group_totals(E, by), by)
    share = pct(F.col("messages"), F.col("n_posts"))
    neg = pct(F.col("_neg"), F.col("messages"))
    volume = F.least(F.lit(25.0), share * 0.45)
    reach_c = F.when(F.col("_reach") > 0, F.least(F.lit(20.0), F.log1p(F.col("_reach")) / 18 * 20)).otherwise(0.0)
    share_c = F.when(F.col("_shares") > 0, F.least(F.lit(15.0), F.log1p(F.col("_shares")) / 10 * 15)).otherwise(0.0)
    neg_c = F.least(F.lit(20.0), neg * 0.20)
    risk_c = F.least(F.lit(20.0), (F.col("_risk") / 5) * 20)
    score = round_py(volume + reach_c + share_c + neg_c + risk_c, 1)
    out = g.select(
        *by, "narrative", "messages",
        round_py(share, 1).alias("pct_messages"),
        F.col("_reach").cast("bigint").alias("reach"),
        F.col("_shares").cast("bigint").alias("shares"),
        round_py(neg, 1).alias("negatif_pct"),
        round_py(pct(F.col("_rt"), F.col("messages")), 1).alias("rt_pct"),
        round_py(F.col("_risk"), 2).alias("risk_mean"),
        score.alias("strategic_risk_score"),
    ).withColumn("risk_label", risk_label(F.col("strategic_risk_score")))
    return top_k(out, [F.desc("strategic_risk_score"), F.desc("messages"), F.asc("narrative")], MAX_NARRATIVES, by)


def risk_matrix(matrix: DataFrame) -> DataFrame:
    """Narrative matrix plus the response angle of each narrative."""
    return matrix.withColumn("angle_de_reponse", response_angle(F.col("narrative")))


def narrative_timeline(E: DataFrame, bucket: str = "hour", by: By = ()) -> DataFrame:
    cols = (*by, bucket, "reach", "is_retweet", "risk_level")
    x = explode_list(E.select(*cols, "narratives"), "narratives", "narrative", cols)
    g = x.groupBy(*by, bucket, "narrative").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum("reach").alias("reach"),
        F.count_if("is_retweet").alias("retweets"),
        F.avg("risk_level").alias("risk_mean"),
    )
    m = F.col("messages")
    return g.withColumn("rt_pct", F.when(m > 0, F.col("retweets") / m * 100.0).otherwise(0.0))


def detect_mutation(timeline: DataFrame, bucket: str = "hour", by: By = ()) -> DataFrame:
    """Dominant narrative of each bucket (most posts, then name) and whether
    it differs from the dominant one of the previous non-empty bucket."""
    dom_w = Window.partitionBy(*by, bucket).orderBy(F.desc("messages"), F.asc("narrative"))
    dom = (timeline.withColumn("_r", F.row_number().over(dom_w)).where(F.col("_r") == 1)
           .select(*by, bucket, F.col("narrative").alias("dominant_narrative"), "messages"))
    seq = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(bucket)
    prev = F.lag("dominant_narrative").over(seq)
    return dom.select(
        *by, F.col(bucket).alias("period"), "dominant_narrative", "messages", prev.alias("previous"),
    ).withColumn("mutation", F.when(F.col("previous").isNotNull() & (F.col("previous") != F.col("dominant_narrative")),
                                    MUTATION_CHANGE).otherwise(MUTATION_STABLE))


def actor_narratives(E: DataFrame, top_n: int | None = 10, by: By = ()) -> DataFrame:
    cols = (*by, "author", "reach", "shares", "likes", "risk_level")
    x = explode_list(E.select(*cols, "narratives"), "narratives", "narrative", cols)
    g = x.groupBy(*by, "author", "narrative").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum("reach").alias("reach"),
        F.sum("shares").alias("shares"),
        F.sum("likes").alias("likes"),
        F.avg("risk_level").alias("risk_mean"),
    )
    score = (ln1p_pos(F.col("reach")) * 0.35 + ln1p_pos(F.col("shares")) * 0.30
             + ln1p_pos(F.col("likes")) * 0.20 + ln1p_pos(F.col("messages")) * 0.15)
    g = g.withColumn("actor_narrative_score", score)
    return top_k(g, [F.desc("actor_narrative_score"), F.asc("author"), F.asc("narrative")], top_n, by)


SAMPLE_COLUMNS = ("post_id", "dt", "author", "engagement_type", "sentiment", "likes", "shares", "reach",
                  "risk_level", "text_raw")


def sample_posts(E: DataFrame, top_n: int = 3, by: By = ()) -> DataFrame:
    """The ``top_n`` most engaging posts of every narrative."""
    cols = (*by, *SAMPLE_COLUMNS, "engagement_total")
    x = explode_list(E.select(*cols, "narratives"), "narratives", "narrative", cols)
    order = [F.desc("engagement_total"), F.desc("reach"), F.desc("shares"), F.asc("post_id")]
    return top_k(x, order, top_n, (*by, "narrative")).drop("engagement_total")


def recommendations(rmatrix: DataFrame, by: By = ()) -> DataFrame:
    """Per group: up to 4 'narrative : angle.' lines (matrix order) and a
    closing line; a group without narratives would get one monitoring line."""
    top = rmatrix.where(F.col("rank") <= 4).select(
        *by, "rank", F.concat(F.col("narrative"), F.lit(" : "), F.col("angle_de_reponse"), F.lit(".")).alias("line"))
    g = top.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("_l"))
    lines = F.transform(F.col("_l"), lambda s: s["line"])
    return g.select(*by, F.when(F.size(lines) == 0, F.array(F.lit(REC_EMPTY)))
                    .otherwise(F.concat(lines, F.array(F.lit(REC_LAST)))).alias("recommendations"))
