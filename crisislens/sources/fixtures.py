"""Raw post table derived from the driver's tables.

One post per ``events`` row.  Its text is a short crisis template (so the
lexicon, hashtags and mentions have something to find) followed by the
**whole** text of a ``documents`` row; ``labels`` gives the sentiment.  The
work therefore grows with ``events`` and with the size of ``documents``.

The same derivation exists twice: as DataFrame code (what the engine runs)
and as DuckDB SQL (what the oracle runs).  Raw column names are deliberately
not the logical ones, so the mapping step is exercised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixture phrases (test data, not engine constants): one per template slot.
POST_TEMPLATES: tuple[str, ...] = (
    "Argent public : encore des subventions versées aux mêmes #Subvention",
    "Copinage et favoritisme à la commission, toujours les mêmes potes #CNC",
    "Le CNC et le ministère de la Culture doivent répondre #CNC #Culture",
    "Ultia en live sur Twitch ce soir, la streameuse réagit #Twitch",
    "Censure ou idéologie ? la gauche et la droite se déchirent #Débat",
    "Suspension du fonds d aide annoncée, la suppression est demandée #Fonds",
    "Stop au harcèlement et aux menaces contre les personnes #Stop",
    "FLASH alerte : communiqué de presse et article à suivre #Info",
    "Bonne journée à tous, il fait beau sur la plage aujourd hui",
    "Impôts, taxes, vache à lait : 3 millions pour qui ? #Impôts",
)

# Explicit mapping for the raw posts (auto-mapping is tested separately).
POSTS_MAPPING: dict[str, str] = {
    "post_id": "post_id", "date": "dt", "author": "author_src", "text": "full_text",
    "engagement_type": "engagement_src", "sentiment": "sentiment_src", "repost_of": "repost_src",
    "likes": "likes", "comments": "comments", "shares": "shares", "reach": "reach",
    "impressions": "impressions", "followers": "followers",
}

# Messy spreadsheet-style headers for the same columns (auto-mapping input).
MESSY_HEADERS: dict[str, str] = {
    "post_id": "postID", "dt": "Date", "author_src": "Author", "full_text": "Full Text",
    "engagement_src": "Engagement Type", "sentiment_src": "Sentiment", "repost_src": "X Repost of",
    "likes": "Likes", "comments": "Replies", "shares": "Retweets", "reach": "Reach",
    "impressions": "Impressions", "followers": "X Followers",
}


def raw_posts(spark: SparkSession, sf_dir: str, share: tuple[int, int] = (0, 1)) -> DataFrame:
    """The posts, or share (i, n) of them: those of every n-th document.  The n shares together are all posts."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))           # one row
    templates = spark.createDataFrame(list(enumerate(POST_TEMPLATES)), "tpl int, body string")  # 10 rows
    i, n_shares = share
    if n_shares > 1:                                                # both sides of the join, so nothing else is shuffled
        docs, labels = (t.where(F.pmod(F.col("doc_id"), F.lit(n_shares)) == i) for t in (docs, labels))
    labelled = docs.join(labels, "doc_id", "left")                  # co-partitioned on doc_id
    e = (ev.crossJoin(F.broadcast(n_docs))
         .withColumn("doc_key", F.col("event_id") % F.col("n_docs"))
         .withColumn("tpl", ((F.col("event_id") + F.col("user_id")) % 10).cast("int")))
    if n_shares > 1:
        e = e.where(F.pmod(F.col("doc_key"), F.lit(n_shares)) == i)
    # Hash-partition the (narrow) event rows on the join key with an explicit
    # count: a shuffled join reuses this partitioning as is, and when the
    # documents side is small enough to broadcast, the text-heavy work after
    # the join still spreads over all partitions instead of the few splits
    # of the events files.  An explicit count is not coalesced away by AQE.
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = e.repartition(n_parts, "doc_key")
    j = e.join(F.broadcast(templates), "tpl").join(labelled, F.col("doc_key") == F.col("doc_id"))
    eid, uid = F.col("event_id"), F.col("user_id")
    mention = F.concat(F.lit(" @u"), uid.cast("string"), F.lit(" https://t.co/"), eid.cast("string"))
    return j.select(
        eid.alias("post_id"),
        F.col("ts").alias("dt"),
        F.when(eid % 97 == 0, F.lit("")).otherwise(F.concat(F.lit("@user_"), uid.cast("string"))).alias("author_src"),
        F.concat(F.when(eid % 7 == 0, F.lit("RT ")).otherwise(F.lit("")), F.col("body"),
                 F.when(eid % 5 == 0, mention).otherwise(F.lit("")),
                 F.lit(" "), F.col("text")).alias("full_text"),
        F.when(F.col("event_type") == "click", "RETWEET").when(F.col("event_type") == "signup", "Reply")
         .when(F.col("event_type") == "purchase", "QUOTE").when(F.col("event_type") == "error", F.lit(None))
         .otherwise("original").alias("engagement_src"),
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 0, "Neg")
         .when(F.col("quality") == 1, "positive").alias("sentiment_src"),
        F.when(eid % 11 == 0, F.concat(F.lit("user_"), (uid + 1).cast("string"))).alias("repost_src"),
        (eid % 23).cast("double").alias("likes"),
        (eid % 5).cast("double").alias("comments"),
        (eid % 17).cast("double").alias("shares"),
        F.floor(F.col("value") * 100).cast("double").alias("reach"),
        F.floor(F.col("value") * 250).cast("double").alias("impressions"),
        (uid * 13 % 1009).cast("double").alias("followers"),
    )


def messy_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw posts under spreadsheet headers, metrics as strings."""
    df = raw_posts(spark, sf_dir)
    return df.select(*[
        (F.col(c).cast("string") if c in ("likes", "comments", "shares", "reach", "impressions", "followers")
         else F.col(c)).alias(MESSY_HEADERS[c]) for c in df.columns])


def _sql_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def raw_posts_sql() -> str:
    """DuckDB twin of :func:`raw_posts` (a SELECT over the registered views)."""
    values = ",\n ".join(f"({i}, {_sql_literal(b)})" for i, b in enumerate(POST_TEMPLATES))
    return f"""
SELECT e.event_id AS post_id, e.ts AS dt,
 CASE WHEN e.event_id % 97 = 0 THEN '' ELSE concat('@user_', CAST(e.user_id AS VARCHAR)) END AS author_src,
 concat(CASE WHEN e.event_id % 7 = 0 THEN 'RT ' ELSE '' END, t.body,
   CASE WHEN e.event_id % 5 = 0
        THEN concat(' @u', CAST(e.user_id AS VARCHAR), ' https://t.co/', CAST(e.event_id AS VARCHAR)) ELSE '' END,
   ' ', d.text) AS full_text,
 CASE e.event_type WHEN 'click' THEN 'RETWEET' WHEN 'signup' THEN 'Reply' WHEN 'purchase' THEN 'QUOTE'
   WHEN 'error' THEN NULL ELSE 'original' END AS engagement_src,
 CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 0 THEN 'Neg' WHEN l.quality = 1 THEN 'positive' END AS sentiment_src,
 CASE WHEN e.event_id % 11 = 0 THEN concat('user_', CAST(e.user_id + 1 AS VARCHAR)) END AS repost_src,
 CAST(e.event_id % 23 AS DOUBLE) AS likes, CAST(e.event_id % 5 AS DOUBLE) AS comments,
 CAST(e.event_id % 17 AS DOUBLE) AS shares,
 CAST(floor(e.value * 100) AS DOUBLE) AS reach, CAST(floor(e.value * 250) AS DOUBLE) AS impressions,
 CAST(e.user_id * 13 % 1009 AS DOUBLE) AS followers
FROM events e
CROSS JOIN (SELECT count(*) AS n_docs FROM documents) n
JOIN (VALUES
 {values}
) AS t(tpl, body) ON t.tpl = (e.event_id + e.user_id) % 10
JOIN documents d ON d.doc_id = e.event_id % n.n_docs
LEFT JOIN labels l ON l.doc_id = d.doc_id"""
