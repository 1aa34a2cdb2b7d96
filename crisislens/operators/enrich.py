"""Enrichment: raw post table -> enriched corpus ``E`` (one pass of Columns).

Every derived field is a native expression inside one projection, so the
whole enrichment runs in a single whole-stage-codegen span after the scan.
The only corpus-wide input is the reach p95 used by the risk level: it is a
one-row aggregate broadcast back onto the rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.numbers import round_even, safe_double
from ..functions.text import copy_fingerprint, extract_tokens, fold_lower, matches_any, trim_ws
from .sketches import merge_reach, quantile_of, reach_sketches
from ..sources.mapping import Mapping, norm_name, resolve_mapping, select_mapped

# Formats tried in order for string dates (None = ISO-8601 cast rules).
# Month-first before day-first, as the reference's parser prefers it.
DEFAULT_DATE_FORMATS: tuple[str | None, ...] = (
    None,
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "dd/MM/yyyy",
    "dd-MM-yyyy HH:mm",
)

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def narrative_flag_name(label: str) -> str:
    return "narr_" + norm_name(label)


def _parse(s: Column, fmt: str | None) -> Column:
    """``s`` by one format; None is the ISO cast, which needs a date part
    (a bare time of day would otherwise become a time of today)."""
    if fmt is None:
        return F.when(s.rlike(r"^[+-]?\d{4,6}-\d{1,2}"), F.try_to_timestamp(s))
    return F.try_to_timestamp(s, F.lit(fmt))


def choose_date_format(df: DataFrame, col: str, formats: Sequence[str | None], day_first: bool | None = None) -> str | None:
    """The format that parses most values of a text column, the first of equals.

    One choice for the whole column: ``03/04`` and ``26/03`` in one column are
    read alike.  A single aggregate over that column.  When day and month can be
    told apart nowhere in it, ``day_first`` decides; without it the order of
    ``formats`` does, with a warning."""
    if day_first is not None:
        first = "dd" if day_first else "MM"
        formats = sorted(formats, key=lambda f: not (f or "").startswith(first))
    s = trim_ws(F.col(col).cast("string"))
    hits = df.agg(*[F.count(_parse(s, f)).alias(str(i)) for i, f in enumerate(formats)]).first()
    best = max(range(len(formats)), key=lambda i: (hits[i], -i))
    swapped = [f for i, f in enumerate(formats) if hits[i] == hits[best] > 0 and i != best and _swapped(f) == formats[best]]
    if swapped and day_first is None:
        warnings.warn(f"dates fit {formats[best]!r} and {swapped[0]!r} alike; pass day_first to name the order", stacklevel=2)
    return formats[best]


def _swapped(fmt: str | None) -> str | None:
    """A format with day and month in the other order."""
    return fmt and fmt.replace("MM", "\0").replace("dd", "MM").replace("\0", "dd")


def parse_datetime(c: Column, dtype: T.DataType, formats: Sequence[str | None]) -> Column:
    """Timestamp (without time zone) from any date-like column; bad -> null.

    With several formats the first that fits a value is used (a stream cannot
    look at its whole column); see :func:`choose_date_format` for tables."""
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    s = trim_ws(c.cast("string"))
    return F.coalesce(*[_parse(s, f) for f in formats]).cast("timestamp_ntz")


def time_buckets(dt: Column) -> dict[str, Column]:
    """date, day, hour, hour_of_day and Monday-Sunday week label, all
    computed from date parts so no session time zone is involved."""
    date = F.to_date(dt)
    day = date.cast("timestamp_ntz")
    monday = F.date_sub(date, (F.dayofweek(date) + 5) % 7)
    return {
        "date": date,
        "day": day,
        "hour": day + F.make_dt_interval(F.lit(0), F.hour(dt)),
        "hour_of_day": F.hour(dt),
        "week": F.concat(F.date_format(monday, "yyyy-MM-dd"), F.lit("/"),
                         F.date_format(F.date_add(monday, 6), "yyyy-MM-dd")),
    }


def narrative_columns(text_norm: Column, lexicon: Sequence[C.Narrative]) -> list[Column]:
    """One boolean per narrative: any of its patterns found in the
    (lower-cased, accent-folded) text."""
    return [matches_any(text_norm, n.patterns, text_is_lower=True).alias(narrative_flag_name(n.label))
            for n in lexicon]


def narratives_array(lexicon: Sequence[C.Narrative], default: str = C.DEFAULT_NARRATIVE) -> Column:
    """Labels whose flag is set, in lexicon order; none -> [default]."""
    hits = F.array_compact(F.array(*[F.when(F.col(narrative_flag_name(n.label)), F.lit(n.label))
                                     for n in lexicon]))
    return F.when(F.size(hits) == 0, F.array(F.lit(default))).otherwise(hits)


def enrich(raw: DataFrame, mapping: Mapping | None = None, lexicon: Sequence[C.Narrative] = C.DEFAULT_LEXICON,
           date_formats: Sequence[str | None] = DEFAULT_DATE_FORMATS, exact_accents: bool = False,
           approx_p95: bool = False, streaming: bool = False, reach_p95: float | None = None,
           with_risk: bool = True, with_fingerprint: bool = True, require_rows: bool = True, day_first: bool | None = None) -> DataFrame:
    """Raw posts -> enriched corpus (schema in FIXTURES.md §2).

    Rows whose date does not parse are dropped; a text column is read by the
    one of ``date_formats`` that parses most of it (name a single format to
    skip that pass, or ``day_first`` for dates that could be read either way).
    Post ids keep their type: integers stay integers, any
    other id is text, and without an id column a hash of the mapped columns
    stands in.  ``approx_p95`` switches the
    corpus-wide reach quantile to mergeable sketches for very large data.
    On a stream (``streaming=True``) the corpus quantile cannot be computed
    per row; ``reach_p95`` (e.g. from the batch corpus) is used instead, and
    without it the reach term of the risk level is left out.
    ``with_risk=False`` stops before the risk level (materialize the text
    work first, then add it with :func:`with_risk_level`: the quantile then
    scans one stored column).  ``with_fingerprint`` keeps the copy-paste
    fingerprint as a column, computed in the same single pass over the text.
    """
    m = resolve_mapping(raw, mapping)
    src = select_mapped(raw, m)
    types = {f.name: f.dataType for f in src.schema.fields}
    has = lambda logical: f"src_{logical}" in types
    col = lambda logical: F.col(f"src_{logical}")

    if isinstance(types["src_date"], T.StringType) and len(date_formats) > 1 and not streaming:
        date_formats = [choose_date_format(src, "src_date", date_formats, day_first)]
    src = src.withColumn("dt", parse_datetime(col("date"), types["src_date"], date_formats)).where(F.col("dt").isNotNull())
    # nothing left after dropping bad dates is an error (a limit-1 probe:
    # stops at the first valid row)
    if require_rows and not streaming and src.isEmpty():
        raise ValueError("no valid date in the selected date column")

    text_raw = F.coalesce(col("text").cast("string"), F.lit(""))
    norm_src = F.coalesce(col("text_norm").cast("string"), text_raw) if has("text_norm") else text_raw
    author = F.regexp_replace(trim_ws(F.coalesce(col("author").cast("string"), F.lit(C.DEFAULT_AUTHOR))), "^@+", "")

    metrics = {}
    for name in C.METRIC_COLUMNS:
        if has(name):
            t = types[f"src_{name}"]
            metrics[name] = safe_double(col(name), "double" if isinstance(t, _NUMERIC) else "string")
        else:
            metrics[name] = F.lit(0.0)

    etype = (F.upper(trim_ws(F.coalesce(col("engagement_type").cast("string"), F.lit(C.DEFAULT_ENGAGEMENT_TYPE))))
             if has("engagement_type") else F.lit(C.DEFAULT_ENGAGEMENT_TYPE))
    sentiment = (F.lower(trim_ws(F.coalesce(col("sentiment").cast("string"), F.lit(C.DEFAULT_SENTIMENT))))
                 if has("sentiment") else F.lit(C.DEFAULT_SENTIMENT))
    reposted = col("repost_of").isNotNull() if has("repost_of") else F.lit(False)

    def tokens(logical: str, sigil: str) -> Column:
        from_text = extract_tokens(F.col("text_raw"), sigil)
        if has(logical):
            from_col = F.coalesce(extract_tokens(col(logical).cast("string"), sigil), F.array().cast("array<string>"))
            from_text = F.concat(from_col, from_text)
        return F.array_sort(F.array_distinct(from_text))

    if not has("post_id"):
        post_id = F.xxhash64(*[F.col(f"`{c}`") for c in src.columns])
    elif isinstance(types["src_post_id"], _INTEGRAL):
        post_id = col("post_id").cast("bigint")
    else:
        post_id = col("post_id").cast("string")

    buckets = time_buckets(F.col("dt"))
    stage1 = src.select(
        post_id.alias("post_id"),
        "dt",
        *[c.alias(k) for k, c in buckets.items()],
        text_raw.alias("text_raw"),
        fold_lower(norm_src, exact=exact_accents).alias("text_norm"),
        F.when(author == "", F.lit(C.DEFAULT_AUTHOR)).otherwise(author).alias("author"),
        *[c.alias(k) for k, c in metrics.items()],
        etype.alias("engagement_type"),
        reposted.alias("_reposted"),
        sentiment.alias("sentiment"),
        *[col(x) for x in ("hashtags", "mentions") if has(x)],
    )
    is_rt = (F.col("engagement_type").rlike(C.RETWEET_TYPE_PATTERN) | F.col("_reposted")
             | F.col("text_raw").startswith(C.RETWEET_TEXT_PREFIX))
    is_reply = F.col("engagement_type").rlike(C.REPLY_TYPE_PATTERN)
    is_quote = F.col("engagement_type").rlike(C.QUOTE_TYPE_PATTERN)
    stage2 = stage1.select(
        "post_id", "dt", *buckets.keys(), "text_raw", "text_norm", "author", *C.METRIC_COLUMNS,
        (F.col("likes") + F.col("comments") + F.col("shares")).alias("engagement_total"),
        "engagement_type",
        is_rt.alias("is_retweet"), is_reply.alias("is_reply"), is_quote.alias("is_quote"),
        (~(is_rt | is_reply | is_quote)).alias("is_original"),
        "sentiment",
        tokens("hashtags", "#").alias("hashtags_list"),
        tokens("mentions", "@").alias("mentions_list"),
        *narrative_columns(F.col("text_norm"), lexicon),
        *([copy_fingerprint(F.col("text_raw"), C.COPY_FINGERPRINT_CHARS).alias("fingerprint")]
          if with_fingerprint else []),
    )
    stage3 = stage2.select(
        *[c for c in stage2.columns if c != "mentions_list"],
        F.array_join("hashtags_list", " ").alias("hashtags_joined"),
        "mentions_list",
        narratives_array(lexicon).alias("narratives"),
    ).withColumn("main_narrative", F.col("narratives")[0])
    if not with_risk:
        return stage3
    if streaming or reach_p95 is not None:
        p95 = stage3.sparkSession.createDataFrame([(reach_p95,)], "reach_p95 double")
        return with_risk_level(stage3, lexicon, p95=p95)
    return with_risk_level(stage3, lexicon, approx_p95=approx_p95)


def reach_quantile(df: DataFrame, q: float = C.REACH_QUANTILE, approx: bool = False) -> DataFrame:
    """One-row DataFrame with the corpus reach quantile (linear interpolation).

    Exact by default, without funnelling every distinct value through one
    task (what Spark's ``percentile`` does in its final merge): see
    :func:`exact_quantile`.  ``approx`` merges one KLL sketch a date."""
    if approx:
        return merge_reach(reach_sketches(df)).select(quantile_of(F.col("sketch"), F.lit(q)).alias("reach_p95"))
    value = exact_quantile(df, "reach", q)
    return df.sparkSession.createDataFrame([(value,)], "reach_p95 double")


def exact_quantile(df: DataFrame, col: str, q: float) -> float | None:
    """Exact ``q`` quantile (numpy 'linear') by distributed selection.

    Values are counted first (combined map-side, so a value that holds most
    rows is one counted row), and the (value, count) rows are range-partitioned.
    One row per partition goes to the driver and tells which partitions hold
    the two order statistics; only those are ranked.  The source column is
    read once, whatever its values, and no task holds more than one range."""
    counted = (df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
               .groupBy("v").agg(F.count(F.lit(1)).alias("c")).persist())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counted.repartitionByRange(parts, "v").withColumn("p", F.spark_partition_id()).persist()
    try:
        sizes = sorted(ranged.groupBy("p").agg(F.min("v").alias("lo"), F.sum("c").alias("n")).collect(),
                       key=lambda r: r["lo"])
        n = sum(r["n"] for r in sizes)
        if n == 0:
            return None
        pos = q * (n - 1)
        t = pos - int(pos)
        a, b = (_order_statistic(ranged, sizes, r) for r in (int(pos), min(int(pos) + 1, n - 1)))
    finally:
        ranged.unpersist()
        counted.unpersist()
    return b - (b - a) * (1 - t) if t >= 0.5 else a + (b - a) * t


def _order_statistic(ranged: DataFrame, sizes: list, rank: int) -> float:
    """The value at 0-based ``rank``; ``sizes`` has the rows of each range in order."""
    for r in sizes:
        if rank < r["n"]:
            upto = Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
            ranked = ranged.where(F.col("p") == r["p"]).withColumn("upto", F.sum("c").over(upto))
            return ranked.where(F.col("upto") > rank).agg(F.min("v")).first()[0]
        rank -= r["n"]
    raise ValueError("rank beyond the last value")


def with_risk_level(df: DataFrame, lexicon: Sequence[C.Narrative] = C.DEFAULT_LEXICON,
                    approx_p95: bool = False, p95: DataFrame | None = None) -> DataFrame:
    """risk = 1 + #sensitive narratives + 1 if negative + 0.5 if retweet
    + 1 if reach >= corpus p95 (p95 > 0); half-even rounded, clamped 1..5."""
    if p95 is None:
        p95 = reach_quantile(df, approx=approx_p95)
    sensitive = [F.col(narrative_flag_name(n.label)).cast("int") for n in lexicon if n.sensitive]
    score = (F.lit(1.0) + sum(sensitive, F.lit(0))
             + F.when(F.col("sentiment").isin(*C.NEGATIVE_SENTIMENTS), 1.0).otherwise(0.0)
             + F.when(F.col("is_retweet"), 0.5).otherwise(0.0)
             + F.when((F.coalesce(F.col("reach_p95"), F.lit(0.0)) != 0) & (F.col("reach") >= F.col("reach_p95")),
                      1.0).otherwise(0.0))
    risk = F.least(F.lit(5.0), F.greatest(F.lit(1.0), round_even(score))).cast("int")
    return df.crossJoin(F.broadcast(p95)).withColumn("risk_level", risk).drop("reach_p95")


def explode_narratives(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per (post, narrative).  Select the needed columns first: the
    explode multiplies rows by at most the lexicon size."""
    keep = [c for c in (cols or df.columns) if c != "narratives"]
    # narratives is never empty, so the outer form yields the same rows and
    # keeps the optimizer from pushing a size() filter into the text pipeline
    return df.select(*keep, F.explode_outer("narratives").alias("narrative"))
