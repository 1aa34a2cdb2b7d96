"""URL filter: host and path rules, then a blocklist of canonical URLs.

The blocklist goes through a blocked Bloom filter (512-bit blocks, 8 bits a
URL).  Its size follows the list up to ``MAX_FILTER_MB``, so what is broadcast
is bounded; a longer list only raises the share of possible hits.  Possible
hits meet the list in an exact hash join, which removes every false positive,
so the verdicts are the same at any filter size.

Cases: a null url, or one without ``://``, has an empty host and path, no rule
and verdict allow; an empty list blocks nothing; repeated rows give repeated
rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FILTER_MB = 64
BITS_PER_URL = 16
BLOCK_WORDS = 8                  # 64-bit words of a block
PROBES = 8

ABC, abc = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), ABC, abc)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, query without utm_ parameters; no scheme, no fragment.

    Null where the url is null or has no ``://``.
    """
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), r"(^|&)utm_[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    whole = F.concat(F.regexp_replace(url_host(url), r"^www\.", ""), F.regexp_replace(url_path(url), "/+$", ""),
                     F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.contains("://"), whole)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null without one.

    ``rules`` has (verdict, host, path); a rule fits its host and all
    subdomains when the path starts with its own.  Of equally long rules the
    first in text order wins.  The list is configuration, a few dozen rules.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _probe(h: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, words and bit masks of each 64-bit hash (one row of PROBES bits a hash)."""
    h = h.astype(np.int64).view(np.uint64)
    block = ((h >> np.uint64(32)) % np.uint64(n_blocks)).astype(np.int64)
    salt = (np.arange(1, PROBES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    bit = (h[:, None] * salt[None, :]) >> np.uint64(55)
    return block, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))


def build_filter(hashes: DataFrame, n_blocks: int) -> np.ndarray:
    """The filter's words from one long column ``h``: tasks make block masks, which Spark ORs by block and word."""

    def masks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            block, word, mask = _probe(pdf["h"].to_numpy(), n_blocks)
            yield pd.DataFrame({"slot": (block[:, None] * BLOCK_WORDS + word).ravel(), "mask": mask.ravel().view(np.int64)})

    words = np.zeros(n_blocks * BLOCK_WORDS, np.uint64)
    table = hashes.select("h").mapInPandas(masks, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    words[table["slot"].to_numpy()] = table["mask"].to_numpy(np.int64).view(np.uint64)
    return words


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id",
                url: str = "url", max_filter_mb: int = MAX_FILTER_MB) -> DataFrame:
    """(key, host, path, rule, verdict, possible_hit, listed) of every row of ``pages``.

    ``listed`` has a column ``url`` with the URLs to block, in any spelling.
    A rule's verdict goes before the list's.
    """
    spark = pages.sparkSession
    block_list = listed.select(canonical_url(F.col("url")).alias("c")).where("c is not null").distinct()
    hashes = block_list.select(F.xxhash64("c").alias("h"))
    n_blocks = max(1, min(hashes.count() * BITS_PER_URL, max_filter_mb << 23) // (BLOCK_WORDS * 64))
    words = spark.sparkContext.broadcast(build_filter(hashes, n_blocks))

    @F.pandas_udf("boolean")
    def possible(h: pd.Series) -> pd.Series:
        if not len(h):
            return pd.Series([], dtype=bool)
        block, word, mask = _probe(h.to_numpy(), n_blocks)
        return pd.Series(((words.value[block[:, None] * BLOCK_WORDS + word] & mask) == mask).all(axis=1))

    u = F.col(url)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = (pages.select(F.col(key), url_host(u).alias("host"), url_path(u).alias("path"), canonical_url(u).alias("_c"))
              .withColumns({"rule": rule, "_rv": verdict})
              .withColumn("possible_hit", F.col("_c").isNotNull() & possible(F.xxhash64("_c"))))
    hits = judged.where("possible_hit").join(block_list.withColumnRenamed("c", "_c").withColumn("_l", F.lit(True)), "_c", "left")
    rest = judged.where("not possible_hit").withColumn("_l", F.lit(None).cast("boolean"))
    cols = [key, "host", "path", "rule", "_rv", "possible_hit", "_l"]
    return hits.select(*cols).unionAll(rest.select(*cols)).select(
        key, "host", "path", "rule",
        F.coalesce("_rv", F.when(F.coalesce("_l", F.lit(False)), "block").otherwise("allow")).alias("verdict"),
        "possible_hit", F.coalesce("_l", F.lit(False)).alias("listed"))
