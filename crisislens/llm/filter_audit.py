"""Filter interaction audit over failing-id relations.

Every filter has one stored table with the ids of the rows that fail it, made
from a single pass over the texts.  All else is joins of ids.

* ``survivors``, ``removals`` and ``redundant`` give the ids that one prefix of an
  order keeps, that its next filter removes, and that this filter would remove had
  an earlier one not done so: left-anti joins with the tables of the prefix,
  left-semi joins with the filter's own.
* ``cells`` splits all rows along the tables, one left-semi and one left-anti join
  a filter, into the cells of rows that fail exactly the same filters.  A prefix of
  any order keeps whole cells, so the survivors, removals, redundancies and label
  losses of all orders are sums over cells: k filters take 2 k joins, not a join
  for each of the k! orders and their steps.
* ``audit`` adds up the cells for every order and step.

Filters are conditions, as Columns or SQL, on the ``measures`` of a text, true for a row that fails, or
REPEATED for a text that a row with a smaller key has too.  A row's id is given
once, when the measures are written; repeated rows are rows of their own.

Cases: a null text counts as empty; a null part is the empty string; a null key is
smaller than none and larger than none, so its row fails REPEATED never, nor does
another row on its account; rows with equal key and text do not repeat each other;
a document is good or toxic if any of its labels says so, a null label says
nothing; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import stored

MAX_FILTERS = 6                  # k! orders come out
REPEATED = "repeated"
SPACES = " \t\n\x0b\x0c\r"       # fixed value: what stands between words


def measures(text: Column) -> dict[str, Column]:
    """Native measures of a text that conditions can use."""
    t = F.coalesce(text, F.lit(""))
    inner = F.btrim(t, F.lit(SPACES))
    words = F.split(inner, r"[\x20\x09-\x0D]+", -1)
    return {
        "n_chars": F.length(t),
        "n_words": F.when(inner == "", 0).otherwise(F.size(words)),
        "n_distinct": F.when(inner == "", 0).otherwise(F.size(F.array_distinct(words))),
        "n_capitals": F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", "")),
        "has_symbol": t.rlike(r"[#$%&*|]"),
    }


def numbered(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, key, part, digest, measures) of every row, stored: the one pass over the texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    return stored(docs.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), F.coalesce(F.col(part), F.lit("")).alias("part"),
                              F.unhex(F.sha2(t, 256)).alias("digest"), *[c.alias(n) for n, c in measures(F.col(text)).items()]), "audit-rows")


def later_copies(rows: DataFrame) -> DataFrame:
    """(id): rows whose text a row with a smaller key has too.

    Those that are not the first of their text by (digest, key); no join is on
    the digest alone, so a text that a third of all rows share is no hot key.
    """
    first = rows.groupBy("digest").agg(F.min("key").alias("key")).where("key is not null")
    return rows.where("key is not null").join(first, ["digest", "key"], "left_anti").select("id")


def failing_ids(rows: DataFrame, filters: dict[str, Column | str]) -> dict[str, DataFrame]:
    """One stored table (id) for each filter."""
    return {name: stored(later_copies(rows) if isinstance(f, str) and f == REPEATED else rows.where(f).select("id"), f"audit-fails-{name}") for name, f in filters.items()}


def survivors(rows: DataFrame, failing: dict[str, DataFrame], prefix: str | list[str]) -> DataFrame:
    """The rows that pass every filter of a prefix."""
    for name in prefix:
        rows = rows.join(failing[name], "id", "left_anti")
    return rows


def removals(rows: DataFrame, failing: dict[str, DataFrame], prefix: str | list[str], name: str) -> DataFrame:
    """The rows that a filter removes behind a prefix."""
    return survivors(rows.join(failing[name], "id", "left_semi"), failing, prefix)


def redundant(rows: DataFrame, failing: dict[str, DataFrame], prefix: str | list[str], name: str) -> DataFrame:
    """The rows that fail a filter and that the prefix has removed before."""
    fails = rows.join(failing[name], "id", "left_semi")
    return fails.join(survivors(fails, failing, prefix).select("id"), "id", "left_anti")


def cells(rows: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """``rows`` with the column ``mask``, one bit for each filter that a row fails, in the filters' order."""
    now = rows.withColumn("mask", F.lit(0))
    for bit, (name, ids) in enumerate(failing.items()):
        fails = now.join(ids, "id", "left_semi").withColumn("mask", F.col("mask").bitwiseOR(F.lit(1 << bit)))
        now = stored(fails.unionAll(now.join(ids, "id", "left_anti")), f"audit-cells-{name}")
    return now


def labelled(rows: DataFrame, labels: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """(id, part, good, toxic) of every row."""
    if labels is None:
        return rows.select("id", "part", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    said = labels.groupBy(F.col(key).alias("key")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return rows.join(said, "key", "left").select("id", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def steps(names: list[str]) -> list[dict]:
    """The order, the step, the filter's bit and the bits of the filters in front, for every step of every order of the filters."""
    out = []
    for order in permutations(range(len(names))):
        before = 0
        for i, f in enumerate(order):
            out.append({"filter_order": "".join(names[x] for x in order), "step": i + 1, "bit": 1 << f, "before": before})
            before |= 1 << f
    return out


def audit(docs: DataFrame, filters: dict[str, Column | str], labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order of the filters.

    ``shapley`` is a filter's removals summed over all orders: of the orders of
    the filters that a row fails, every one of them comes first equally often.
    """
    names = list(filters)
    if not 1 <= len(names) <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters")
    rows = numbered(docs, key, text, part)
    split = cells(labelled(rows, labels, key), failing_ids(rows, filters))
    one = lambda c: F.sum(F.col(c).cast("long"))
    summed = split.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), one("good").alias("good"), one("toxic").alias("toxic"))
    # at most 2^k cells a part
    per_part = summed.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    table = F.from_json(F.lit(json.dumps(steps(names))), "array<struct<filter_order string, step int, bit int, before int>>")
    each = per_part.select("part", "cells", F.inline(table))

    def total(field: str, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(where(c["mask"]), c[field]).otherwise(F.lit(0).cast("long")))

    has = lambda m, bits: m.bitwiseAND(bits) != 0
    bit, before = F.col("bit"), F.col("before")
    gone = lambda m: has(m, bit) & ~has(m, before)
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(has(c["mask"], bit), (c["n"] * F.lit(factorial(len(names))) / F.bit_count(c["mask"])).cast("long")).otherwise(F.lit(0).cast("long")))
    return each.select("part", "filter_order", "step", total("n", lambda m: ~has(m, bit.bitwiseOR(before))).alias("kept"), total("n", gone).alias("removed"),
                       total("n", lambda m: has(m, bit) & has(m, before)).alias("redundant"), total("n", lambda m: m == bit).alias("unique_fails"),
                       total("good", gone).alias("good_lost"), total("toxic", gone).alias("toxic_lost"), share.alias("shapley"))
