"""A table in global order, where each task also sees the rows next to its own."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_key(c: Column) -> Column:
    """A string that sorts as the long does; null sorts first."""
    return F.coalesce(F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(2**63)).cast("long"))), 16, "0"), F.lit(""))


def in_order(df: DataFrame, key: Column, before: bool = False, wrap: bool = False) -> DataFrame:
    """``df`` in ranges of the string ``key``, sorted, with the columns _k, _part, _halo.

    A first pass over the keys alone finds the ranges and their outer keys, a
    few strings for each partition.  Behind the rows of a range comes the first
    row of the next one, marked _halo; with ``before``, the last row of the
    range in front precedes them.  With ``wrap`` the first row of all follows
    the last.  Rows with equal keys may come as several halo rows.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_k", key)

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = None, None
        for batch in batches:
            if batch.num_rows:
                m = pc.min_max(batch.column(0).cast(pa.large_binary())).as_py()
                lo, hi = m["min"] if lo is None else min(lo, m["min"]), m["max"] if hi is None else max(hi, m["max"])
        if lo is not None:
            yield pa.RecordBatch.from_arrays([pa.array([lo.decode()]), pa.array([hi.decode()])], ["lo", "hi"])

    found = keyed.select("_k").repartitionByRange(n, "_k").mapInArrow(outer, "lo string, hi string").collect()
    edges = sorted((r["lo"], r["hi"]) for r in found)
    lows, highs = [lo for lo, _ in edges], [hi for _, hi in edges]
    shared = spark.sparkContext.broadcast((lows, highs))

    @F.pandas_udf("array<int>")
    def places(k: pd.Series) -> pd.Series:
        """Part, then twice the part and its side for each halo place."""
        lows, highs = shared.value
        out = []
        for x in k:
            p = max(0, bisect_right(lows, x) - 1)
            to = [p * 4]
            if x == lows[p] and p:
                to.append((p - 1) * 4 + 2)
            if wrap and x == lows[0]:
                to.append((len(lows) - 1) * 4 + 3)
            if before and x == highs[p] and p + 1 < len(lows):
                to.append((p + 1) * 4 + 1)
            out.append(to)
        return pd.Series(out)

    placed = keyed.withColumn("_to", F.explode(places("_k")))
    side = F.col("_to").bitwiseAND(3)
    # in order of place: the row in front, the range's own, the row behind, the first of all
    rank = F.when(side == 1, 0).when(side == 0, 1).otherwise(side)
    ranked = placed.withColumns({"_part": F.shiftright("_to", 2), "_halo": side != 0, "_rank": rank}).drop("_to")
    return ranked.repartitionById(max(1, len(edges)), F.col("_part")).sortWithinPartitions("_part", "_rank", "_k")
