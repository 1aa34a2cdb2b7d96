"""Records that tasks pre-aggregate into one packed row for each part of the key space.

A corpus has hundreds of millions of shingles or anchors; as single rows they
would cost several times their size in a shuffle.  A task therefore sorts the
records of a few megabytes of text by the top bits of their 64-bit key and
emits one binary row for each part that occurs.  Spark shuffles those rows by
part; the receiving task sees every record of its parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import shuffles_released

PACKED = "part int, blob binary"


def part_bits(spark: SparkSession) -> int:
    """Bits of the key that name a part: some two parts for each shuffle partition, 64 at least."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(6, (2 * n - 1).bit_length())


def scatter(keys: np.ndarray, records: np.ndarray, bits: int) -> pa.RecordBatch:
    """One (part, blob) row for each part; ``records`` is an array with one element for each key."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, records = part[order], records[order]
    heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(part))[:len(heads)]
    return pa.RecordBatch.from_arrays([pa.array(part[heads], pa.int32()), pa.array([records[a:b].tobytes() for a, b in zip(heads, ends, strict=True)], pa.binary())], ["part", "blob"])


def gather(packed: DataFrame, dtype: np.dtype, bits: int, work: Callable[[int, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work(part, records)`` on all records of each part.

    The part number itself is the shuffle partition, so parts are spread evenly;
    a task holds the records of one part at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            parts = batch.column(0).to_numpy()
            heads = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1]))) if len(parts) else []
            for a, b in zip(heads, np.append(heads[1:], len(parts)), strict=True):
                if held and parts[a] != now:
                    yield from work(now, np.frombuffer(b"".join(held), dtype))
                    held = []
                now = int(parts[a])
                held += [x.as_buffer() for x in batch.column(1).slice(a, b - a)]
        if held:
            yield from work(now, np.frombuffer(b"".join(held), dtype))

    return packed.repartitionById(1 << bits, F.col("part")).sortWithinPartitions("part").mapInArrow(run, schema)


def slot_bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """2^bits flags, as packed bits: the top bits of the long keys that occur.

    The size is fixed by ``bits``; with more keys than slots the flags only say
    yes more often.  Spark ORs words of 64 flags; the driver sees the words.
    """
    slot = F.shiftrightunsigned(column, 64 - bits)
    with shuffles_released(df.sparkSession):
        words = (df.where(F.col(column).isNotNull()).select(F.shiftright(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("m"))
                 .groupBy("w").agg(F.bit_or("m").alias("m")).toArrow())
    flags = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
    flags[words.column("w").to_numpy()] = np.ascontiguousarray(words.column("m").to_numpy()).view(np.uint64)
    return flags


def flagged(flags: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether the slot of each 64-bit key is set."""
    slot = keys >> np.uint64(64 - bits)
    return (flags[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def marker(spark: SparkSession, flags: np.ndarray, bits: int):
    """A Column function that tells whether the slot of a long is set; the flags are broadcast."""
    shared = spark.sparkContext.broadcast(flags)

    @F.pandas_udf("boolean")
    def marked(h: pd.Series) -> pd.Series:
        return pd.Series(flagged(shared.value, h.to_numpy(np.int64).view(np.uint64), bits))

    return marked


def _meant(rows: DataFrame, listed: DataFrame, key: str, bits: int):
    """Whether a row's string ``key`` may be in ``listed``, by a table of fixed size."""
    marked = marker(rows.sparkSession, slot_bitmap(listed.select(F.xxhash64(key).alias("h")), "h", bits), bits)
    return marked(F.xxhash64(key))


def without(rows: DataFrame, gone: DataFrame, key: str, bits: int = 26) -> DataFrame:
    """``rows`` without those whose string ``key`` is in ``gone``.

    Only rows that may be meant, hardly more than those that go, are shuffled to
    meet the exact list.
    """
    may = _meant(rows, gone, key, bits)
    return rows.where(~may).unionByName(rows.where(may).join(gone.select(key), key, "left_anti"))


def only(rows: DataFrame, wanted: DataFrame, key: str, bits: int = 26) -> DataFrame:
    """``rows`` whose string ``key`` is in ``wanted``; only rows that may be meant are shuffled."""
    return rows.where(_meant(rows, wanted, key, bits)).join(wanted.select(key), key, "left_semi")
