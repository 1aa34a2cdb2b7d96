"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle sets, class c for sets
of more than 2^(c-1) and up to 2^c shingles.  For each class a document is cut
into blocks of 2^c shingles, and each two neighbouring blocks form a window, so
an item that occurs in a document lies within one window not much larger than
itself and the containment asked for means a Jaccard similarity that MinHash can
see.  A window and an item are candidates when one of PERMUTATIONS minima is
equal; candidates are verified by the exact containment of the item's shingles
in the whole document.

Document windows reach the shuffle only if a minimum is found in a table of
fixed size that holds the items' minima; so does a document's shingle only if
it may belong to an item.

Cases: null or empty texts and items match nothing; an item of one to four
words has one shingle, its sequence, and matches a text of the same words only;
repeated documents or items give repeated matches once per row; extra columns
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import mix, shingle_hashes, shingle_sets, slices, word_hashes
from .packed import flagged, slot_bitmap
from .stored import stored

THRESHOLD = (75, 100)            # share of an item's shingles that a document must hold
PERMUTATIONS = 48
TABLE_BITS = 26                  # slots of the tables of minima and of item shingles (8 MB each)

_rng = np.random.Generator(np.random.PCG64(99))
_TURN = _rng.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64)
_SCALE = _rng.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)


def size_class(n: int) -> int:
    return max(0, int(n - 1).bit_length())


def band_key(minimum: np.ndarray, permutation: int, klass: int) -> np.ndarray:
    return mix(minimum + np.uint64((permutation * 64 + klass + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def items_table(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item row, key, n, klass, tokens, keys): shingles and band keys of the non-empty items."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in slices(batch, text):
                sets = shingle_sets(raw, offsets)
                keep = [i for i, s in enumerate(sets) if len(s)]
                if not keep:
                    continue
                part = part.take(pa.array(keep))
                sets = [sets[i] for i in keep]
                classes = [size_class(len(s)) for s in sets]
                keys = [np.concatenate([band_key(((s ^ _TURN[j]) * _SCALE[j]).min(keepdims=True), j, c) for j in range(PERMUTATIONS)]).view(np.int64) for s, c in zip(sets, classes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int32()),
                     pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["_item", key, "n", "klass", "tokens", "keys"])

    return (items.select(F.monotonically_increasing_id().alias("_item"), key, text)
            .mapInArrow(work, f"_item long, `{key}` {items.schema[key].dataType.simpleString()}, n long, klass int, tokens array<long>, keys array<long>"))


def windows(tokens: np.ndarray, bounds: np.ndarray, klass: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, starts): the windows' rows and the first shingles of their blocks, for one size class."""
    n, size = np.diff(bounds), 1 << klass
    blocks = -(-n // size)
    row = np.repeat(np.arange(len(n)), blocks)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return row, bounds[row] + nth * size


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
           threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(key, item key, n_item, n_shared, containment) of every document row and item row that match."""
    spark = docs.sparkSession
    known = stored(items_table(items, item_key, item_text), "test-items")
    classes = sorted(r["klass"] for r in known.select("klass").distinct().collect())        # a few dozen at most
    minima = slot_bitmap(known.select(F.explode("keys").alias("k")), "k", TABLE_BITS)
    wanted = slot_bitmap(known.select(F.explode("tokens").alias("k")), "k", TABLE_BITS)
    shared = spark.sparkContext.broadcast((minima, wanted))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in slices(batch, text):
                tokens, bounds = shingle_hashes(*word_hashes(raw, offsets))
                if not len(tokens) or not classes:
                    continue
                grid = {c: windows(tokens, bounds, c) for c in classes}
                rows, keys = [], []
                for j in range(PERMUTATIONS):
                    turned = (tokens ^ _TURN[j]) * _SCALE[j]
                    for c, (row, starts) in grid.items():
                        least = np.minimum.reduceat(turned, starts)
                        least[:-1] = np.where(row[:-1] == row[1:], np.minimum(least[:-1], least[1:]), least[:-1])
                        k = band_key(least, j, c)
                        hit = np.flatnonzero(flagged(shared.value[0], k, TABLE_BITS))
                        rows.append(row[hit])
                        keys.append(k[hit])
                rows, keys = np.concatenate(rows), np.concatenate(keys)
                found = np.unique(rows)
                if not len(found):
                    continue
                in_item = flagged(shared.value[1], tokens, TABLE_BITS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(found)), part.column(1).take(pa.array(found)),
                     pa.array([np.unique(keys[rows == r]).view(np.int64) for r in found], pa.list_(pa.int64())),
                     pa.array([np.unique(tokens[bounds[r]:bounds[r + 1]][in_item[bounds[r]:bounds[r + 1]]]).view(np.int64) for r in found], pa.list_(pa.int64()))],
                    ["_row", key, "keys", "held"])

    hits = stored(docs.select(F.monotonically_increasing_id().alias("_row"), key, text)
                  .mapInArrow(work, f"_row long, `{key}` {docs.schema[key].dataType.simpleString()}, keys array<long>, held array<long>"), "test-hits")
    by_key = known.select("_item", F.explode("keys").alias("k"))
    candidates = hits.select("_row", F.explode("keys").alias("k")).join(by_key, "k").select("_row", "_item").distinct()
    t, of = threshold
    name = "_item_key" if item_key == key else item_key
    side = known.select("_item", F.col(item_key).alias(name), F.col("n").alias("n_item"), "tokens")
    return (candidates.join(hits.select("_row", key, "held"), "_row").join(side, "_item")
            .withColumn("n_shared", F.size(F.array_intersect("held", "tokens")).cast("long"))
            .where(F.col("n_shared") * of >= F.col("n_item") * t)
            .select(key, name, "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment")))
