"""Repeated-string removal over a whole corpus, by suffix sorting of what may repeat.

Each byte that is covered by a 100-byte string that also starts earlier
(smaller key, or same row and earlier start) is removed; strings are judged on
the input and never cross texts.

1. Every 100-byte string holds an anchor chosen by its bytes alone (anchors.py),
   so equal strings meet at equal anchors.  Anchors with the hash of the bytes
   they serve are shuffled packed (packed.py).  Of several with equal bytes all
   but the first are removed at once; only first ones whose anchor also occurs
   in other bytes go on.
2. Their bytes are fetched and meet by anchor.  Within an anchor the strings are
   split by how far they begin in front of it, in steps of STEP bytes, and by the
   hash of the bytes that all strings of a step cover.
3. What still differs in a step is joined to one text and suffix-sorted by linear
   grouping (suffix_array.py).  Strings that are neighbours in the suffix array
   and equal in all 100 bytes repeat; all but the first are removed.
4. Removed strings are merged by text, and the text is cut.

A step with more than SORT_BYTES is split into single strings first, whose
groups hold equal strings only, so no suffix array grows with a group of copies.

Cases: a null text counts as empty; texts under 100 bytes stay whole; a null key
counts as the smallest; rows with equal keys come in the order of a hash of
their text, and rows with equal key and text count as one, each with the same
result; extra columns are left out; offsets are bytes of UTF-8, and a cut may
fall within a character, which is why the kept text is hashed as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import WINDOW, anchors, rolling, span_key
from .buffers import mix, slices
from .packed import PACKED, gather, marker, part_bits, scatter, slot_bitmap
from .stored import stored
from .suffix_array import suffix_array

STEP = 17
SORT_BYTES = 1 << 20
SLICE_BYTES = 1 << 20            # text worked on at once when anchors are chosen
RUN_BYTES = 2 << 20              # fetched bytes compared at once, whole anchors
MARK_BITS = 26                   # slots of the table of rows with something to do (8 MB)

_ANCHOR = np.dtype([("key", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("th", "<i4"), ("lo", "<u4"), ("n", "u1"), ("at", "u1")])
_CUT = "doc long, th int, a long, b long"


def _row_key(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, th, _key, _text): texts that are long enough to hold a string have a row key, doc and th."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("doc"), F.hash(t).alias("th"), F.col(key).alias("_key"), t.alias("_text"))


def _cuts(doc: np.ndarray, th: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(doc, np.int64)), pa.array(np.asarray(th, np.int32)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], ["doc", "th", "a", "b"])


def meet_anchors(rows: DataFrame) -> DataFrame:
    """Removed strings (key null) and anchors whose bytes must be compared, over (doc, th, _text)."""
    bits = part_bits(rows.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in slices(batch, "_text", SLICE_BYTES):
                row, key, ctx, place, lo, hi = anchors(raw, offsets)
                if not len(row):
                    continue
                records = np.empty(len(row), _ANCHOR)
                records["key"], records["ctx"] = key, ctx
                records["doc"] = part.column(0).to_numpy(zero_copy_only=False)[row]
                records["th"] = part.column(1).to_numpy(zero_copy_only=False)[row]
                records["lo"], records["n"], records["at"] = lo, hi - lo, place - lo
                yield scatter(key, records, bits)

    def meet(_: int, r: np.ndarray) -> Iterator[pa.RecordBatch]:
        r = r[np.lexsort((r["lo"], r["th"], r["doc"], r["ctx"], r["key"]))]
        key_head = np.ones(len(r), bool)
        key_head[1:] = r["key"][1:] != r["key"][:-1]
        ctx_head = key_head.copy()
        ctx_head[1:] |= r["ctx"][1:] != r["ctx"][:-1]
        # equal rows count as one: an anchor is no copy of itself
        same = np.zeros(len(r), bool)
        same[1:] = ~ctx_head[1:] & (r["lo"][1:] == r["lo"][:-1]) & (r["doc"][1:] == r["doc"][:-1]) & (r["th"][1:] == r["th"][:-1])
        group = np.cumsum(key_head) - 1
        several = np.bincount(group[ctx_head])[group] > 1
        copy = ~ctx_head & ~same
        if same.any():                                   # a repeat of the first of its kind is no copy either
            leader = np.maximum.accumulate(np.where(ctx_head, np.arange(len(r)), 0))
            lead = r[leader]
            copy &= (r["doc"] != lead["doc"]) | (r["th"] != lead["th"]) | (r["lo"] != lead["lo"])
        ask = ctx_head & several
        for take, is_copy in ((copy, True), (ask, False)):
            x = r[take]
            lo = x["lo"].astype(np.int64)
            key = pa.nulls(len(x), pa.int64()) if is_copy else pa.array(x["key"].view(np.int64) if x["key"].flags.c_contiguous else np.ascontiguousarray(x["key"]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x["doc"])), pa.array(np.ascontiguousarray(x["th"])), pa.array(lo), pa.array(lo + x["n"] + WINDOW), pa.array(lo + x["at"]), key], ["doc", "th", "a", "b", "place", "key"])

    packed = rows.select("doc", "th", "_text").mapInArrow(emit, PACKED)
    return gather(packed, _ANCHOR, bits, meet, _CUT + ", place long, key long")


def fetch(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` with the bytes a..b of its rows in the column ``bytes``; a task delivers them once for repeated rows."""
    wanted = asked.groupBy("doc", "th").agg(F.collect_list(F.struct("a", "b", "place", "key")).alias("asked"))
    marked = marker(rows.sparkSession, slot_bitmap(asked.select(F.xxhash64("doc", "th").alias("h")), "h", MARK_BITS), MARK_BITS)
    texts = rows.where(F.length("_text") > 0).where(marked(F.xxhash64("doc", "th"))).select("doc", "th", "_text").join(wanted, ["doc", "th"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            new = []
            for i, row in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if row not in seen:
                    seen.add(row)
                    new.append(i)
            if len(new) < batch.num_rows:
                batch = batch.take(pa.array(new, pa.int64()))
            for part, raw, offsets in slices(batch, "_text"):
                asked = part.column(3).combine_chunks() if isinstance(part.column(3), pa.ChunkedArray) else part.column(3)
                flat = asked.flatten()
                sizes = np.asarray(asked.value_lengths())
                row = np.repeat(np.arange(part.num_rows), sizes)
                a, b = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                whole = raw.tobytes()
                base = offsets[row]
                blobs = [whole[x:y] for x, y in zip((a + base).tolist(), (b + base).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), flat.field(0), flat.field(2), flat.field(3), pa.array(blobs, pa.binary())], ["doc", "th", "a", "place", "key", "bytes"])

    return texts.mapInArrow(cut, "doc long, th int, a long, place long, key long, bytes binary")


def repeats(texts: list[bytes], windows: list[np.ndarray]) -> list[list[tuple[int, int]]]:
    """Groups of equal strings, as (text, start), over the strings of WINDOW bytes at the given starts of the texts.

    The texts are joined, with a symbol of its own behind each, and suffix-sorted;
    equal strings are neighbours among the suffixes that start at one.
    """
    joined = b"\x00".join(texts)
    symbols = np.frombuffer(joined, np.uint8).astype(np.int64) + 1
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    symbols[begin[1:-1] - 1] = 0
    wanted = np.full(len(symbols), -1, np.int64)
    for i, w in enumerate(windows):
        wanted[begin[i] + w] = i
    order = np.array(suffix_array(symbols), np.int64)
    order = order[wanted[order] >= 0]
    views = np.lib.stride_tricks.sliding_window_view(np.frombuffer(joined, np.uint8), WINDOW)
    equal = np.concatenate([(views[order[i:i + 4096]][:-1] == views[order[i + 1:i + 4096]]).all(axis=1) for i in range(0, max(1, len(order) - 1), 4095)]) if len(order) > 1 else np.zeros(0, bool)
    heads = np.flatnonzero(np.concatenate(([True], ~equal)))
    out = []
    for a, b in zip(heads, np.append(heads[1:], len(order)), strict=True):
        if b - a > 1:
            out.append([(int(wanted[p]), int(p - begin[wanted[p]])) for p in order[a:b]])
    return out


def compare(held: pa.Table) -> Iterator[pa.RecordBatch]:
    """Removed strings among the fetched bytes of whole anchors: (doc, th, a, place, key, bytes)."""
    doc, th, a, place, key = (np.ascontiguousarray(held.column(c).to_numpy()) for c in ("doc", "th", "a", "place", "key"))
    blobs = held.column("bytes").to_pylist()
    sizes = np.array([len(x) for x in blobs], np.int64)
    raw = np.frombuffer(b"".join(blobs), np.uint8)
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    _, wide = rolling(raw)
    hi = a + sizes - WINDOW
    found: list[tuple] = []

    def decide(member: np.ndarray, group: np.ndarray, first: np.ndarray, last: np.ndarray, head: np.ndarray, sort: bool) -> np.ndarray:
        """Removes copies of whole regions; of the groups left, sorts the small ones and returns the members of others."""
        region = span_key(wide, base[member] + first - a[member], base[member] + last + WINDOW - a[member]) ^ mix((head - first).astype(np.uint64))
        order = np.lexsort((first, th[member], doc[member], region, group))
        member, group, region, first, last, head = (x[order] for x in (member, group, region, first, last, head))
        g_head = np.ones(len(member), bool)
        g_head[1:] = group[1:] != group[:-1]
        r_head = g_head.copy()
        r_head[1:] |= region[1:] != region[:-1]
        # an equal row that another task delivered is no copy
        lead = np.maximum.accumulate(np.where(r_head, np.arange(len(member)), 0)) if len(member) else np.zeros(0, np.int64)
        same = (doc[member] == doc[member[lead]]) & (th[member] == th[member[lead]]) & (first == first[lead])
        copies = np.flatnonzero(~r_head & ~same)
        if len(copies):
            found.append((doc[member[copies]], th[member[copies]], first[copies], last[copies] + WINDOW))
        member, group, first, last = (x[r_head] for x in (member, group, first, last))
        heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
        big: list[np.ndarray] = []
        for s, e in zip(heads.tolist(), np.append(heads[1:], len(group)).tolist(), strict=True):
            if e - s < 2:
                continue
            if not sort or int((last[s:e] - first[s:e] + WINDOW).sum()) > SORT_BYTES:
                big.append(member[s:e])
                continue
            m = member[s:e]
            texts = [blobs[i][x - a[i]:y + WINDOW - a[i]] for i, x, y in zip(m.tolist(), first[s:e].tolist(), last[s:e].tolist(), strict=True)]
            for equal in repeats(texts, [np.arange(n + 1) for n in (last[s:e] - first[s:e]).tolist()]):
                at = sorted((int(doc[m[i]]), int(th[m[i]]), int(first[s + i]) + p) for i, p in equal)
                rest = [x for x in at[1:] if x != at[0]]
                if rest:
                    d, t, p = zip(*rest, strict=True)
                    found.append((np.array(d), np.array(t), np.array(p), np.array(p) + WINDOW))
        return np.concatenate(big) if big else np.zeros(0, np.int64)

    def stepped(member: np.ndarray, step: int) -> np.ndarray:
        """One call of ``decide`` for each step of starts in front of the anchor; members of groups too big to sort."""
        late = []
        for back in range(0, WINDOW, step):
            head = place[member] - back                  # the latest start of the step
            first, last = np.maximum(a[member], head - step + 1), np.minimum(hi[member], head)
            ok = first <= last
            if not ok.any():
                continue
            m, f, t, h = member[ok], first[ok], last[ok], head[ok]
            core = span_key(wide, base[m] + h - a[m], base[m] + h - a[m] + WINDOW - step + 1)
            late.append(decide(m, mix(key[m].view(np.uint64)) ^ core, f, t, h, step > 1))
        return np.unique(np.concatenate(late)) if late else np.zeros(0, np.int64)

    if len(doc):
        left = stepped(np.arange(len(doc)), STEP)
        if len(left):
            stepped(left, 1)                             # a group is then one string; its copies are removed as regions
    if found:
        yield _cuts(*(np.concatenate(x) for x in zip(*found, strict=True)))


def removed(rows: DataFrame) -> DataFrame:
    """(doc, th, a, b): removed bytes, overlapping, over (doc, th, _text)."""
    met = stored(meet_anchors(rows), "anchors-met")
    contexts = fetch(rows, met.where("key is not null"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column("key").to_numpy()
            ends = np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy())
            heads = np.flatnonzero(np.concatenate(([key[0] != now], key[1:] != key[:-1])))
            a, done = 0, 0
            for h in heads.tolist():
                before = int(ends[h - 1]) if h else 0
                if size + before - done >= RUN_BYTES:            # an anchor begins, and enough is held
                    held.append(batch.slice(a, h - a))
                    yield from compare(pa.Table.from_batches(held))
                    held, size, a, done = [], 0, h, before
            held.append(batch.slice(a))
            size += int(ends[-1]) - done
            now = key[-1]
        if held:
            yield from compare(pa.Table.from_batches(held))

    n = 1 << part_bits(rows.sparkSession)
    late = contexts.repartition(n, "key").sortWithinPartitions("key").mapInArrow(work, _CUT)
    return met.where("key is null").select("doc", "th", "a", "b").unionAll(late)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` is the remaining bytes."""
    rows = _row_key(docs, key, text)
    gone = stored(removed(rows), "anchors-removed")
    merged = gone.groupBy("doc", "th").agg(F.collect_list(F.struct("a", "b")).alias("cuts"))
    marked = marker(rows.sparkSession, slot_bitmap(gone.select(F.xxhash64("doc", "th").alias("h")), "h", MARK_BITS), MARK_BITS)
    flagged_rows = rows.withColumn("_m", marked(F.xxhash64("doc", "th")))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    hit = flagged_rows.where("_m").join(merged, ["doc", "th"], "left").select("_key", "_text", F.coalesce("cuts", none).alias("cuts"))
    miss = flagged_rows.where("not _m").select("_key", "_text", none.alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in slices(batch, "_text"):
                n_bytes, n_removed, n_spans, kept = [], [], [], []
                for i, cuts in enumerate(part.column(2)):
                    t = raw[offsets[i]:offsets[i + 1]]
                    flat = cuts.values
                    n_bytes.append(len(t))
                    if not len(flat):
                        n_removed.append(0), n_spans.append(0), kept.append(t.tobytes())
                        continue
                    a, b = (np.sort(flat.field(j).to_numpy(zero_copy_only=False)) for j in (0, 1))
                    # with starts and ends sorted apart, a run ends where the next start lies behind the ends so far
                    heads = np.concatenate(([True], a[1:] > b[:-1]))
                    begin, stop = a[heads], b[np.append(np.flatnonzero(heads)[1:] - 1, len(b) - 1)]
                    gone = np.zeros(len(t) + 1, np.int8)
                    np.add.at(gone, begin, 1)
                    np.add.at(gone, stop, -1)
                    stay = np.cumsum(gone[:-1]) == 0
                    n_removed.append(int(len(t) - stay.sum())), n_spans.append(len(begin)), kept.append(t[stay].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], [key, "n_bytes", "n_removed", "n_spans", "kept"])

    return hit.unionAll(miss).mapInArrow(cut, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")
