"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of a text; it depends on the last 32 bytes
only, so a boundary moves with its content.  Chunking is normalised: below
NORMAL bytes a boundary needs more hash bits to be zero than above, from MIN on
and up to MAX bytes.  The fingerprint is the set of chunk digests (40 bits), each with its
length, as sorted hexadecimal; two texts share the chunks of their common
passages wherever these stand.  ``likeness`` weighs digests by length: the
length of the shared chunks over that of the smaller set, a containment.

Cases: a null text counts as empty; an empty text has the empty fingerprint,
like itself (1) and unlike any other (0); equal texts have equal fingerprints;
rows with equal keys follow each other in the order of a hash of their text;
repeated rows give repeated rows; extra columns are left out; a single row is
its own next one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import slices, span_hash, text_bytes
from .ordering import in_order, number_key

MIN, NORMAL, MAX = 12, 32, 128
HARD, EASY = np.uint32(0xFC000000), np.uint32(0xE0000000)     # 6 zero bits below NORMAL, 3 from there on
WINDOW = 32

_GEAR = np.append(np.random.Generator(np.random.PCG64(4242)).integers(0, 1 << 32, 256, dtype=np.uint32), np.uint32(0))


def gear(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rolling hash behind each byte; a row sees nothing of the row in front."""
    rows, n = len(offsets) - 1, len(raw)
    shift = np.repeat(np.arange(1, rows + 1) * WINDOW, np.diff(offsets))
    padded = np.full(n + rows * WINDOW, 256, np.uint16)
    at = np.arange(n) + shift
    padded[at] = raw
    h = _GEAR[padded]
    for w in (1, 2, 4, 8, 16):
        h[w:] = h[w:] + (h[:-w] << np.uint32(w))
    return h[at]


def cuts(hard: list[int], easy: list[int], start: int, end: int) -> list[int]:
    """Chunk ends of the bytes start..end; ``hard`` and ``easy`` are the sorted ends that the masks allow."""
    out, s, nh, ne = [], start, len(hard), len(easy)
    i = j = 0
    while end - s > MIN:
        i = bisect_left(hard, s + MIN, i)
        if i < nh and hard[i] < s + NORMAL and hard[i] < end:
            s = hard[i]
        else:
            j = bisect_left(easy, s + NORMAL, j)
            s = easy[j] if j < ne and easy[j] < s + MAX else s + MAX
            if s >= end:
                break
        out.append(s)
    if not out or out[-1] < end:
        out.append(end)
    return out


def chunk(raw: np.ndarray, offsets: np.ndarray, starts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, digests, bounds): chunks of row i are bounds[i]..bounds[i+1]; ``starts`` are first bytes to chunk."""
    h = gear(raw, offsets)
    hard, easy = np.flatnonzero(h & HARD == 0) + 1, np.flatnonzero(h & EASY == 0) + 1
    hb, eb = np.searchsorted(hard, offsets, "right"), np.searchsorted(easy, offsets, "right")
    hard, easy = hard.tolist(), easy.tolist()
    begins, ends, counts = [], [], [0]
    for r in range(len(offsets) - 1):
        a = int(offsets[r]) + (starts[r] if starts else 0)
        b = int(offsets[r + 1])
        c = cuts(hard[hb[r]:hb[r + 1]], easy[eb[r]:eb[r + 1]], a, b) if b > a else []
        ends += c
        begins += [a, *c[:-1]] if c else []
        counts.append(len(c))
    begins, ends = np.array(begins, np.int64), np.array(ends, np.int64)
    digest = span_hash(raw, begins, ends) >> np.uint64(24) << np.uint64(8) | (ends - begins).astype(np.uint64)
    return ends, digest, np.cumsum(counts)


def as_text(digests: np.ndarray) -> str:
    """The fingerprint of a text from the sorted distinct digests."""
    return digests.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Length of the shared chunks over the length of the smaller set; 1 for two empty sets, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.intersect1d(a, b, assume_unique=True)
    low = np.uint64(255)
    return float((both & low).sum()) / float(min((a & low).sum(), (b & low).sum()))


def parse(fingerprint: str) -> np.ndarray:
    """The digests of a fingerprint, for ``likeness``."""
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in slices(batch, text):
                _, digests, bounds = chunk(raw, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([as_text(np.unique(digests[bounds[i]:bounds[i + 1]])) for i in range(part.num_rows)])], [key, "fingerprint"])

    return df.select(key, text).mapInArrow(work, f"`{key}` {df.schema[key].dataType.simpleString()}, fingerprint string")


def _edited(texts: list[str], nexts: list[str]) -> list[tuple[str, str]]:
    """(kept head, new tail) of each text: its last quarter gives way to the first characters of the next one."""
    return [(t[:len(t) - len(t) // 4], n[:len(t) // 4]) for t, n in zip(texts, nexts, strict=True)]


def compare_rows(texts: list[str], following: str) -> list[tuple]:
    """(n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of consecutive texts."""
    raw, offsets = text_bytes(pa.array([*texts, following], pa.string()))
    ends, digests, bounds = chunk(raw, offsets)
    sets = [np.unique(digests[bounds[i]:bounds[i + 1]]) for i in range(len(texts) + 1)]
    edited = _edited(texts, [*texts[1:], following])
    tails, starts, kept, shas = [], [], [], []
    for i, (head, tail) in enumerate(edited):
        head, tail = head.encode(), tail.encode()
        shas.append(hashlib.sha256(head + tail).hexdigest())
        own = ends[bounds[i]:bounds[i + 1]] - offsets[i]
        k = int(np.searchsorted(own, len(head), "right"))       # chunks that end within the head stay as they are
        if k and k == len(own):                                   # nothing was cut off
            kept.append(k)
            tails.append(tail)
            starts.append(0)
            continue
        s = int(own[k - 1]) if k else 0
        from_byte = max(0, s - WINDOW)
        kept.append(k)
        tails.append(head[from_byte:] + tail)
        starts.append(s - from_byte)
    traw, toffs = text_bytes_of(tails)
    _, tdig, tb = chunk(traw, toffs, starts)
    out = []
    for i, t in enumerate(texts):
        e = np.unique(np.concatenate([digests[bounds[i]:bounds[i] + kept[i]], tdig[tb[i]:tb[i + 1]]]))
        out.append((len(t), shas[i], as_text(sets[i]), as_text(e), likeness(sets[i], e), likeness(sets[i], sets[i + 1])))
    return out


def text_bytes_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def compare(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text ends in the beginning of the next row's text, in ascending
    order of the key; the first row follows the last.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    ordered = in_order(docs.select(key, F.coalesce(text, F.lit("")).alias("_text")), F.concat(number_key(F.col(key)), number_key(F.xxhash64("_text"))), wrap=True)

    def emit(held: list[tuple], following: str) -> pa.RecordBatch:
        rows = compare_rows([t for _, t in held], following)
        kind = held_type[0]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], kind), *(pa.array(c) for c in zip(*rows, strict=True))], names)

    held_type: list = [pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []       # own rows in order, whose last one waits for its next
        for batch in batches:
            held_type[0] = batch.column(0).type
            for part, _, _ in slices(batch, "_text"):
                for k, t, halo in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if halo:
                        if held:
                            yield emit(held, t)
                            held = []
                        continue
                    held.append((k, t))
                if len(held) > 1:
                    yield emit(held[:-1], held[-1][1])
                    held = held[-1:]

    return ordered.select(key, "_text", "_halo").mapInArrow(work, schema)
