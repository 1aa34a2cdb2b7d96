"""Array helpers on Arrow text columns: words, shingles and hashes of whole texts.

Spark partitions and shuffles the rows; these helpers only turn one Arrow
batch of texts into arrays, a few megabytes at a time.  Texts are handled as
the UTF-8 bytes they arrive in.  A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20            # texts are worked on in slices of about this many bytes
PIECE_BYTES = 1 << 19            # spans are hashed in pieces of about this many bytes: each byte takes some 50 while it is worked on
SHINGLE_WORDS = 5

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 64, 1024, dtype=np.uint64) | np.uint64(1)
_JOIN = _rng.integers(0, 1 << 64, SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; row i is bytes[offsets[i]:offsets[i+1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of a batch holding about ``limit`` bytes of text (one row at least)."""
    raw, offsets = text_bytes(batch.column(column))
    n, a = batch.num_rows, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a), raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


def runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of True; a run never crosses a position in ``breaks``."""
    n = len(flags)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[breaks] = True
    cut[0] = cut[n] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = flags[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = flags[1:]
    return np.flatnonzero(flags & (~before | cut[:-1])), np.flatnonzero(flags & (~after | cut[1:])) + 1


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each non-empty span raw[start:end]; spans are in order and do not overlap."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    upto = np.cumsum(ends - starts)
    edges = np.unique(np.append(np.searchsorted(upto, np.arange(0, upto[-1], PIECE_BYTES), "right"), len(starts)))
    return np.concatenate([_hash_piece(raw, starts[a:b], ends[a:b], table) for a, b in zip(edges[:-1], edges[1:], strict=True)])


def _hash_piece(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    heads = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(heads, sizes)
    at = place + np.repeat(starts, sizes)
    weight = _PLACE[place & 1023]
    if sizes.max() > 1024:
        weight = weight ^ mix((place >> 10).astype(np.uint64)) & ~np.uint64(1)
    return mix(np.add.reduceat(table[raw[at]] * weight, heads) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): words of row i are hashes[bounds[i]:bounds[i+1]].

    A word is a run of bytes other than space, tab, LF, VT, FF and CR, with A-Z
    in lower case.
    """
    if len(offsets) == 2 and len(raw) > 2 * CHUNK_BYTES:
        return _long_row(raw)
    starts, ends = runs(~_SPACE[raw], offsets[:-1][offsets[:-1] < len(raw)])
    return span_hash(raw, starts, ends, _BYTE_LOWER), np.searchsorted(starts, offsets)


def _long_row(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One very long row, cut at white space so that temporary arrays stay small."""
    parts, a, n = [], 0, len(raw)
    while a < n:
        b = min(n, a + CHUNK_BYTES)
        while b < n:                                     # the piece ends just behind a space
            near = np.flatnonzero(_SPACE[raw[b:b + CHUNK_BYTES]])
            if len(near):
                b += int(near[0]) + 1
                break
            b = min(n, b + CHUNK_BYTES)
        starts, ends = runs(~_SPACE[raw[a:b]], np.zeros(0, np.int64))
        parts.append(span_hash(raw[a:b], starts, ends, _BYTE_LOWER))
        a = b
    words = np.concatenate(parts)
    return words, np.array([0, len(words)])


def shingle_hashes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the five-word shingles of each row, in text order, repeats kept.

    A row of one to four words has one shingle, its whole sequence; a row
    without words has none.
    """
    k, n = SHINGLE_WORDS, np.diff(bounds)
    total = len(words)
    full = np.zeros(max(0, total - k + 1), np.uint64)
    for j in range(k):
        full += words[j:total - k + 1 + j] * _JOIN[j] if total >= k else np.uint64(0)
    full = mix(full)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_bounds = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(int(out_bounds[-1]), np.uint64)
    heads = np.repeat(bounds[:-1] - out_bounds[:-1], counts) + np.arange(len(out))
    big = np.repeat(n >= k, counts)
    out[big] = full[heads[big]]
    for i in np.flatnonzero((n > 0) & (n < k)):
        w = words[bounds[i]:bounds[i + 1]]
        out[out_bounds[i]] = mix((w * _JOIN[:len(w)]).sum(keepdims=True) ^ _BYTE[len(w):len(w) + 1])[0]
    return out, out_bounds


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(values) < 2:
        return values
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    hashes, bounds = shingle_hashes(*word_hashes(raw, offsets))
    return [distinct(hashes[bounds[i]:bounds[i + 1]]) for i in range(len(bounds) - 1)]
