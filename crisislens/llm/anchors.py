"""Content-defined anchors: every window of WINDOW bytes holds one, chosen by the window's bytes alone."""

from __future__ import annotations

import numpy as np

from .buffers import CHUNK_BYTES, mix

WINDOW = 100                     # bytes of a repeated string
GRAM = 24                        # bytes of an anchor
_SPAN = WINDOW - GRAM + 1        # anchors to choose from in a window

_TABLE = np.random.Generator(np.random.PCG64(777)).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of raw[i:i+24] and of raw[i:i+32] for every i where they fit."""
    h, base = _TABLE[raw], _BASE
    for w in (1, 2, 4, 8):
        if w == 8:
            eight, power = h, base
        h = h[:-w] * base + h[w:] if len(h) > w else h[:0]
        base = np.multiply(np.array([base]), base)[0]
    gram = h[:-8] * power + eight[16:] if len(h) > 8 else h[:0]
    wide = h[:-16] * base + h[16:] if len(h) > 16 else h[:0]
    return mix(gram), mix(wide)


def span_key(wide: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span start..end of 32 bytes and more, from the hashes of the 32-byte blocks that cover it."""
    h = mix((end - start).astype(np.uint64))
    longest = int((end - start).max()) if len(start) else 0
    for at in range(0, longest, 32):
        h = mix(h * _BASE ^ wide[np.minimum(start + at, end - 32)])
    return h


def _anchors(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, context, place, lo, hi): the anchor at ``place`` serves the windows that start at lo..hi.

    ``context`` hashes the bytes of those windows and the anchor's place among
    them.  ``first`` and ``last`` are the inclusive ranges of window starts.
    """
    grams, wide = rolling(raw)
    low = np.uint64((1 << 23) - 1)
    best = grams & ~low | np.arange(len(grams), dtype=np.uint64)        # equal hashes: the leftmost
    w = 1
    while w * 2 <= _SPAN:
        best = np.minimum(best[:-w], best[w:])
        w *= 2
    if _SPAN > w:
        best = np.minimum(best[:-(_SPAN - w)], best[_SPAN - w:])
    sizes = last - first + 1
    starts = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    place = (best[starts] & low).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(starts)) - 1
    place, lo, hi = place[at], starts[at], starts[ends]
    return grams[place], span_key(wide, lo, hi + WINDOW) ^ mix((place - lo).astype(np.uint64)), place, lo, hi


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, key, context, place, lo, hi) of all rows of a slice; positions count from the row's first byte."""
    keep = np.flatnonzero(np.diff(offsets) >= WINDOW)
    if not len(keep):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(offsets) == 2 and len(raw) > 2 * CHUNK_BYTES:                # one very long row, in overlapping pieces
        parts = []
        for a in range(0, len(raw) - WINDOW + 1, CHUNK_BYTES):
            piece = raw[a:a + CHUNK_BYTES + WINDOW - 1]
            key, context, place, lo, hi = _anchors(piece, np.array([0]), np.array([len(piece) - WINDOW]))
            parts.append((np.zeros(len(key), np.int64), key, context, place + a, lo + a, hi + a))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    first, last = offsets[keep], offsets[keep + 1] - WINDOW
    key, context, place, lo, hi = _anchors(raw, first, last)
    row = keep[np.searchsorted(first, lo, "right") - 1]
    return row, key, context, place - offsets[row], lo - offsets[row], hi - offsets[row]
