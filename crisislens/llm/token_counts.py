"""Token counts of a byte-level BPE tokenizer by compiled finite-state transducers.

The tokenizer file is compiled into a cascade of two deterministic transducers.

1. The splitter reads characters by class (letter, number, white space, other)
   and marks where a pre-token starts.  A mark depends on a few characters
   around it only, so all marks of a slice are found at once.
2. The counter reads bytes and marks.  Every transition carries the number of
   tokens that it adds to the count; a mark returns to the start state.  What
   the encoding of a longer prefix can look back at is the last token at each
   place where a token that is still growing may have begun: the last token of a
   prefix is the one ending it that forms a stable pair with the last token in
   front of it.  These last tokens and their relative counts are the state.
   States are made when a text first reaches them and kept in a hash table with
   one entry for each transition.

A slice of texts is cut into chunks of CHUNK bytes, wherever that falls.  The map
of a chunk from entry state to (exit state, count) is a constant behind its first
mark; all chunks run side by side from there.  The maps are then composed along
the chunks: the exit state of one enters the next and decides the bytes in front
of the mark.  Chunks without a mark, inside very long pre-tokens, are resolved in
the same scan.

Counts equal those of the tokenizers library without begin, end, truncation or
padding.  Strings of added tokens within a text are one token each, as is the
library's default.

Cases: a null text counts as empty and has no tokens; a text of any length is
taken whole; rows with equal keys or equal texts are counted each by itself; a
null key stays null; extra columns are left out; an empty table gives no rows.
Tokenizers with another model, normaliser or splitter, dropout, unknown or
word-end pieces, or added tokens that strip or stand apart are refused.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import CHUNK_BYTES, slices
from .byte_bpe import stand_ins

CHUNK = 256                      # bytes of a chunk
MAX_STATES = 3_000_000            # states kept by one worker; all are forgotten beyond
LIMIT = 512                      # tokens of a text that is over the limit by default

OTHER, LETTER, NUMBER, WHITE, SPACE = range(5)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.int64(-1)


def character_classes(pre_tokenizer) -> np.ndarray:
    """The class of every code point as the library's splitter has it.

    Assigned characters go by their general category.  Those that Python's
    Unicode tables lack, and all that are neither letter nor number, are tried
    out with the splitter itself.
    """
    table = np.zeros(0x110000, np.uint8)
    tried = []
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            table[c] = LETTER
        elif kind[0] == "N":
            table[c] = NUMBER
        elif kind[0] == "Z" or kind == "Cc" or kind == "Cn" and (c < 0x40000 or c >> 12 == 0xE0):
            tried.append(c)
    for c, seen in zip(tried, _tried(pre_tokenizer, [chr(c) for c in tried]), strict=True):
        table[c] = seen
    table[ord(" ")] = SPACE
    return table


def _tried(pre_tokenizer, characters: list[str]) -> list[int]:
    """Classes by the pieces that ``a``, the character twice, ``1`` and ``;`` fall into."""
    ends = np.array([b for _, (_, b) in pre_tokenizer.pre_tokenize_str("".join(f"a{c}{c}1;\n" for c in characters))], np.int64)
    at = np.zeros(6 * len(characters) + 1, bool)
    at[ends] = True
    out = []
    for i in range(len(characters)):
        one, two, three, four = at[6 * i + 1], at[6 * i + 2], at[6 * i + 3], at[6 * i + 4]
        out.append(WHITE if one and two else LETTER if three and not one else NUMBER if one and four and not three else OTHER)
    return out


class Tokenizer:
    """What the counter needs of a tokenizer file: byte tokens, merges, added tokens, character classes."""

    def __init__(self, blob: str):
        import tokenizers

        spec = json.loads(blob)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
        added = spec.get("added_tokens") or []
        if (model.get("type") != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)
                or any((model.get(k) or v) != v for k, v in plain.items()) or any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip", "normalized"))):
            raise ValueError("only plain byte-level BPE tokenizers can be compiled")
        back = {c: i for i, c in enumerate(stand_ins())}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = [tuple(bytes(back[c] for c in side) for side in m) for m in merges]
        special = {a["content"] for a in added}
        self.tokens = [bytes(back[c] for c in t) for t in model["vocab"] if t not in special]
        self.added = sorted((a["content"].encode() for a in added if a["content"]), key=lambda a: (-len(a), a))
        self.classes = character_classes(tokenizers.Tokenizer.from_str(blob).pre_tokenizer)


class Counter:
    """The compiled counter; transitions are added as texts need them."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[bytes, bytes]]):
        if not all(bytes([b]) in tokens for b in range(256)):
            raise ValueError("every byte must be a token")
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.tokens = tokens
        self.rank = {m: i for i, m in reversed(list(enumerate(merges)))}
        self.growing = {t[:i] for t in tokens for i in range(1, len(t))}
        self.stable: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Back to the start state alone."""
        # a state: bytes since the first place that matters, last tokens there (-1: none yet, -2: does not matter) and relative counts
        self.states: list[tuple[bytes, bytes]] = [(b"", struct.pack("<2i", -1, 0))]
        self.known = {self.states[0]: 0}
        self.size = 0
        self.keys, self.values = np.full(1 << 16, _EMPTY), np.zeros(1 << 16, np.int64)

    def merged(self, word: bytes) -> list[bytes]:
        """The tokens of a word: lowest rank first, leftmost of equals."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def follows(self, before: int, token: int) -> bool:
        """Whether a token can stand behind another one, or behind nothing (-1)."""
        found = self.stable.get((before, token))
        if found is None:
            t = self.tokens[token]
            found = self.merged(t) == [t] if before < 0 else self.merged(self.tokens[before] + t) == [self.tokens[before], t]
            self.stable[before, token] = found
        return found

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, tokens added) of one transition."""
        word, packed = self.states[state]
        n = len(word) + 1
        last = list(struct.unpack(f"<{2 * n}i", packed))
        last, counts = last[:n], last[n:]
        word += bytes([byte])
        for i in range(n):
            token = self.ids.get(word[i:]) if last[i] != -2 else None
            if token is not None and self.follows(last[i], token):
                break
        else:
            raise ValueError("the merges give no last token")
        added = counts[i] + 1
        last.append(token)
        counts = [c - added for c in counts] + [0]
        open_ = [word[i:] in self.growing for i in range(n)] + [True]
        first = open_.index(True)
        last = [t if o else -2 for t, o in zip(last[first:], open_[first:], strict=True)]
        counts = [c if o else 0 for c, o in zip(counts[first:], open_[first:], strict=True)]
        key = (word[first:], struct.pack(f"<{2 * len(last)}i", *last, *counts))
        new = self.known.get(key)
        if new is None:
            new = self.known[key] = len(self.states)
            self.states.append(key)
        return new, added

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - (len(self.keys).bit_length() - 1))).astype(np.int64)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds transitions that are not in the table."""
        if 3 * (self.size + len(keys)) > len(self.keys):
            full = self.keys != _EMPTY
            keys, values = np.concatenate((keys, self.keys[full])), np.concatenate((values, self.values[full]))
            room = len(self.keys)
            while 6 * len(keys) > room:
                room *= 2
            self.keys, self.values, self.size = np.full(room, _EMPTY), np.zeros(room, np.int64), 0
        self.size += len(keys)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] == _EMPTY
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            left = self.keys[slot] != keys                # taken, or another key won the same slot
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (len(self.keys) - 1)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, places of keys that are missing)."""
        slot = self._slots(keys)
        out = self.values[slot]
        bad = np.flatnonzero(self.keys[slot] != keys)
        missing = []
        mask = len(self.keys) - 1
        slot = slot[bad]
        while len(bad):
            empty = self.keys[slot] == _EMPTY
            if empty.any():
                missing.append(bad[empty])
                bad, slot = bad[~empty], slot[~empty]
            slot = (slot + 1) & mask
            hit = self.keys[slot] == keys[bad]
            out[bad[hit]] = self.values[slot[hit]]
            bad, slot = bad[~hit], slot[~hit]
        return out, np.concatenate(missing) if missing else bad

    def move(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, tokens added) of transitions side by side."""
        keys = states << 8 | symbols
        found, missing = self._find(keys)
        if len(missing):
            new = np.unique(keys[missing])
            values = np.array([(s << 16) + d + 0x8000 for s, d in (self.step(k >> 8, k & 255) for k in new.tolist())], np.int64)
            self._insert(new, values)
            found[missing] = values[np.searchsorted(new, keys[missing])]
        return found >> 16, (found & 0xFFFF) - 0x8000

    def one(self, state: int, symbols: bytes) -> tuple[int, int]:
        """(state, tokens added) over a string of bytes."""
        total, memo = 0, {}
        for b in symbols:
            found = memo.get((state, b))
            if found is None:
                found = memo[state, b] = self.step(state, b)
            state, added = found
            total += added
        return state, total

    def counts(self, raw: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Tokens added at each byte of ``raw``; ``marks`` says where pre-tokens start, the first byte included."""
        if len(self.states) > MAX_STATES:
            self.forget()
        n = len(raw)
        lanes = -(-n // CHUNK)
        symbols, reset = np.zeros((lanes, CHUNK), np.uint8), np.zeros((lanes, CHUNK), bool)
        symbols.reshape(-1)[:n], reset.reshape(-1)[:n] = raw, marks
        added = np.zeros((lanes, CHUNK), np.int32)
        first = np.where(reset.any(axis=1), reset.argmax(axis=1), CHUNK)
        by_place, marked = np.ascontiguousarray(symbols.T), np.ascontiguousarray(reset.T)
        # every chunk behind its first mark, side by side
        out = np.zeros(lanes, np.int64)
        order = np.argsort(first, kind="stable")
        starts = np.searchsorted(first[order], np.arange(CHUNK), "right")
        for i in range(CHUNK):
            on = order[:starts[i]]
            out[on], added[on, i] = self.move(np.where(marked[i][on], 0, out[on]), by_place[i][on].astype(np.int64))
        # composition: the exit of a chunk enters the next one
        whole = np.flatnonzero(first == CHUNK)
        for c in whole.tolist():                         # chunks without a mark, one behind the other
            out[c], added[c, 0] = self.one(int(out[c - 1]), symbols[c].tobytes()[:min(CHUNK, n - c * CHUNK)])
        state = np.concatenate(([0], out[:-1]))
        heads = np.where(first < CHUNK, first, 0)
        order = np.argsort(-heads, kind="stable")
        sizes = heads[order]
        for i in range(int(heads.max(initial=0))):
            on = order[:np.searchsorted(-sizes, -i, "left")]
            state[on], added[on, i] = self.move(state[on], by_place[i][on].astype(np.int64))
        return added.reshape(-1)[:n]


def split_marks(raw: np.ndarray, heads: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each byte; ``heads`` are the bytes at which a text of its own begins."""
    lead = np.flatnonzero(raw & 0xC0 != 0x80)
    b = raw[lead].astype(np.int32)
    size = 1 + (b >= 0xC0) + (b >= 0xE0) + (b >= 0xF0)
    point = np.where(size == 1, b, b & (0xFF >> (size + 1)))
    for i in range(1, 4):
        more = np.flatnonzero(size > i)
        if len(more):
            point[more] = point[more] << 6 | raw[lead[more] + i] & 0x3F
    kind = classes[point]
    n = len(kind)
    begins = np.zeros(n + 1, bool)
    begins[np.searchsorted(lead, heads)] = True
    begins[n] = True
    prev = np.empty(n, np.uint8)
    prev[1:], prev[:1] = kind[:-1], OTHER
    white, after_white = kind >= WHITE, prev >= WHITE
    # the last white character of a run stands apart if more text follows
    ends_run = np.zeros(n, bool)
    ends_run[:-1] = ~white[1:] & ~begins[1:-1]
    start = begins[:-1] | np.where(white, ~after_white | ends_run, np.where(after_white, prev != SPACE, kind != prev))
    # an apostrophe at a start takes the letters of a contraction along
    at = np.flatnonzero((point == 0x27) & start)
    if len(at):
        padded, closed = np.append(point, [0, 0, 0]), np.append(begins, [True, True, True])
        one = np.where(closed[at + 1], 0, padded[at + 1])
        two = np.where(closed[at + 1] | closed[at + 2], 0, padded[at + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(at), bool)
        for x, y in ("re", "ve", "ll"):
            long |= (one == ord(x)) & (two == ord(y))
        start[at[short] + 1] = False
        start[at[long] + 1], start[at[long] + 2] = False, False
        behind = np.concatenate((at[short] + 2, at[long] + 3))
        start[behind[behind < n]] = True
    out = np.zeros(len(raw), bool)
    out[lead[start]] = True
    return out


def added_spans(raw: np.ndarray, offsets: np.ndarray, added: list[bytes]) -> list[tuple[int, int]]:
    """Places of added tokens, leftmost first and the longest of those at one place; none crosses texts."""
    whole = raw.tobytes()
    if not any(a in whole for a in added):
        return []
    out = []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        while True:
            found = [(p, -len(a)) for a in added if (p := whole.find(a, lo, hi)) >= 0]
            if not found:
                break
            at, size = min(found)
            out.append((at, at - size))
            lo = at - size
    return out


@lru_cache(maxsize=2)
def _compiled(blob: bytes) -> Counter:
    tokens, merges = _unpack(blob)
    return Counter(tokens, merges)


def _pack(tokens: list[bytes], merges: list[tuple[bytes, bytes]]) -> bytes:
    return json.dumps([[t.decode("latin-1") for t in tokens], [[a.decode("latin-1"), b.decode("latin-1")] for a, b in merges]]).encode()


def _unpack(blob: bytes) -> tuple[list[bytes], list[tuple[bytes, bytes]]]:
    tokens, merges = json.loads(blob)
    return [t.encode("latin-1") for t in tokens], [(a.encode("latin-1"), b.encode("latin-1")) for a, b in merges]


def count_slice(raw: np.ndarray, offsets: np.ndarray, counter: Counter, classes: np.ndarray, added: list[bytes]) -> np.ndarray:
    """Token counts of the texts of one slice."""
    sizes = np.diff(offsets)
    if not len(raw):
        return np.zeros(len(sizes), np.int64)
    if len(sizes) == 1 and len(raw) > 2 * CHUNK_BYTES and not any(set(a) & set(b" \t\n") for a in added):
        return _long_text(raw, counter, classes, added)
    special = added_spans(raw, offsets, added)
    heads = np.concatenate((offsets[:-1][sizes > 0], np.array([x for s in special for x in s if x < len(raw)], np.int64)))
    tokens = counter.counts(raw, split_marks(raw, heads, classes))
    for a, b in special:
        tokens[a:b] = 0
        tokens[a] = 1
    total = np.concatenate(([0], np.cumsum(tokens, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _long_text(raw: np.ndarray, counter: Counter, classes: np.ndarray, added: list[bytes]) -> np.ndarray:
    """One very long text in pieces that end in front of white space behind an ASCII character, where a pre-token starts anyway."""
    total, a, n = 0, 0, len(raw)
    while a < n:
        b = min(n, a + CHUNK_BYTES)
        while b < n:
            near = raw[b - 1:b + CHUNK_BYTES]
            white = (near == 0x20) | (near == 0x0A) | (near == 0x09)
            cut = np.flatnonzero(white[1:] & ~white[:-1] & (near[:-1] > 0x20) & (near[:-1] < 0x7F))
            if len(cut):
                b += int(cut[0])
                break
            b = min(n, b + CHUNK_BYTES)
        tokens = count_slice(raw[a:b], np.array([0, 0, b - a]), counter, classes, added)
        total += int(tokens.sum())
        a = b
    return np.array([total], np.int64)


def count(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every whole text by the tokenizer file at the path ``tokenizer``."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = Tokenizer(f.read())
    # the size of these is that of the vocabulary and of Unicode, not of the data
    shared = df.sparkSession.sparkContext.broadcast((_pack(spec.tokens, spec.merges), spec.classes, spec.added))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, classes, added = shared.value
        counter = _compiled(blob)
        for batch in batches:
            for part, raw, offsets in slices(batch, "__text"):
                n = count_slice(raw, offsets, counter, classes, added)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], [key, "n_bytes", "n_tokens", "over_limit"])

    return df.select(key, F.col(text).alias("__text")).mapInArrow(work, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
