"""Byte-level BPE with a sentencepiece model written straight from a rank file.

Every token of the vocabulary becomes one piece: its bytes mapped to the 256
printable stand-in characters, scored by its negative rank, behind an identity
normaliser.  A BPE model of sentencepiece merges the best-scored neighbour pair
first and the leftmost of equals, so for one pre-token it makes the merges of
the rank file.  Pre-tokens are the matches of the split pattern; a pre-token
that is itself in the vocabulary is that one token.  Decoding maps pieces back
to bytes.

Cases: a null or empty text has no tokens and decodes to no bytes; any length
of text or of pre-token is taken whole; repeated rows give repeated rows; extra
columns are left out.  The vocabulary file is read on the driver (its size is
that of the vocabulary, not of the data) and broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import slices

CACHE_PRETOKENS = 600_000        # pre-tokens remembered by one worker; the memory is emptied beyond
CACHE_CHARS = 64                 # longer pre-tokens are not remembered

# Fixed value: Unicode's White_Space characters, which the split pattern's \s means.
_WHITE = r"\t-\r \x85\xa0  -     　"


def stand_ins() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(blob: bytes) -> list[bytes]:
    """Tokens by rank from the lines ``base64 rank``; the ranks must be 0 to n-1."""
    ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in blob.splitlines() if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes last."""
    # Field numbers of the public message format (pieces 1, trainer 2, normaliser 3).
    chars = stand_ins()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _block(1, _block(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))

    body = [piece("".join(chars[b] for b in t), -float(rank), 1) for rank, t in enumerate(tokens)]
    body.append(piece("\ue000", -float(len(tokens)), 2))
    trainer = _number(3, 2) + _number(40, len(tokens)) + b"".join(_number(f, -1) for f in (41, 42, 43)) + _block(45, "\ue000".encode())
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(body) + _block(2, trainer) + _block(3, normaliser)


class Codec:
    """Encodes and decodes texts by one vocabulary; made once per worker."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(vocabulary)
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]")).findall
        self.chars = {i: c for i, c in enumerate(stand_ins())}
        back = {c: i for i, c in self.chars.items()}
        self.pieces = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(self.tokens))]
        self.known: dict[str, bytes] = {}

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        found, rest = {}, []
        for t in new:
            raw = t.encode()
            if raw in self.whole:
                found[t] = self.whole[raw]
            else:
                rest.append((t, raw.decode("latin-1").translate(self.chars)))
        for (t, _), ids in zip(rest, self.model.encode([m for _, m in rest], num_threads=1) if rest else [], strict=True):
            found[t] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHE_PRETOKENS:
            self.known = {}
        cut = [self.split(t) for t in texts]
        get = self.known.get
        out = [list(map(get, c)) for c in cut]
        new = {t for c, ids in zip(cut, out, strict=True) if None in ids for t, x in zip(c, ids, strict=True) if x is None}
        found = self._learn(new)
        self.known.update((t, x) for t, x in found.items() if len(t) <= CACHE_CHARS)
        return [b"".join(ids) if None not in ids else b"".join(x or found[t] for t, x in zip(c, ids, strict=True)) for c, ids in zip(cut, out, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(vocabulary: bytes, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of every whole text as packed little-endian unsigned 32-bit integers."""
    shared = _vocabulary(df, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for batch in batches:
            for part, _, _ in slices(batch, "__text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(c.encode([t or "" for t in part.column(1).to_pylist()]), pa.binary())], [key, "ids"])

    return df.select(key, F.col(text).alias("__text")).mapInArrow(work, f"`{key}` {df.schema[key].dataType.simpleString()}, ids binary")


def decode(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes): the bytes that packed ids stand for; null ids give no bytes."""
    shared = _vocabulary(df, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())], [key, "bytes"])

    return df.select(key, ids).mapInArrow(work, f"`{key}` {df.schema[key].dataType.simpleString()}, bytes binary")


def round_trip(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded in one pass.

    ``with_ids`` adds the packed ids.
    """
    shared = _vocabulary(df, vocabulary)
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for batch in batches:
            for part, _, _ in slices(batch, "__text"):
                ids = c.encode([t or "" for t in part.column(1).to_pylist()])
                columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                           pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                           pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids])]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(ids, pa.binary())] * with_ids], names)

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return df.select(key, F.col(text).alias("__text")).mapInArrow(work, schema)
