"""Ids against tiktoken, and exact round trips."""

import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from crisislens.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: (lambda ids: struct.pack(f"<{len(ids)}I", *ids))(encoding.encode_ordinary(t))


def test_random_strings(reference):
    with open(RANKS, "rb") as f:
        codec = byte_bpe.Codec(f.read(), public_tokenizers.PATTERN)
    rng = random.Random(1)
    letters = [chr(x) for x in [*range(0x250), *range(0x2000, 0x2070), 0x3000, 0x180E, 0xFEFF, 0x1F600, 0x4E2D, 0x662, 0x301]]
    texts = ["".join(rng.choice(letters) if rng.random() < 0.6 else rng.choice(" \n'sdtreab1") for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["a" * 5000, " " * 3000 + "x", "<|endoftext|>", "▁ ▁"]
    ids = codec.encode(texts)
    assert ids == [reference(t) for t in texts]
    assert [codec.decode(x).decode() for x in ids] == texts


def test_documents(documents, document_rows, reference):
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(documents, RANKS, public_tokenizers.PATTERN).collect()}
    for r in document_rows:
        ids = reference(r["text"])
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_edges(edge, nothing, reference):
    ids = byte_bpe.encode(edge, RANKS, public_tokenizers.PATTERN, key="text")
    back = byte_bpe.decode(ids.withColumnRenamed("text", "doc"), RANKS, public_tokenizers.PATTERN, key="doc").collect()
    assert len(back) == edge.count() and all(bytes(r["bytes"]).decode() == (r["doc"] or "") for r in back)
    assert byte_bpe.round_trip(nothing, RANKS, public_tokenizers.PATTERN).collect() == []
