"""Token counts against the tokenizers library."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tokenizers

from crisislens.llm import token_counts
from crisislens.llm.buffers import slices

from .conftest import words

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def spec():
    with open(PATH, encoding="utf-8") as f:
        return token_counts.Tokenizer(f.read())


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    return lambda texts: [len(x.ids) for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def counted(spec, texts, **sizes):
    counter = token_counts.Counter(spec.tokens, spec.merges)
    out = []
    for _, raw, offsets in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"]), "t", **sizes):
        out += token_counts.count_slice(raw, offsets, counter, spec.classes, spec.added).tolist()
    return out


def strings(seed, n):
    rng = random.Random(seed)
    letters = [chr(x) for x in [*range(0x250), *range(0x2000, 0x2070), 0x3000, 0x180E, 0xFEFF, 0x1F600, 0x4E2D, 0x662, 0x301, 0x1C89, 0x105C0]]
    return ["".join(rng.choice(letters) if rng.random() < 0.5 else rng.choice(" \n'sdtreavlm1") for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_strings(spec, library, monkeypatch):
    texts = strings(1, 4000) + ["a" * 3000, " " * 2000 + "x", "=-" * 900, "\n" * 700 + "x" + "\t" * 300, "don't we'll 'they're x''s 's's", None, "",
                                "<|endoftext|>", "a<|endoftext|> <|endoftext|><|endoftext|>  b", "x <|endoftext|"]
    want = library(texts)
    assert counted(spec, texts) == want
    assert counted(spec, texts, limit=500) == want
    monkeypatch.setattr(token_counts, "CHUNK", 7)            # most pre-tokens cross chunks
    assert counted(spec, texts, limit=5000) == want
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)      # forgets between slices
    assert counted(spec, texts, limit=5000) == want


def test_long_text_in_pieces(spec, library, monkeypatch):
    text = " ".join(strings(2, 400)) + " <|endoftext|> " + words(3, 2000) + "y" * 3000 + "  \n\n z"
    monkeypatch.setattr(token_counts, "CHUNK_BYTES", 300)
    assert counted(spec, [text, "b"], limit=1) == library([text, "b"])


def test_character_classes(spec):
    """Every code point as the library's splitter takes it, next to a letter, a number and itself."""
    split = tokenizers.Tokenizer.from_file(PATH).pre_tokenizer
    rng = np.random.default_rng(4)
    points = [c for c in [*range(0x3400), *rng.integers(0x3400, 0x110000, 20_000).tolist()] if not 0xD800 <= c < 0xE000 and c != 0x20]
    assert token_counts._tried(split, [chr(c) for c in points]) == spec.classes[points].tolist()


def test_documents(spark, documents, document_rows, library):
    got = {r["doc_id"]: r for r in token_counts.count(documents, PATH).collect()}
    want = library([r["text"] for r in document_rows])
    assert [got[r["doc_id"]]["n_tokens"] for r in document_rows] == want
    assert all(got[r["doc_id"]]["n_bytes"] == len(r["text"].encode()) and got[r["doc_id"]]["over_limit"] == (n > 512) for r, n in zip(document_rows, want, strict=True))


def test_edges(edge, nothing, library):
    got = sorted((str(r["text"]), r["n_tokens"], r["n_bytes"]) for r in token_counts.count(edge, PATH, key="text").collect())
    rows = [r["text"] for r in edge.collect()]
    assert got == sorted((str(t), n, len((t or "").encode())) for t, n in zip(rows, library(rows), strict=True))
    assert token_counts.count(nothing, PATH).collect() == []


def test_other_tokenizers_are_refused():
    for name in ("word_bpe_49k.json",):
        with open(public_tokenizers.path(name), encoding="utf-8") as f, pytest.raises(ValueError, match="byte-level"):
            token_counts.Tokenizer(f.read())
