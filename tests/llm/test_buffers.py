"""Array helpers: hashing texts takes little memory, and the hash of a word is the same wherever it stands."""

import tracemalloc

import numpy as np

from crisislens.llm.buffers import PIECE_BYTES, word_hashes
from crisislens.llm.quality_fm import byte_counts


def test_hashing_a_slice_takes_little_memory():
    rng = np.random.default_rng(5)
    raw = rng.choice(np.frombuffer(b"abcde   ", np.uint8), 3 << 20)
    offsets = np.array([0, 1000, 1000, 1 << 20, len(raw)])
    tracemalloc.start()
    words, bounds = word_hashes(raw, offsets)
    byte_counts(raw, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    texts = [raw[a:b].tobytes().split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert np.diff(bounds).tolist() == [len(t) for t in texts]
    of = {}
    for word, h in zip((w for t in texts for w in t), words.tolist(), strict=True):
        assert of.setdefault(word, h) == h
    assert len(set(of.values())) == len(of)


def test_words_longer_than_a_piece():
    long = b"x" * (PIECE_BYTES + 7)
    hashes = [word_hashes(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tolist() for t in (b"a " + long + b" b " + long, long, b"", b" a b")]
    (a, x, b, y), (z,), none, short = hashes
    assert x == y == z and none == [] and short == [a, b]
