"""Phrases against counting every phrase of every text in Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from crisislens.llm import collocations
from crisislens.llm.buffers import mix

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, max_words=3, least=10, share=(50, 100), limit=2000):
    """Rows are (text, lang)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for m in range(1, max_words + 1):
                f[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        most = Counter()
        for p, c in cand.items():
            for q in {p[i:i + n] for n in range(2, len(p)) for i in range(len(p) - n + 1)}:
                most[q] = max(most[q], c)
        kept = []
        for p, a in cand.items():
            score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if share[1] * most[p] < share[0] * a:
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(kept)[:limit])]
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(" ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=rng.randint(0, 80))).replace("w7", ", w7 ."), rng.choice(["en", "en", "en", "de", None])) for _ in range(n)]


def test_documents(documents, document_rows):
    got = found(collocations.mine(documents))
    assert got == brute([(r["text"], r["lang"]) for r in document_rows]) and len(got) > 150


@pytest.mark.parametrize("ranked", [1 << 16, 256, 0])
def test_few_and_no_dense_tiles(spark, monkeypatch, ranked):
    rows = made(2, 300)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    if ranked < 1 << 16:
        # only so many symbols have an id; the broadcast tables shrink with them
        def fewer(level, full=collocations.most_frequent):
            return full(level).orderBy("n", ascending=False).limit(ranked // 8)
        monkeypatch.setattr(collocations, "most_frequent", fewer)
    assert found(collocations.mine(df)) == brute(rows)


def test_longer_phrases_and_parameters(spark):
    rows = made(3, 200)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert found(collocations.mine(df, max_words=5, least=3, share=(70, 100), limit=40)) == brute(rows, 5, 3, (70, 100), 40)


def test_tiles_with_small_buffers(monkeypatch):
    monkeypatch.setattr(collocations, "BUFFER", 50)
    monkeypatch.setattr(collocations, "DENSE_TILES", 2)
    rng = np.random.default_rng(1)
    keys = mix(np.arange(1500, dtype=np.uint64))
    by = np.argsort(keys[:1200])
    ranks = collocations.Ranks(keys[:1200], np.array(["x"] * 1200), np.arange(1200, 0, -1), keys[:1200][by], by.astype(np.int32))
    slots = collocations.dense_tiles(ranks, ranks)
    assert (slots >= 0).sum() == 2 and slots[0] >= 0
    tiles, want, got = collocations.Tiles(ranks, ranks, slots), Counter(), Counter()
    batches = []
    for _ in range(40):
        i, j = (np.minimum(rng.zipf(1.3, 300), 1500) - 1 for _ in range(2))
        want.update(zip(i.tolist(), j.tolist(), strict=True))
        batches += tiles.add(keys[i], keys[j])
    batches += tiles.close()
    place = {int(k): i for i, k in enumerate(keys.view(np.int64))}
    for r in pa.Table.from_batches(batches).to_pylist():
        got[place[r["left"]], place[r["right"]]] += r["n"]
    assert got == want and tiles.cells.sum() > 1000


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 60)
    rows = [(". ".join(t for t, _ in made(5, 40)), "en"), ("a b " * 200, "en")]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([t for t, _ in rows])], ["_lang", "_text"])
    n = sum(len(w.key) for i in range(2) for _, w in collocations.each_words(iter([batch.slice(i, 1)])))
    assert n == sum(len([w for w in re.split(r"[\s.,]+", t) if w]) for t, _ in rows)


def test_edges(edge, nothing):
    rows = [(r["text"], r["lang"]) for r in edge.collect()]
    assert found(collocations.mine(edge)) == brute(rows)
    assert found(collocations.mine(edge, least=2)) == brute(rows, least=2)
    assert collocations.mine(nothing).collect() == []
