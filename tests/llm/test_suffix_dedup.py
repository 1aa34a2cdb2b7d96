"""Suffix sorting against sorted(), and removal against a set of all strings seen."""

import random

import pytest

from crisislens.llm import suffix_dedup
from crisislens.llm.suffix_array import suffix_array


def brute(rows):
    """(n_bytes, n_removed, n_spans, kept) by row; ``rows`` in order."""
    seen, out = set(), []
    for text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i:i + 100]
            if w in seen:
                gone[i:i + 100] = b"\x01" * 100
            seen.add(w)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def result(df):
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect()]


def test_suffix_array():
    rng = random.Random(3)
    for it in range(3000):
        n, k = rng.randint(0, 40), rng.choice([1, 2, 3, 5, 200])
        t = [rng.randint(0, k - 1) for _ in range(n)]
        if it % 5 == 0:
            t = (t[:rng.randint(1, 6)] * 20)[:n]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_documents(documents, document_rows):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup(documents).collect()}
    want = brute([r["text"] for r in document_rows])
    assert [got[r["doc_id"]] for r in document_rows] == want
    assert sum(w[1] for w in want) > 10_000


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_passages_periods_and_shifts(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", limit)     # 0: every group is split into single strings
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghij klmno pé") for _ in range(n))
    passage = text(400)
    rows = []
    for i in range(60):
        cut = rng.randint(0, 120)
        rows.append(text(rng.randint(0, 150)) + passage[cut:cut + rng.randint(90, 280)] + text(rng.randint(0, 150)))
    rows += ["ab" * 300, "ab" * 300, "ab" * 49, "x" + "ab" * 60, "a" * 500, "", passage, passage, passage[:99], passage[:100], passage[:101]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    assert result(suffix_dedup.dedup(df).orderBy("doc_id")) == brute(rows)


def test_edges(edge, nothing):
    got = suffix_dedup.dedup(edge.where("doc_id <> 7 or doc_id is null"))
    order = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in edge.where("doc_id <> 7 or doc_id is null").select("doc_id", "text").collect()), key=lambda r: r[:2])
    assert result(got.orderBy("doc_id")) == brute([t for _, _, t in order])
    # rows with equal key and text count as one and have one result
    twice = suffix_dedup.dedup(edge.where("doc_id = 7")).collect()
    assert len(twice) == 3 and len({(r["n_bytes"], r["n_removed"]) for r in twice}) <= 2 and all(r["n_removed"] == 0 for r in twice)
    assert suffix_dedup.dedup(nothing).collect() == []


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_repeated_rows_with_a_shared_passage(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", limit)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghij klmno p") for _ in range(n))
    passage = text(500)
    # each text holds a piece of the passage, so anchors recur in other bytes
    rows = [(i, text(100) + passage[cut:cut + 300] + text(100)) for i, cut in enumerate(rng.randint(0, 200) for _ in range(12))]
    want = dict(zip((i for i, _ in rows), brute([t for _, t in rows]), strict=True))
    twice = [*rows, *rows[:6], *rows[:3]]
    df = spark.createDataFrame(twice, "doc_id long, text string").repartition(5)
    got = suffix_dedup.dedup(df).collect()
    assert len(got) == len(twice)
    assert all((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]] for r in got)
