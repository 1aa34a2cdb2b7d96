"""Fingerprints of edited texts against fingerprinting them whole, in the order of the keys."""

import hashlib

import numpy as np
import pyarrow as pa

from crisislens.llm import fingerprints
from crisislens.llm.buffers import text_bytes

from .conftest import words


def whole(text):
    _, digests, _ = fingerprints.chunk(*text_bytes(pa.array([text])))
    return fingerprints.as_text(np.unique(digests))


def expected(rows):
    out = []
    for i, (k, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[:len(t) - q] + n[:q]
        near = lambda x: fingerprints.likeness(fingerprints.parse(whole(t)), fingerprints.parse(whole(x)))  # noqa: B023, E731
        out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), whole(t), whole(e), near(e), near(n)))
    return out


def test_documents(spark, documents, document_rows):
    got = [tuple(r) for r in fingerprints.compare(documents.repartition(7)).orderBy("doc_id").collect()]
    assert got == expected([(r["doc_id"], r["text"]) for r in document_rows])
    long = [r for r in got if r[1] > 400]
    assert np.median([r[5] for r in long]) > 0.65 and np.percentile([r[6] for r in long], 90) < 0.2
    single = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(documents).collect()}
    assert all(single[r[0]] == r[3] for r in got)


def test_shift_moves_boundaries_along():
    text = words(60, 900)
    for front in ("x", "ab cd ", words(61, 3)):
        assert fingerprints.likeness(fingerprints.parse(whole(text)), fingerprints.parse(whole(front + text))) > 0.95


def test_edges(spark, edge, nothing):
    rows = [(r["doc_id"], r["text"] or "") for r in edge.where("doc_id is null or doc_id <> 7").select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    got = {r[0]: tuple(r) for r in fingerprints.compare(edge.where("doc_id is null or doc_id <> 7")).collect()}
    assert [got[r[0]] for r in expected(rows)] == expected(rows)
    assert fingerprints.compare(edge).count() == edge.count()          # repeated keys and rows
    assert fingerprints.compare(nothing).collect() == []
    one = spark.createDataFrame([(3, "only one text here")], "doc_id long, text string")
    assert fingerprints.compare(one).collect()[0]["near_next"] == 1.0
