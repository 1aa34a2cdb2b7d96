"""All orders against filters applied one after the other in Python."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from crisislens.llm import filter_audit
from crisislens.llm.queries import AUDIT_FILTERS

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    """The letters that each (doc_id, text) fails."""
    first = {}
    for k, t in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    out = []
    for k, t in rows:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        out.append({c for c, bad in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)), ("C", 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)),
                                     ("D", bool(re.search(r"[#$%&*|]", t))), ("E", k is not None and first[t] < k)) if bad})
    return out


def brute(rows, labels):
    """Rows are (doc_id, text, lang)."""
    bad = fails([(k, t) for k, t, _ in rows])
    out, shapley = {}, Counter()
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(k, b) for (k, _, lang), b in zip(rows, bad, strict=True) if (lang or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for i, f in enumerate(order):
                gone = [k for k, b in left if f in b]
                left = [(k, b) for k, b in left if f not in b]
                shapley[part, f] += len(gone)
                out[part, "".join(order), i + 1] = [len(left), len(gone), sum(f in b for _, b in mine) - len(gone), sum(b == {f} for _, b in mine),
                                                    sum(labels.get(k, (0, 0))[0] for k in gone), sum(labels.get(k, (0, 0))[1] for k in gone)]
    return {(p, o, i, *v, shapley[p, o[i - 1]]) for (p, o, i), v in out.items()}


def found(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_documents(spark, documents, document_rows):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    known = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    got = found(filter_audit.audit(documents, AUDIT_FILTERS, labels))
    assert got == brute([(r["doc_id"], r["text"], r["lang"]) for r in document_rows], known)
    assert len({(r[1]) for r in got}) == 120


def test_edges(spark, edge, nothing):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in edge.collect()]
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (7, None, 1), (None, 1, 1), (8, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    want = brute(rows, {1: (1, 1), 7: (0, 1), 8: (1, 0)})
    assert found(filter_audit.audit(edge, AUDIT_FILTERS, labels)) == want
    assert found(filter_audit.audit(edge.select("doc_id", "lang", "text"), AUDIT_FILTERS, labels.limit(0))) == {(*r[:7], 0, 0, r[9]) for r in want}
    assert filter_audit.audit(nothing, AUDIT_FILTERS, labels).collect() == []


def test_relations_of_one_prefix(documents, document_rows):
    rows = filter_audit.numbered(documents)
    failing = filter_audit.failing_ids(rows, AUDIT_FILTERS)
    bad = dict(zip([r["doc_id"] for r in document_rows], fails([(r["doc_id"], r["text"]) for r in document_rows]), strict=True))
    keys = lambda df: sorted(r["key"] for r in df.collect())
    assert keys(filter_audit.survivors(rows, failing, "AE")) == [k for k in sorted(bad) if not bad[k] & {"A", "E"}]
    assert keys(filter_audit.removals(rows, failing, "AE", "B")) == [k for k in sorted(bad) if not bad[k] & {"A", "E"} and "B" in bad[k]]
    assert keys(filter_audit.redundant(rows, failing, "AE", "B")) == [k for k in sorted(bad) if bad[k] & {"A", "E"} and "B" in bad[k]]


def test_other_filters(documents):
    got = filter_audit.audit(documents, {"s": F.col("n_chars") < 500, "l": "n_chars > 2000"}, part="source")
    assert {r["filter_order"] for r in got.collect()} == {"sl", "ls"}
    with pytest.raises(ValueError, match="filters"):
        filter_audit.audit(documents, {})
