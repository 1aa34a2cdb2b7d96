"""Exact containment by brute force against the MinHash search."""

from crisislens.llm import decontaminate

from .conftest import words
from .test_ngram_join import shingles


def brute(docs, items):
    out = []
    for k, t in docs:
        s = shingles(t)
        for i, q in items:
            x = shingles(q)
            if x and 100 * len(s & x) >= 75 * len(x):
                out.append((str(k), i, len(x), len(s & x)))
    return sorted(out)


def result(df):
    return sorted((str(r[0]), *r[1:4]) for r in df.collect())


def test_documents(spark, documents, document_rows):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in document_rows], [(r["item_id"], r["text"]) for r in items.collect()])
    assert want and result(decontaminate.search(documents, items)) == want


def test_short_items_in_long_documents(spark):
    items = [(i, words(700 + i, n)) for i, n in enumerate([1, 3, 4, 5, 6, 9, 16, 20, 33, 60, 129])] + [(20, None), (21, ""), (22, words(701, 3))]
    docs = [(i, words(900 + i, 3000) + " " + q + " " + words(950 + i, 2500)) for i, q in items[:11]]
    # most of an item, with its last words changed
    docs += [(100 + i, words(800 + i, 700) + " " + " ".join(q.split()[:-max(1, len(q.split()) // 10)]) + " other " + words(850 + i, 900)) for i, q in items[6:11]]
    docs += [(200, items[1][1]), (201, items[1][1].upper()), (202, None), (203, "")] + [(300, docs[8][1])] * 2
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert result(decontaminate.search(a, b)) == brute(docs, items)


def test_edges(edge, nothing, spark):
    items = spark.createDataFrame([(1, words(1, 40)), (2, "one TWO"), (3, None), (None, words(3, 30))], "item_id long, text string").selectExpr("*", "'x' as _item", "'y' as tokens", "'z' as n")
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    assert result(decontaminate.search(edge, items)) == sorted(brute(rows, [(1, words(1, 40)), (2, "one TWO"), (None, words(3, 30))]))
    assert decontaminate.search(nothing, items).collect() == []
    assert decontaminate.search(edge, items.limit(0)).collect() == []
