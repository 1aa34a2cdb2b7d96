"""Held-out accuracy of the two classifiers, the linear-time identity, and edge cases."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from crisislens.llm import language_id, quality_fm, queries
from crisislens.llm.buffers import text_bytes

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op2_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.94
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, edge, nothing):
    model = {"b": b"und der die das nicht " * 50, "a": b"the of and to in that " * 50}
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "the of and that"), (5, "nicht das der die"), (6, "the of and to " * 100_000), (6, "the of and to " * 100_000)]
    got = language_id.classify(spark.createDataFrame(rows, "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["und", "und", "und", "a", "b", "a", "a"] and [r["score"] for r in got[:3]] == [0, 0, 0]
    tie = language_id.classify(spark.createDataFrame([(1, "zzz")], "doc_id long, text string"), model).collect()[0]
    assert tie["lang_pred"] == "b" and not tie["accepted"]                       # equal sizes: the first of the model
    assert language_id.fit(nothing) == {} and {r["lang_pred"] for r in language_id.classify(edge, {}).collect()} == {"und"}
    assert set(language_id.fit(edge)) == {"en", "de", "es"} and language_id.classify(nothing, model).collect() == []


def test_sizes_by_plain_compression(spark):
    """Predictions from compressing every text anew, dictionary by dictionary, at the smaller of two sizes."""
    import re
    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") % 4 == 2).limit(60)
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") % 4 != 2))
    assert len({len(x) for x in model.values()}) > 1 and max(map(len, model.values())) > 1.2 * min(map(len, model.values()))
    whole = {k: v.decode() for k, v in model.items()}

    def size(raw, sample):
        c = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(sample.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                     write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(raw[i:i + language_id.PIECE_BYTES])) for i in range(0, len(raw), language_id.PIECE_BYTES))

    names = sorted(whole, key=lambda k: -len(whole[k]))                          # no two of one size here
    assert len({len(x) for x in whole.values()}) == len(whole)
    for r in language_id.classify(docs, model).join(docs, "doc_id").collect():
        raw = re.sub(r"[\W\d_]+", " ", r["text"]).lower().encode()
        best = names[0]
        for k in names[1:]:
            n = len(whole[k])
            bar = np.exp(language_id.BAR * (np.sqrt(language_id.DICTIONARY_CHARS / n) - 1))
            best = k if size(raw, whole[k]) * bar < size(raw, whole[best][:n]) else best
        assert r["lang_pred"] == best, r["doc_id"]


def test_a_rare_language_changes_no_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    train = docs.where(F.col("doc_id") % 4 != 2)
    rare = spark.createDataFrame([(-1, "kissa koira talo metsä järvi yö kuu tähti " * 3, "xx")], "doc_id long, text string, lang string")
    model, more = language_id.fit(train), language_id.fit(train.unionAll(rare))
    assert more.pop("xx") and more == model                                      # each has its own dictionary
    more = language_id.fit(train.unionAll(rare))
    asked = docs.where(F.col("doc_id") % 4 == 2).unionAll(spark.createDataFrame([(-2, "koira talo kuu yö metsä tähti kissa", "xx")], docs.schema))
    a, b = ({r["doc_id"]: r["lang_pred"] for r in language_id.classify(asked, m).collect()} for m in (model, more))
    assert b.pop(-2) == "xx" and a.pop(-2) != "xx" and a == b
    long = "eins zwei " * 500 + "drei vier " * 500
    sample = language_id.fit(spark.createDataFrame([(1, long, "de")], docs.schema))["de"].decode()
    assert len(sample) <= language_id.SAMPLE_CHARS + 10 and "eins" in sample and "vier" in sample


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op8_quality_fm(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95


def test_linear_time_score_equals_all_pairs():
    rng = np.random.default_rng(1)
    n = quality_fm.COLUMNS
    model = quality_fm.Model(0.1, rng.normal(size=n) / 9, rng.normal(size=(n, 3)) / 9, np.zeros(quality_fm.STATS), np.ones(quality_fm.STATS))
    raw, offsets = text_bytes(pa.array(["a b a c", "", "one two"]))
    slots, values, bounds, stats = quality_fm.features(raw, offsets)
    for i, p in enumerate(model.probability(slots, values, bounds, stats)):
        x = np.zeros(n)
        x[slots[bounds[i]:bounds[i + 1]]] = values[bounds[i]:bounds[i + 1]]
        x[quality_fm.WORD_SLOTS:] = np.clip(stats[i], -4, 4)
        at = np.flatnonzero(x)
        z = 0.1 + model.w @ x + sum((model.v[a] @ model.v[b]) * x[a] * x[b] for k, a in enumerate(at) for b in at[k + 1:])
        assert abs(p - 1 / (1 + np.exp(-z))) < 1e-6


def test_quality_edges(spark, edge, nothing):
    labelled = edge.withColumn("quality", (F.length("text") % 2).cast("int"))
    model = quality_fm.fit(labelled)
    got = quality_fm.score(edge, model, keep=edge.columns, name="p").collect()
    assert len(got) == edge.count() and all(0 <= r["p"] <= 1 and r["node"] == "clash" for r in got)
    assert quality_fm.score(nothing, model).collect() == []
    for empty in (nothing.withColumn("quality", F.lit(1)), edge.withColumn("quality", F.lit(1)), edge.withColumn("quality", F.lit(None).cast("int"))):
        assert all(0 < r["score"] < 1 for r in quality_fm.score(edge, quality_fm.fit(empty)).collect())
    one = quality_fm.fit(labelled, sample_rows=4)
    assert isinstance(one, quality_fm.Model)
