"""Every stage of the pipeline against a brute-force version on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from crisislens.llm import quality_fm, secret_scan
from crisislens.llm.stored import stored

from .conftest import SF
from .test_byte_bpe import reference  # noqa: F401
from .test_decontaminate import brute as contaminated
from .test_ngram_join import brute as linked


def test_stages(spark, reference):  # noqa: F811
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "benchmark", "secrets", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        kept[name] = (before, docs)
        assert name == "tokens" or docs.columns == columns
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}

    before, after = map(rows, kept["quality"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(k in after for k, q in labels.items() if q == 1) > 0.97 * sum(labels.values())
    assert sum(k in after for k, q in labels.items() if q == 0) < 0.5 * sum(q == 0 for q in labels.values())

    before, after = map(rows, kept["near_duplicates"])
    groups = linked([(k, r["text"]) for k, r in before.items()])
    assert set(after) == {int(k) for k, _, c in groups if k == c} and len(after) < len(before)

    before, after = map(rows, kept["benchmark"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {int(k) for k, *_ in contaminated([(k, r["text"]) for k, r in before.items()], items)}
    assert bad and set(after) == set(before) - bad

    before, after = map(rows, kept["secrets"])
    live = {r["doc_id"]: r["n_live"] for r in secret_scan.scan(kept["secrets"][0]).collect()}
    assert set(after) == set(before)
    assert all((after[k]["text"] != before[k]["text"]) == (live[k] > 0) and after[k]["n_chars"] == len(after[k]["text"]) for k in before)

    before, after = map(rows, kept["tokens"])
    assert all(bytes(after[k]["ids"]) == reference(before[k]["text"]) for k in before)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(tuple(r) for r in whole.collect()) == sorted(tuple(r) for r in docs.collect())


def test_edges(spark, edge, nothing, monkeypatch):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).collect() == []
    clean = corpus_pipeline.near_duplicates(spark, edge, SF)
    assert clean.columns == edge.drop("__row").columns
    got = sorted(str(r["doc_id"]) for r in clean.collect())
    # 1-3 have no words; 4 and 5 are one set, as are 6 and the two equal rows of 7; 8 and 9 are near copies
    assert got == sorted(["1", "2", "3", "4", "6", "7", "None", "8", "10", "11", "12", "-5"])
    assert corpus_pipeline.benchmark_free(spark, edge, SF).count() == edge.count()
    assert corpus_pipeline.secrets(spark, edge, SF).count() == edge.count()
    assert corpus_pipeline.tokens(spark, edge, SF).count() == edge.count()
    monkeypatch.setattr(quality_fm, "fit", lambda *_: quality_fm.train([], __import__("numpy").zeros(0)))
    assert corpus_pipeline.quality(spark, edge, SF).count() == edge.where(F.lit(True)).count()


def test_a_stage_goes_when_the_next_one_is_written(spark, monkeypatch):
    import glob

    from crisislens.llm.stored import shared_folder

    passed = lambda spark, docs, sf_dir: docs.withColumn("n_chars", F.col("n_chars") + 1)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"goes{i}", passed) for i in range(4)])
    out = corpus_pipeline.run(spark, SF)
    left = [p.split("/pipeline-")[1][:5] for p in glob.glob(f"{shared_folder(spark).removeprefix('file:')}/pipeline-goes*")]
    assert left == ["goes2"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.agg(F.sum("n_chars"), F.count("*")).first() == docs.agg(F.sum(F.col("n_chars") + 4), F.count("*")).first()
