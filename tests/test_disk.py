"""What is written stays small beside the posts, and goes when it has been read."""

import glob
import os

import pytest

from test_periods import corpus
from crisislens.plans import q_ingest, sinks
from crisislens.plans.catalog import REGISTRY
from crisislens.session import CLEANUP, delete, shuffles_released
from crisislens.sources.fixtures import raw_posts


@pytest.fixture()
def tables(spark, tmpdir_path):
    """Events, documents and labels with null and repeated keys."""
    texts = ["un deux", "été; \"cité\"\nligne", "日本語, a;b", "x" * 300, "trois quatre", "CNC", "fin"]
    spark.createDataFrame([*enumerate(texts), (3, "encore"), (None, "sans id")], "doc_id long, text string").write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (3, 0, 1), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmpdir_path}/labels.parquet")
    rows = [(i if i % 19 else None, i, i % 7, "click", i / 3) for i in range(80)] + [(4, 3, 1, "error", 1.0)]
    (spark.createDataFrame(rows, "event_id long, sec long, user_id long, event_type string, value double")
     .selectExpr("event_id", "CAST(timestamp_seconds(1700000000 + sec * 5000) AS timestamp_ntz) AS ts", "user_id", "event_type", "value").write.parquet(f"{tmpdir_path}/events.parquet"))
    return tmpdir_path


def _rows(df):
    return sorted(map(str, df.collect()))


def test_shares_are_all_posts(spark, tables):
    whole = _rows(raw_posts(spark, tables))
    assert len(whole) > 60
    assert sorted(sum((_rows(raw_posts(spark, tables, (i, 3))) for i in range(3)), [])) == whole


def test_mixed_csv_is_written_and_read_in_shares(spark, tables, monkeypatch, tmp_path):
    made = []
    write = q_ingest._write_mixed
    build = REGISTRY["ingest_csv_mixed"].build
    whole = _rows(build(spark, tables))
    monkeypatch.setattr(q_ingest, "SHARE_BYTES", 1000)
    monkeypatch.setattr(q_ingest, "_folder", lambda *_: str(tmp_path / "mixed-csv"))
    monkeypatch.setattr(q_ingest, "_write_mixed", lambda posts, path: (made.append(path), write(posts, path)))
    n = q_ingest._shares(spark, tables)
    assert 2 < n < 10 and _rows(build(spark, tables)) == whole and len(whole) > 60
    # no share's files are left when the next one is written
    assert made == [str(tmp_path / "mixed-csv" / str(i)) for i in range(n)]
    assert os.listdir(tmp_path / "mixed-csv") == ["read"]


def test_the_corpus_is_published_without_a_shuffle_of_its_texts(spark, monkeypatch, tmpdir_path):
    E = corpus(spark)
    clustered = []
    monkeypatch.setattr(sinks, "cluster_for_write", lambda E, *by: (clustered.append(by), E)[1])
    sinks.export_corpus_bundle(E, f"{tmpdir_path}/plain")
    assert not clustered
    n, back = sinks.read_bundle(spark, f"{tmpdir_path}/plain")["corpus_enrichi"]
    assert n == E.count() and _rows(back.select(*E.columns)) == _rows(E)
    files = glob.glob(f"{tmpdir_path}/plain/corpus_enrichi/date=*/*.parquet")
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    monkeypatch.setattr(sinks, "MAX_FILES", 0)
    sinks.export_corpus_bundle(E, f"{tmpdir_path}/clustered")
    assert clustered == [("date", "post_id")]


def test_shuffles_released_puts_the_setting_back(spark, tmpdir_path):
    before = spark.conf.get(CLEANUP)
    with pytest.raises(ZeroDivisionError), shuffles_released(spark):
        assert spark.conf.get(CLEANUP) == "true"
        1 / 0
    assert spark.conf.get(CLEANUP) == before
    os.makedirs(f"{tmpdir_path}/a/b")
    delete(spark, f"{tmpdir_path}/a")
    assert not os.path.exists(f"{tmpdir_path}/a")
