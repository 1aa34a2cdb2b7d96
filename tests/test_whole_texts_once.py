"""Texts are worked through only where a result needs them, and once."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, posts_df
from test_periods import T, corpus
from crisislens.functions.text import _template, alternation, copy_fingerprint, matches_any
from crisislens.operators import enrich as EN
from crisislens.operators import metrics as M
from crisislens.operators import periods as P
from crisislens.operators.enrich import enrich
from crisislens.plans import q_ingest, q_periods, sinks
from crisislens.plans.catalog import REGISTRY
from crisislens.plans.tables import READS, STRATEGY, PeriodTables, read_by
from crisislens.sources.fixtures import POSTS_MAPPING


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_days_of_periods_filter_below_the_text_work(spark):
    rows = [(i, T(1 + i % 9, 10), "@a", "argent public é", None, None, None, 0., 0., 0., 1., 0., 0.) for i in range(18)]
    E = enrich(posts_df(spark, rows).repartition(2), POSTS_MAPPING)
    Ep = P.assign_periods(E, P.peak_day_periods(E, 2))
    below = _plan(M.narratives_table(Ep, ["period_id"])).split("translate(", 1)[1]
    assert " IN (2024-01-" in below
    assert Ep.count() == 4


@pytest.mark.parametrize("known, days", [(1, 1000), (1000, 1), (1000, 1000)])
def test_periods_beyond_the_filter_are_joined(spark, monkeypatch, known, days):
    E = corpus(spark)
    periods = P.periods_frame(spark, [("a", T(1, 0), T(1, 23, 59, 59)), ("b", T(1, 23), T(2, 12)), ("c", T(9, 0), T(8, 0)), ("d", T(2, 12), T(3, 9))])
    monkeypatch.setattr(P, "KNOWN_PERIODS", known)
    monkeypatch.setattr(P, "KNOWN_DAYS", days)
    got = {(r.period_id, r.post_id) for r in P.assign_periods(E, periods).collect()}
    assert got == {("a", 0), ("a", 1), ("b", 1), ("b", 2), ("b", 3), ("b", 4), ("d", 4), ("d", 5), ("d", 6)}


def test_fingerprint_from_the_first_words_is_that_of_the_whole(spark):
    words = "Ministère ΟΔΟΣ #Fonds @user_1 https://t.co/ab  d aide\t\n"
    texts = [None, "", "court", words * 40, " " * 3000 + words * 9, "a" * 3000, "https://t.co/" + "x" * 3000 + " fin",
             "@" + "u" * 430 + " " + words * 20, "  " * 500 + "fin " * 300, "x" * 219 + " " * 500 + "y z", "x" * 439 + "ΟΣ" * 40,
             *[words * 30 + "z" * k for k in range(9)], *["é" * k + words * 12 for k in range(200, 240)], "#tag @u " * 300, "http:// " * 200]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(~copy_fingerprint(F.col("t")).eqNullSafe(_template(F.col("t"), 220))).count() == 0
    assert df.where(F.length(copy_fingerprint(F.col("t"))) == 220).count() > 20


def test_coordination_and_messages_read_stored_posts(spark):
    for name in ("coordination", "message_pack", "message_pack_all_channels"):
        assert "events.parquet" not in _plan(REGISTRY[name].build(spark, SF_SMALL)), name


def test_bundles_enrich_the_corpus_once(spark, monkeypatch, tmpdir_path):
    made = []

    def counted(*a, **k):
        made.append(a)
        return corpus(spark)

    monkeypatch.setattr(q_ingest, "corpus", counted)
    monkeypatch.setattr(q_periods, "corpus", counted)
    monkeypatch.setattr(q_ingest, "_folder", lambda spark, name: tmpdir_path)
    for name in ("export_analysis", "export_global_tables", "export_narratives", "export_propagation", "export_strategy"):
        monkeypatch.setattr(sinks, name, lambda *a: None)
    rows = [tuple(r) for r in REGISTRY["export_bundles"].build(spark, SF_SMALL).collect()]
    assert len(made) == 1 and rows == [("corpus", "corpus_enrichi", 7, True)]


def test_literals_are_searched_in_the_bytes_of_the_text(spark):
    pats = ("fonds", "fonds d aide", r"\bcnc\b", "3 m", "extreme-droite", "médias", r"taxes?")
    texts = [None, "", "les fonds", "le cnc", "écnc", "cnc", "3 millions", "Extreme-Droite", "des médias", "medias", "😀fonds😀", "f́onds", "taxe", "fond"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    found = matches_any(F.lower(F.col("t")), pats, text_is_lower=True)
    assert df.where(~found.eqNullSafe(F.col("t").rlike(alternation(pats)))).count() == 0
    assert df.where(found).count() == 8
    assert "Contains(lower" not in _plan(df.select(found)) and "as binary)" in _plan(df.select(found))


@pytest.mark.parametrize("most, shuffled", [(100_000, False), (0, True)])
def test_posts_are_not_shuffled_by_date(spark, monkeypatch, most, shuffled):
    E = corpus(spark)
    monkeypatch.setattr(P, "BROADCAST_DAYS", most)
    periods = P.periods_frame(spark, [("a", T(1, 0), T(2, 12)), ("b", T(2, 0), T(3, 23))])
    Ep = P.assign_periods(E, periods)
    assert ("hashpartitioning(date" in _plan(Ep)) == shuffled
    assert sorted((r.period_id, r.post_id) for r in Ep.collect()) == [("a", i) for i in range(5)] + [("b", i) for i in range(3, 7)]


def test_stored_posts_hold_the_columns_that_their_tables_read(spark, monkeypatch):
    E = corpus(spark)
    monkeypatch.setattr(q_periods, "corpus", lambda *a: E)
    _, posts = q_periods.stored_periods(spark, SF_SMALL)
    made = {name: lambda t, name=name: getattr(t, name) for name in ("kpis", "narratives", "sentiments", "risks", "propagation", "copies", "bursts")}
    made |= {"authors": lambda t: t.authors(5), "posts": lambda t: t.top_posts(5), "actors": lambda t: t.actors(5),
             "mutations": lambda t: t.mutations(), "concentration": lambda t: t.concentration()}
    assert set(made) == set(READS)
    for name, table in made.items():
        whole, slim = table(PeriodTables(posts)), table(PeriodTables(posts.select("period_id", *read_by(name))))
        assert slim.schema == whole.schema and sorted(map(str, slim.collect())) == sorted(map(str, whole.collect())), name
    _, slim = q_periods.stored_periods(spark, SF_SMALL, *STRATEGY)
    assert set(slim.columns) == {"period_id", *READS["kpis"], *READS["narratives"]}


def test_period_narratives_pass_the_posts_once(spark, monkeypatch):
    def unread(*a, **k):
        raise AssertionError("the table does not read the risk level")

    monkeypatch.setattr(EN, "exact_quantile", unread)
    for name in ("period_narratives", "period_top_hashtags", "period_sentiments"):
        assert _plan(REGISTRY[name].build(spark, SF_SMALL)).count("FileScan parquet [event_id") == 1, name


def test_narratives_table_keeps_empty_lists_and_drops_null_groups(spark):
    rows = [("a", ["x", "y"]), ("a", ["x"]), ("a", []), ("a", None), ("b", ["y", "y"]), (None, ["x"])]
    E = spark.createDataFrame(rows, "period_id string, narratives array<string>").repartition(3)
    got = {(r.period_id, r.narrative, r["count"], r.pct_messages) for r in M.narratives_table(E, ["period_id"]).collect()}
    assert got == {("a", "x", 2, 50.0), ("a", "y", 1, 25.0), ("a", None, 2, 50.0), ("b", "y", 2, 200.0)}
    whole = {(r.narrative, r["count"], r.pct_messages) for r in M.narratives_table(E).collect()}
    assert whole == {("x", 3, 50.0), ("y", 3, 50.0), (None, 2, 2 / 6 * 100.0)}
    assert M.narratives_table(E.limit(0)).count() == M.narratives_table(E.limit(0), ["period_id"]).count() == 0
