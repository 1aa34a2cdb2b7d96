import datetime as dt

from pyspark.sql import functions as F

from conftest import posts_df
from crisislens.operators import metrics as M
from crisislens.operators import periods as P
from crisislens.operators.enrich import enrich
from crisislens.sources.fixtures import POSTS_MAPPING


def T(d, h, m=0, s=0, us=0):
    return dt.datetime(2024, 1, d, h, m, s, us)


def corpus(spark):
    times = [T(1, 10), T(1, 23, 59, 59), T(1, 23, 59, 59, 500000), T(2, 0), T(2, 12), T(2, 13), T(3, 9)]
    rows = [(i, t, f"@u{i % 3}", "argent public" if i % 2 else "bonjour", None, None, None, 0., 0., 0.,
             float(i), 0., 0.) for i, t in enumerate(times)]
    return enrich(posts_df(spark, rows), POSTS_MAPPING)


def test_inclusive_overlapping_open_and_empty(spark):
    E = corpus(spark)
    periods = P.periods_frame(spark, [
        ("a", T(1, 0), T(1, 23, 59, 59)),      # inclusive end; the .5 s post is outside
        ("b", T(1, 23), T(2, 12)),             # overlaps a
        ("c", None, T(1, 10)),                 # open start
        ("d", T(2, 12), None),                 # open end
        ("e", T(5, 0), T(6, 0)),               # no posts
    ])
    Ep = P.assign_periods(E, periods)
    got = {r.period_id: r.messages for r in M.kpis(Ep, by=["period_id"]).collect()}
    assert got == {"a": 2, "b": 4, "c": 1, "d": 3}


def test_shuffled_period_join_same_result(spark):
    E = corpus(spark)
    periods = P.periods_frame(spark, [("a", T(1, 0), T(2, 23)), ("b", T(2, 0), T(3, 23))])
    small = M.kpis(P.assign_periods(E, periods), by=["period_id"]).collect()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = M.kpis(P.assign_periods(E, periods), by=["period_id"]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(map(tuple, small)) == sorted(map(tuple, big))


def test_peak_day_bounds(spark):
    pk = P.peak_day_periods(corpus(spark), top=2).orderBy("peak_rank").collect()
    assert pk[0].start == T(1, 0) and pk[0].end == T(1, 23, 59, 59)   # whole seconds (reference bound)


def test_crisis_velocity_bounds_and_level(spark):
    E = corpus(spark)
    Ep = P.assign_periods(E, P.peak_day_periods(E, 3).select("period_id", "start", "end"))
    rows = P.crisis_velocity(Ep, E).collect()
    assert len(rows) == 3
    for r in rows:
        assert 0 <= r.crisis_velocity_score <= 100
        assert r.niveau in ("CRISE FORTE", "CRISE ÉLEVÉE", "CRISE MODÉRÉE", "SIGNAL FAIBLE / BRUIT")
        assert round(r.crisis_velocity_score, 1) == r.crisis_velocity_score


def test_focus_days_semi_join(spark):
    E = corpus(spark)
    f = P.focus_days(E, 1)
    assert f.select(F.countDistinct("day")).first()[0] == 1 and f.count() == 3


def test_peak_day_rank_bounds(spark):
    import pytest
    E = corpus(spark)
    assert P.peak_day_period(E, 2).first().period_id == "peak_day_2"
    with pytest.raises(ValueError):
        P.peak_day_period(E, 4)          # three days only
    with pytest.raises(ValueError):
        P.peak_day_period(E, 0)
