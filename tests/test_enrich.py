import datetime as dt

from pyspark.sql import functions as F

from crisislens.config import DEFAULT_NARRATIVE
from crisislens.operators.enrich import enrich

SCHEMA = ("Date string, Author string, `Full Text` string, Likes string, Retweets string, `X Repost of` string, "
          "tonalite string, `Engagement Type` string, Reach string")
ROWS = [
    ("2024-03-26 10:15:00", "@@alice", "RT Argent public et #Subvention pour les potes", " 12 ", "1,234", None,
     "Négatif ", "retweet", "100"),
    ("not a date", "bob", "x", None, None, None, None, None, None),
    (None, "carol", "y", None, None, None, None, None, None),
    ("2024-03-26 11:00:00", "   ", "Bonne journée", "abc", None, "someone", None, "Reply to quote", "0"),
    ("2024-03-27 09:30:00", None, None, None, None, None, "positive", None, "50"),
]


def _enriched(spark):
    return enrich(spark.createDataFrame(ROWS, SCHEMA)).orderBy("dt").collect()


def test_bad_dates_dropped_and_buckets(spark):
    rows = _enriched(spark)
    assert len(rows) == 3
    r = rows[0]
    assert r.dt == dt.datetime(2024, 3, 26, 10, 15)
    assert r.day == dt.datetime(2024, 3, 26) and r.hour == dt.datetime(2024, 3, 26, 10)
    assert r.date == dt.date(2024, 3, 26) and r.hour_of_day == 10 and r.week == "2024-03-25/2024-03-31"


def test_author_metrics_and_flags(spark):
    a, b, c = _enriched(spark)
    assert a.author == "alice" and b.author == "unknown" and c.author == "unknown"
    assert (a.likes, a.shares, a.comments, a.engagement_total) == (12.0, 0.0, 0.0, 12.0)   # '1,234' -> 0
    assert b.likes == 0.0
    assert a.engagement_type == "RETWEET" and c.engagement_type == "ORIGINAL"
    assert a.is_retweet and not a.is_original
    # repost column -> retweet; REPLY and QUOTE both match: flags overlap
    assert b.is_retweet and b.is_reply and b.is_quote and not b.is_original
    assert c.is_original and not (c.is_retweet or c.is_reply or c.is_quote)
    assert a.sentiment == "négatif" and b.sentiment == "unknown" and c.sentiment == "positive"


def test_entities_and_narratives(spark):
    a, b, c = _enriched(spark)
    assert a.hashtags_list == ["#subvention"] and a.hashtags_joined == "#subvention"
    assert a.mentions_list == ["@alice"]             # greedy mapping: mentions fall on Author
    assert a.narratives == ["Argent public / subventions", "Copinage / favoritisme"]
    assert a.main_narrative == "Argent public / subventions"
    assert a.narr_argent_public_subventions and a.narr_copinage_favoritisme and not a.narr_ultia_twitch
    assert b.narratives == [DEFAULT_NARRATIVE] and c.main_narrative == DEFAULT_NARRATIVE
    assert c.text_raw == "" and b.text_norm == "bonne journee"


def test_risk_levels_half_even_and_p95(spark):
    a, b, c = _enriched(spark)
    # p95 of [0, 50, 100] = 95: a = 1 + 2 + 1 + 0.5 + 1 = 5.5 -> 6 -> clamp 5
    assert a.risk_level == 5
    assert b.risk_level == 2      # 1 + 0.5 = 1.5 -> half-even 2
    assert c.risk_level == 1


def test_half_even_down_and_zero_p95(spark):
    schema = "Date string, Author string, Tweet string, `Engagement Type` string, Reach string"
    rows = [("2024-01-01 00:00:00", "u", "les potes", "RT", "0"),              # 1 + 1 + 0.5 = 2.5 -> 2
            ("2024-01-01 01:00:00", "u", "argent public des potes", "RT", "0")]  # 3.5 -> 4
    got = [r.risk_level for r in enrich(spark.createDataFrame(rows, schema)).orderBy("dt").collect()]
    assert got == [2, 4]                                                      # p95 = 0: no reach bonus


def test_one_projection_no_python(spark):
    E = enrich(spark.createDataFrame(ROWS, SCHEMA))
    plan = E._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    assert E.where(F.col("narr_argent_public_subventions")).count() == 1


def test_no_valid_date_is_an_error(spark):
    import pytest
    bad = spark.createDataFrame([("nope", "a", "t"), (None, "b", "u")], "Date string, Author string, Tweet string")
    with pytest.raises(ValueError):
        enrich(bad)


def test_exact_quantile_distributed_selection(spark):
    import random

    import numpy as np

    import crisislens.operators.enrich as EN
    random.seed(11)
    mixed = [float(random.choice([0, 0, 5, random.randint(0, 40), random.randint(0, 10**5)])) for _ in range(3000)]
    zeros = [0.0] * 19_900 + [float(random.randint(1, 10**6)) for _ in range(100)]
    for vals in (mixed, zeros, [7.0], [1.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in vals] + [(None,), (float("nan"),)], "reach double")
        for q in (0.0, 0.5, 0.95, 0.999, 1.0):
            assert EN.exact_quantile(df, "reach", q) == float(np.quantile(np.array(vals), q))
    assert EN.exact_quantile(spark.createDataFrame([(None,)], "reach double"), "reach", 0.5) is None


def test_one_date_format_for_the_column(spark):
    rows = [("03/04/2026 10:00", "a", "t"), ("26/03/2026 10:00", "b", "u"), ("12:30", "c", "v")]
    got = enrich(spark.createDataFrame(rows, "Date string, Author string, Tweet string")).orderBy("dt").collect()
    assert [r.dt for r in got] == [dt.datetime(2026, 3, 26, 10), dt.datetime(2026, 4, 3, 10)]
    only = enrich(spark.createDataFrame(rows, "Date string, Author string, Tweet string"), date_formats=["MM/dd/yyyy HH:mm"]).collect()
    assert [r.dt for r in only] == [dt.datetime(2026, 3, 4, 10)]


def test_numbers_are_plain_decimals(spark):
    from crisislens.functions.numbers import safe_double
    text = ["12d", "1f", "0x1p3", " 12 ", "1,234", "-3.5", ".5", "1e3", "NaN", "", None, "5."]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string").orderBy("i").select(safe_double(F.col("t"))).collect()]
    assert got == [0, 0, 0, 12, 0, -3.5, 0.5, 1000, 0, 0, 0, 5]


def test_text_ids_and_no_ids(spark):
    schema = "Date string, Author string, Tweet string, post_id string"
    E = enrich(spark.createDataFrame([("2026-01-01 00:00:00", "a", "t", f"tw_{i}") for i in range(3)], schema))
    assert sorted(r.post_id for r in E.collect()) == ["tw_0", "tw_1", "tw_2"]
    bare = spark.createDataFrame([("2026-01-01 00:00:00", f"a{i}", "t") for i in range(3)], "Date string, Author string, Tweet string")
    ids = [sorted(r.post_id for r in enrich(bare.repartition(n), {"date": "Date", "author": "Author", "text": "Tweet"}).collect()) for n in (1, 3)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 3


def test_copies_on_overlapping_periods_and_repeated_ids(spark):
    from crisislens.operators import periods as P
    from crisislens.operators import propagation as PR
    body = "the very same message goes round and round again today, with words enough"
    rows = [(f"2026-01-0{d} 0{h}:00:00", f"u{h}", f"{body} @x{h}", "tw_1" if h < 2 else f"tw_{d}{h}") for d in (1, 2) for h in range(4)]
    E = enrich(spark.createDataFrame(rows, "Date string, Author string, Tweet string, post_id string"))
    D = dt.datetime
    spans = [("a", D(2026, 1, 1), D(2026, 1, 1, 23)), ("b", D(2026, 1, 1), D(2026, 1, 3))]
    for n in (1, 2):
        got = {r.period_id: r for r in PR.copy_patterns(P.assign_periods(E, P.periods_frame(spark, spans[:n])), by=["period_id"]).collect()}
        assert {k: r["count"] for k, r in got.items()} == dict([("a", 4), ("b", 8)][:n]) and got["a"].example.startswith(body)
    plan = PR.copy_patterns(E)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "HashJoin" not in plan         # only the one-row quantile is joined
