"""Bundles, SQL functions, exact folding, ambiguous dates."""

import os
import unicodedata
import warnings

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, make_raw
from crisislens.functions.sql_functions import register_sql_functions
from crisislens.functions.text import strip_accents
from crisislens.operators.enrich import enrich
from crisislens.plans import sinks as SK
from crisislens.plans.catalog import REGISTRY


def test_exact_folding_of_every_character(spark):
    """U+0080 to U+FFFF and a part of the planes beyond, alone and within words."""
    points = [cp for cp in [*range(0x80, 0x10000), *range(0x1D400, 0x1D800), *range(0x2F800, 0x2FA20)] if not 0xD800 <= cp <= 0xDFFF]
    rows = [(chr(cp),) for cp in points] + [("une ﬁn ½ ĳ 한국 ａ é",), ("plain",), ("",), (None,)]
    folded = lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    df = spark.createDataFrame(rows, "t string").withColumn("f", strip_accents(F.col("t"), exact=True))
    wrong = [(r["t"], r["f"]) for r in df.collect() if r["f"] != folded(r["t"])]
    assert not wrong, wrong[:5]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_sql_functions_are_inlined(spark):
    names = register_sql_functions(spark)
    assert {"crisis_velocity_score", "strategic_risk_score", "crisis_level", "narrative_risk_label", "crisis_priority"} <= set(names)
    got = spark.sql("SELECT crisis_level(80), crisis_level(79.9), narrative_risk_label(60), round_exact(0.25, 10), round_exact(0.35, 10), response_angle('Argent public')").first()
    assert tuple(got)[:5] == ("CRISE FORTE", "CRISE ÉLEVÉE", "Élevé", round(0.25, 1), round(0.35, 1)) and got[5].startswith("Transparence")
    plan = REGISTRY["scores_sql"].build(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "crisis_level(" not in plan


def test_a_bundle_that_fails_is_not_visible(spark, tmpdir_path):
    good = spark.range(3).selectExpr("id", "array(id) as list")
    bad = spark.range(3).selectExpr("cast(raise_error('lost') as string) as x")
    first, second = os.path.join(tmpdir_path, "first"), os.path.join(tmpdir_path, "second")
    SK._bundle(first, {"a": good}, {}, {"b": good})
    with pytest.raises(Exception, match="lost"):
        SK._bundle(second, {"a": good, "c": bad}, {}, {})
    assert SK.published(spark, tmpdir_path) == ["first"]
    assert {k: (n, df.count()) for k, (n, df) in SK.read_bundle(spark, first).items()} == {"a.csv": (3, 3), "b.json": (3, 3)}
    with pytest.raises(ValueError):
        SK.read_bundle(spark, second)
    with pytest.raises(Exception, match="lost"):
        SK._bundle(first, {"a": bad}, {}, {})                                # an older bundle that is written anew
    assert SK.published(spark, tmpdir_path) == []


def test_ambiguous_dates_warn_or_follow_the_caller(spark):
    raw = make_raw(spark, [("03/04/2024 10:00:00", "a", "x"), ("05/06/2024 11:00:00", "b", "y")])
    first = lambda df: sorted(str(r["dt"])[:10] for r in df.select("dt").collect())
    with pytest.warns(UserWarning, match="day_first"):
        assert first(enrich(raw)) == ["2024-03-04", "2024-05-06"]
    with warnings.catch_warnings():
        warnings.filterwarnings("error", message=".*day_first.*")
        assert first(enrich(raw, day_first=True)) == ["2024-04-03", "2024-06-05"]
        assert first(enrich(raw, day_first=False)) == ["2024-03-04", "2024-05-06"]
        clear = make_raw(spark, [("03/04/2024 10:00:00", "a", "x"), ("25/06/2024 11:00:00", "b", "y")])
        assert first(enrich(clear)) == ["2024-04-03", "2024-06-25"]
