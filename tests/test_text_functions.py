import random
import unicodedata

from pyspark.sql import functions as F

from crisislens.functions.numbers import fmt_py, format_int, round_even, round_py
from crisislens.functions.text import (copy_fingerprint, extract_tokens, fold_lower, matches_any, portable_regex,
                                       shorten, strip_accents, trim_ws)


def _one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("y")).first()["y"]


def test_round_py_matches_python(spark):
    random.seed(7)
    vals = [0.35, 2.25, 2.675, 0.125, -0.35, 1.005, 12.35, 99.95] + [random.random() * 200 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    rows = df.select("x", round_py(F.col("x"), 1).alias("r1"), round_py(F.col("x"), 2).alias("r2"),
                     fmt_py(F.col("x"), 1).alias("f1")).collect()
    for r in rows:
        assert r.r1 == round(r.x, 1) and r.r2 == round(r.x, 2) and r.f1 == f"{r.x:.1f}"


def test_round_even_is_numpy_rule(spark):
    assert _one(spark, round_even(F.col("x"), 0), 2.5, "x double") == 2.0
    assert _one(spark, round_even(F.col("x"), 1), 0.35, "x double") == 0.4   # numpy gives 0.4, Python 0.3


def test_format_int(spark):
    assert _one(spark, format_int(F.col("x")), 1234567.5, "x double") == "1 234 568"
    assert _one(spark, format_int(F.col("x")), 2.5, "x double") == "2"


def test_strip_accents_matches_nfkd_on_latin(spark):
    text = "Éçàèùâêîôûëïüÿñõãåøœæß ÀÉÎÕÜ é ça"
    expected = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    assert _one(spark, strip_accents(F.col("x")), text) == expected
    assert _one(spark, fold_lower(F.col("x")), "Harcèlement Ministère") == "harcelement ministere"
    # ligatures need the exact (Arrow UDF) path
    assert _one(spark, strip_accents(F.col("x"), exact=True), "ﬁn ½") == "fin 1⁄2"


def test_unicode_word_tokens(spark):
    assert _one(spark, extract_tokens(F.col("x"), "#"), "Vive #Noël et #été_2 #") == ["#noël", "#été_2"]
    assert _one(spark, extract_tokens(F.col("x"), "@"), "cc @Bob, @@x") == ["@bob", "@x"]


def test_trim_unicode_whitespace(spark):
    assert _one(spark, trim_ws(F.col("x")), " \t ab c  \n") == "ab c"


def test_portable_boundaries(spark):
    p = portable_regex(r"\bcnc\b")
    df = spark.createDataFrame([("le cnc.",), ("cncx",), ("écnc",), ("cnc",)], "x string")
    got = [r[0] for r in df.select(F.col("x").rlike(p)).collect()]
    assert got == [True, False, False, True]


def test_matches_any_equals_regex_alternation(spark):
    pats = ("fonds", "fonds d aide", r"\bcnc\b", "3 m", "extreme-droite")
    rows = [("les fonds",), ("le cnc",), ("3 millions",), ("extreme-droite",), ("rien",), ("cncx",)]
    df = spark.createDataFrame(rows, "x string")
    from crisislens.functions.text import alternation
    got = df.select(matches_any(F.col("x"), pats, text_is_lower=True).alias("a"),
                    F.col("x").rlike(alternation(pats)).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_copy_fingerprint(spark):
    t = "RT  Hello @Bob see https://t.co/xyz #Tag\t\ttoo  "
    assert _one(spark, copy_fingerprint(F.col("x")), t) == "rt hello @user see URL #tag too"
    long = "a" * 300
    assert len(_one(spark, copy_fingerprint(F.col("x")), long)) == 220


def test_shorten(spark):
    assert _one(spark, shorten(F.col("x"), 5, "..."), "  abc  ") == "abc"
    assert _one(spark, shorten(F.col("x"), 5, "..."), "abcd efgh") == "abcd..."
