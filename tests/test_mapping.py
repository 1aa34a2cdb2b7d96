import pytest

from crisislens.sources.mapping import auto_map_columns, missing_columns, norm_name, ranked_columns, resolve_mapping


def test_norm_name_folds_accents_and_punctuation():
    assert norm_name("  Réponses / Total ") == "reponses_total"
    assert norm_name("X Repost of") == "x_repost_of"
    assert norm_name("---") == ""


def test_exact_match_uses_candidate_order():
    assert ranked_columns(["tweet", "Text"], ["Full Text", "Text", "Tweet"])[0] == (0, 1, "Text")


def test_fuzzy_match_is_greedy_both_ways():
    # 'ts' sits inside 'comments': the substring rule maps it (trap Z1)
    m = auto_map_columns(["event_id", "ts", "user_id", "event_type", "value", "props"])
    assert m["comments"] == "ts" and m["shares"] == "ts"
    assert m["author"] == "user_id" and m["date"] is None and m["text"] is None
    # 'author' is inside 'mentioned_authors'
    m2 = auto_map_columns(["Date", "Author", "Full Text"])
    assert m2["mentions"] == "Author" and m2["post_date"] == "Date"


def test_later_duplicate_header_wins():
    assert ranked_columns(["Likes", "likes "], ["Likes"]) == [(0, 0, "likes "), (1, 0, "likes ")]


def test_validate_and_resolve(spark):
    assert missing_columns({"date": "d", "author": None, "text": "t"}) == ["author"]
    df = spark.createDataFrame([("a", "b")], "foo string, bar string")
    with pytest.raises(ValueError):
        resolve_mapping(df)
    m = resolve_mapping(df, {"date": "foo", "author": "bar", "text": "foo"})
    assert m["date"] == "foo" and m["likes"] is None
