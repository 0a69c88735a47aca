from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyrank.functions import text as t


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(("given", "want"), [("get_menu_items", ["get", "menu", "items"]), ("getMenuItems", ["get", "menu", "items"]), ("", []), (None, [])])
def test_tokenize(spark, given, want):
    assert one(spark, t.tokenize, given) == want


def test_char_ngrams(spark):
    assert one(spark, t.char_ngrams, "abc") == ["#ab", "abc", "bc#"]
    assert one(spark, t.char_ngrams, "a") == ["#a#"]


def test_content_terms(spark):
    assert one(spark, t.content_terms, "Please book a Table, book x tableNow") == ["book", "table", "now"]


def test_keywords(spark):
    assert one(spark, lambda c: t.keywords(c, 2), "The fast fast red-car of an owner") == ["fast", "red-car"]


def test_humanize(spark):
    assert one(spark, t.humanize_identifier, "searchRestaurants-near.Me") == "search restaurants near me"


def test_phrases(spark):
    assert one(spark, t.action_phrase, "book_tableNow") == "book table now"
    assert one(spark, t.object_phrase, "book_tableNow") == "table now"
    assert one(spark, t.object_phrase, "book") == "book"


@pytest.mark.parametrize(("given", "want"), [("", 0), (None, 0), ("abcdefgh", 2), ("a b c d", 5), ("x", 1)])
def test_token_estimate(spark, given, want):
    assert one(spark, t.token_estimate, given) == want


def test_typo(spark):
    assert one(spark, t.typo_map, "Please order a table?") == "pls ordr a tabel"
    got = one(spark, t.typo_map, "gigantic zebras")
    assert got != "gigantic zebras" and sorted(got) == sorted("gigantic zebras")
    assert one(spark, t.typo_map, "tiny ox") == "tiny ox"
    assert one(spark, t.typo_map, "") == ""


def test_band(spark):
    rows = spark.createDataFrame([(0.85,), (0.7,), (0.55,), (0.1,)], "s double").select(t.score_band(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["very high", "high", "moderate", "low"]
