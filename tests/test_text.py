"""Text functions: native against exact, and against small brute force."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluiceway.functions import text as X

SAMPLES = ["What's the p99 of Checkout-API?", "ＦＵＬＬ width café Zoë’s", "a--b c_d e.f /x/ 18:04", "", None, "It's 'quoted' — (resolved) #inc-4821", "tabs\tand\nlines", "­soft​ zero"]


def column(spark, texts, expr):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normalize(spark):
    got = column(spark, SAMPLES, X.normalize_text)
    assert got[0] == "what is the p99 of checkout-api"
    assert got[1] == "full width cafe zoe"
    assert got[2] == "a b c_d e.f x 18:04"
    assert got[3] == "" and got[4] is None
    assert got[5] == "it is quoted resolved inc-4821"
    assert column(spark, SAMPLES[:7], X.normalize_text_exact) == got[:7]
    again = column(spark, [g for g in got if g is not None], X.normalize_text)
    assert again == [g for g in got if g is not None]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_normalize_python_is_idempotent(t):
    n = X.normalize_python(t)
    assert X.normalize_python(n) == n and re.fullmatch(r"([a-z0-9]([a-z0-9\-_./:@]*[a-z0-9])?( |$))*", n)


def test_tokens_and_forms(spark):
    assert column(spark, ["the p99 of checkout-api x"], X.tokens) == [["the", "p99", "of", "checkout-api"]]
    assert column(spark, ["the p99 of checkout-api please"], lambda c: X.content_tokens(X.tokens(c))) == [["p99", "checkout-api"]]
    assert column(spark, ["replicas", "status", "glass", "bus", "this", "pods"], X.fold_token) == ["replica", "status", "glass", "bus", "this", "pods"]
    assert set(column(spark, ["on-call replicas"], lambda c: X.match_forms(F.split(c, " ")))[0]) == {"on-call", "on-calls", "oncall", "replicas", "replica"}
    assert column(spark, ["pods", "usage", "p99", "nothing", "restart"], X.synonyms) == [["replicas", "instances"], ["utilization"], None, None, None]


def test_sentences_and_paragraphs(spark):
    assert column(spark, ["One. Two!  Three?\nFour", "", "  ", None, "no end"], X.split_sentences) == [["One.", "Two!", "Three?", "Four"], [], [], None, ["no end"]]
    assert column(spark, ["a\n\nb\r\n \r\nc\nd", "", None], X.paragraphs) == [["a", "b", "c\nd"], [], None]


def test_grams_and_markdown(spark):
    assert column(spark, ["abc", "a"], X.char_ngrams) == [[" ab", "abc", "bc "], [" a "]]
    df = spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), ([], [])], "x array<string>, y array<string>")
    assert [r.v for r in df.select(X.dice(F.col("x"), F.col("y")).alias("v")).collect()] == [0.4, 0.0]
    assert column(spark, ["See [the docs](http://x.y) `code` <b>now</b> &amp; ```a\nb``` then"], X.clean_markdown) == ["See the docs now then"]


@pytest.mark.parametrize("text", [None, "", "x" * 200_000])
def test_long_and_empty(spark, text):
    out = column(spark, [text], lambda c: F.size(F.coalesce(X.tokens(X.normalize_text(c)), F.array().cast("array<string>"))))
    assert out == [1 if text else 0]
