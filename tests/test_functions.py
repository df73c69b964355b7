"""Column builders on hand-written values."""

import datetime as dt
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.dates import timestamp_from_text
from tidemark.functions.missing import finite_or_null, is_missing, sanitize_frame
from tidemark.functions.numbers import number_from_text
from tidemark.functions.text import (
    normalize_key,
    split_words,
    strip_accents,
    strip_accents_text,
    trim_invisible,
)
from tidemark.operators.headers import normalize_name, normalized_names
from tidemark.operators.schema import coerced


def apply(spark, build, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in rows.select("i", build(F.col("x"))).orderBy("i").collect()]


def test_headers():
    assert normalize_name("Preço Unitário") == "preco_unitario"
    assert normalize_name("  Total-Geral (R$) ") == "total_geral_r"
    assert normalized_names(["Name", "name", "NAME"]) == ["name", "name_2", "name_3"]
    assert normalized_names(["Name", "name"], distinct=False) == ["name", "name"]


def test_accents_follow_unicode(spark):
    samples = ["São João", "Ünïcödé", "plain", "naïve café", "é", "Ærø", "Ñandú", "ǖ", "Ắ", "日本", "é" * 5]
    expected = [
        "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn") for s in samples
    ]
    assert apply(spark, strip_accents, samples) == expected
    assert [strip_accents_text(s) for s in samples] == expected


def test_keys(spark):
    assert apply(spark, normalize_key, ["  Product-123  ", None, "Ação, Já!", "A_b c"]) == [
        "product123", "", "acao ja", "a_b c",
    ]
    keep = lambda c: normalize_key(c, lowercase=False, accents=False, punctuation=False)
    assert apply(spark, keep, [" Ação-1 ", " x\t"]) == ["Ação-1", "x"]


def test_trim(spark):
    values = ["test\x00string", "  ", "a\tb", "﻿x​ ", None, " y　", ""]
    assert apply(spark, trim_invisible, values) == ["teststring", None, "ab", "x", None, "y", None]


@pytest.mark.parametrize(
    "text, number",
    [
        ("1,234.56", 1234.56), ("1.234,56", 1234.56), ("1,234", 1.234), ("1,2345", 12345.0),
        ("1,234,567", 1234567.0), ("12,5", 12.5), (" 7 ", 7.0), ("-1.000,5", -1000.5), ("1.234.567,8", 1234567.8),
        ("1e3", 1000.0), ("abc", None), ("", None), ("1d", None), ("1.2.3", None), ("+5", 5.0), (".5", 0.5),
        ("5.", 5.0), ("inf", float("inf")), ("-Infinity", float("-inf")), (None, None), ("1 000", None),
    ],
)
def test_numbers(spark, text, number):
    assert apply(spark, number_from_text, [text]) == [number]


def test_dates(spark):
    day = lambda *a: dt.datetime(*a)
    cases = {
        "2024-01-31": day(2024, 1, 31), "01/31/2024": day(2024, 1, 31), "31/01/2024": day(2024, 1, 31),
        "02/03/2024": day(2024, 2, 3), "2024-01-31T10:11:12": day(2024, 1, 31, 10, 11, 12),
        "2024/1/5": day(2024, 1, 5), "20240131": day(2024, 1, 31), "Jan 5, 2024": day(2024, 1, 5),
        "5 March 2024": day(2024, 3, 5), "2024-02-30": None, "not a date": None, "2024": None, "": None,
    }
    assert apply(spark, timestamp_from_text, list(cases)) == list(cases.values())


def test_declared_types(spark):
    assert apply(spark, lambda c: coerced(c, "integer"), ["3.9", "-3.9", "x", "NULL", ""]) == [3, -3, None, None, None]
    assert apply(spark, lambda c: coerced(c, "boolean"), ["YES", "1", "no", "none"]) == [True, True, False, None]
    assert apply(spark, lambda c: coerced(c, "price"), [" 1.50 ", "a"]) == [1.5, None]
    assert apply(spark, lambda c: coerced(c, "date"), ["2024-13-45"]) == ["2024-13-45"]


def test_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (float("inf"),)], "x double")
    kind = df.schema["x"].dataType
    assert [r[0] for r in df.select(is_missing(F.col("x"), kind)).collect()] == [False, True, True, False]
    assert [r[0] for r in df.select(finite_or_null(F.col("x"), kind)).collect()] == [1.0, None, None, None]
    assert [r[0] for r in sanitize_frame(df).collect()] == [1.0, None, None, None]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_words_are_split_like_python(spark, texts):
    clean = [t.replace("\x00", "").encode("utf-8", "ignore").decode() for t in texts]
    assert apply(spark, split_words, clean) == [t.split() for t in clean]
