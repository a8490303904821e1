"""Semantics of the per-row column builders, checked against Python's own string methods."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from qualis.functions import names as N
from qualis.functions import text as X
from qualis.policy import Policy

CASE_SAMPLES = ["Hello World", "hello", "HELLO", "O'Neil", "X1Y", "x1y", "ÉCOLE", "École", "123", "", "A", "aB",
                "Ab Cd-Ef", "in-progress", "In-Progress", "on hold", "Closed", "ACTIVE", "mIxEd CaSe", "ß straße",
                "a1b2 c3", "  padded  ", "Über-Cool", "x", "1a", "A1b", "DžUNGLA"]


def one_col(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_trim_matches_python_strip(spark):
    vals = ["\t a ", "\u001c a ", "no-pad", " both ", "\n\r x \x85", "　wide　", "", "   "]
    got = [r[0] for r in one_col(spark, vals).select(X.py_strip("v")).collect()]
    assert got == [v.strip() for v in vals]


def test_untrimmed_predicate(spark):
    vals = ["a", " a", "a\t", None, "", " "]
    got = [r[0] for r in one_col(spark, vals).select(X.is_untrimmed("v")).collect()]
    assert got == [False, True, True, False, False, True]


def test_title_case_matches_python(spark):
    vals = ["in-progress o'neil x1y ÉCOLE", "on hold", "ACTIVE", "mIxEd CaSe", "a1b2 c3", "über-cool", "", None]
    got = [r[0] for r in one_col(spark, vals).select(X.title_case("v")).collect()]
    assert got == [v.title() if v is not None else None for v in vals]
    assert got[0] == "In-Progress O'Neil X1Y École"


def test_case_predicates_match_python(spark):
    rows = one_col(spark, CASE_SAMPLES).select(
        "v", X.is_lower("v").alias("lo"), X.is_upper("v").alias("up"), X.is_title("v").alias("ti")).collect()
    for r in rows:
        v = r["v"]
        assert r["lo"] == v.islower(), v
        assert r["up"] == v.isupper(), v
        assert r["ti"] == v.istitle(), v


@pytest.mark.parametrize("text,expected", [
    (" 12 ", 12.0), ("1e3", 1000.0), ("inf", math.inf), ("-2.5", -2.5), (".5", 0.5), ("+7", 7.0),
    ("0x1f", None), ("1_000", None), ("12d", None), ("1,234", None), ("True", None), ("", None), ("nan", None),
])
def test_numeric_text(spark, text, expected):
    got = one_col(spark, [text]).select(X.to_number("v")).first()[0]
    assert got == expected


def test_hash16_equals_python_sha256(spark):
    vals = ["user26@example.com", "plain", "ünïcode"]
    got = [r[0] for r in one_col(spark, vals).select(X.hash16("v")).collect()]
    assert got == [hashlib.sha256(v.encode()).hexdigest()[:16] for v in vals]


def test_mask_if_email(spark):
    vals = ["a@b.com", "not-an-address", None]
    got = [r[0] for r in one_col(spark, vals).select(X.mask_if_email("v")).collect()]
    assert got == [hashlib.sha256(b"a@b.com").hexdigest()[:16], "not-an-address", None]


def test_null_token_predicate(spark):
    pol = Policy()
    vals = ["N/A", "--", " none ", "", "  ", None, "Retail", "  Retail", "null", "NaN"]
    det = [r[0] for r in one_col(spark, vals).select(X.null_token("v", pol)).collect()]
    fix = [r[0] for r in one_col(spark, vals).select(X.null_token("v", pol, include_nulls=False)).collect()]
    assert det == [True, True, True, True, True, True, False, False, True, True]
    assert fix == det[:5] + [False] + det[6:]


def test_preserve_phrases_are_not_tokens(spark):
    pol = Policy()
    if not pol.preserve_phrases:
        pytest.skip("policy has no preserve phrases")
    phrase = sorted(pol.preserve_phrases)[0]
    got = one_col(spark, [phrase]).select(X.null_token("v", pol, include_nulls=False)).first()[0]
    assert got is False


def test_serial_date(spark):
    df = spark.createDataFrame([(45000.5,), (1.0,)], "v double")
    got = [r[0].isoformat() for r in df.select(X.serial_to_timestamp("v")).collect()]
    assert got == ["2023-03-15T12:00:00", "1899-12-31T00:00:00"]


def test_patterns_are_anchored_like_re_match(spark):
    vals = ["a.b@example.com", "x a.b@example.com", "+1 555 0110 4100", "10.0.1.7", "12.5%", "$1,234.50"]
    df = one_col(spark, vals).select(
        X.matches("v", X.EMAIL_FULL).alias("em"), X.searches("v", X.EMAIL_PATTERN).alias("es"),
        X.matches("v", X.PHONE_FULL).alias("ph"), X.matches("v", X.IP_PREFIX).alias("ip"),
        X.matches("v", X.PERCENT_FULL).alias("pc"), X.matches("v", X.CURRENCY_FULL).alias("cu"))
    r = df.collect()
    assert [x["em"] for x in r] == [True, False, False, False, False, False]
    assert [x["es"] for x in r][:2] == [True, True]
    assert r[2]["ph"] and r[3]["ip"] and r[4]["pc"] and r[5]["cu"]


@pytest.mark.parametrize("name,expected", [
    ("customerID", "customer_id"), ("Order Date", "order_date"), ("first-name  x", "first_name_x"),
    ("__a__b__", "a_b"), ("amount", "amount"),
])
def test_snake_case(name, expected):
    assert N.snake_case(name) == expected


def test_wide_table_name_is_bounded():
    assert N.wide_table_name("Orders") == "orders_wide"
    assert len(N.wide_table_name("x" * 200)) <= 63


def test_collapse_whitespace(spark):
    got = one_col(spark, ["a  b\t\tc"]).select(X.collapse_whitespace("v")).first()[0]
    assert got == "a b c"


def test_tokenize_is_stable_and_null_safe(spark):
    df = one_col(spark, ["Ann", "Ann", None]).select(X.tokenize("v").alias("t"))
    t = [r[0] for r in df.collect()]
    assert t[0] == t[1] and t[0].startswith("tok_") and t[2] is None


def test_builders_stay_native(spark):
    """No Python UDF in a compiled fix expression: the plan must not hold a BatchEvalPython node."""
    df = one_col(spark, ["x"]).select(X.title_case("v"), X.null_token("v"), X.to_number("v"), X.hash16("v"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert F is not None


def test_group_key_keeps_equality(spark):
    long_a, long_b = "x" * 40, "x" * 39 + "y"
    vals = ["short", "short", long_a, long_a, long_b, None]
    df = one_col(spark, vals).select(X.group_key("v").alias("k"))
    assert df.distinct().count() == len(set(vals))
    keys = [r[0] for r in df.collect()]
    assert keys[0] == "short" and keys[2] != long_a and keys[2] == keys[3] and keys[4] != keys[2]
