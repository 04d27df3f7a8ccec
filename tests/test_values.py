"""Readings, equality and transforms at their edges."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import equality as eq
from ledgerloom.functions import text as tx
from ledgerloom.operators import infer
from ledgerloom.operators import transform as tr
from ledgerloom.operators.transform import Step


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()[0]


@pytest.mark.parametrize(("text", "number"), [("12", 12.0), (" 1e3 ", 1000.0), (".5", 0.5), ("1d", None), ("0x10", None), ("", None), ("Infinity", None), (None, None), ("1\n", 1.0), (" 7﻿", 7.0)])
def test_to_number(spark, text, number):
    assert one(spark, text, tx.to_number) == number


@pytest.mark.parametrize(("text", "shape"), [(None, "BLANK"), (" ", "BLANK"), ("1", "NUMBER"), ("-1.50", "NUMBER"), ("$1", "CURRENCY"), ("1,234.00", "CURRENCY"), ("EUR 5", "CURRENCY"), ("yes", "BOOLEAN"), ("2024-01-31", "DATE"), ("2024-02-30", "TEXT"), ("1/2/2024", "DATE"), ("x", "TEXT")])
def test_shapes(spark, text, shape):
    assert one(spark, text, tx.shape_of) == shape


@pytest.mark.parametrize(("a", "b", "verdict"), [('{"a":1,"b":2}', '{"b":2,"a":1.0}', "EQUAL"), ("[1,2]", "[2,1]", "DIFFERENT"), ('{"a":null}', "{}", "DIFFERENT"), ('{"a":1,"a":1}', '{"a":1}', "NOT_COMPARABLE"), ("{", "{}", "DIFFERENT"), ("{", "{", "EQUAL"), (None, None, "EQUAL"), (None, "1", "DIFFERENT"), ('"1"', "1", "DIFFERENT"), ("12345678901234567890", "12345678901234567891", "DIFFERENT"), ("[" * 70 + "]" * 70, "[" * 70 + " " + "]" * 70, "NOT_COMPARABLE")])
def test_compare_json(spark, a, b, verdict):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(eq.compare_json(F.col("a"), F.col("b"))).first()[0] == verdict


@pytest.mark.parametrize(("value", "steps", "want", "error", "lossy"), [
    ("", [Step("TO_INTEGER")], "0", None, False),
    ("-2.5", [Step("TO_DECIMAL", {"scale": 0})], "-2", None, True),
    ("-2.7", [Step("TO_INTEGER")], "-2", None, True),
    ("x", [Step("TO_INTEGER"), Step("CONSTANT", {"value": "y"})], None, "INVALID_NUMBER", False),
    ("31/02/2024", [Step("TO_DATE", {"format": "DD/MM/YYYY"})], None, "INVALID_DATE", False),
    ("01/02/2024", [Step("TO_DATE")], None, "AMBIGUOUS_DATE", False),
    ("2024-03-01T10:00:00Z", [Step("TO_DATE")], "2024-03-01", None, True),
    ("2024-03-01T10:00", [Step("TO_DATETIME")], "2024-03-01T10:00:00Z", None, False),
    ("{00112233-4455-6677-8899-AABBCCDDEEFF}", [Step("TO_GUID")], None, "INVALID_GUID", False),
    ("00112233445566778899AABBCCDDEEFF", [Step("TO_GUID")], "00112233-4455-6677-8899-aabbccddeeff", None, False),
    ("Active", tr.TEMPLATES["active_inactive"], "true", None, False),
    ("abc", [Step("IF_THEN", {"op": "IS_NOT_NULL", "then": "APPLY", "steps": [Step("TRUNCATE", {"length": 1})]})], "a", None, False),
    (None, [Step("PREFIX", {"text": "x"})], None, None, False),
])
def test_transform(spark, value, steps, want, error, lossy):
    r = tr.apply(spark.createDataFrame([(value,)], "v string"), "v", steps).first()["result"]
    assert (r["value"], r["error_code"], r["lossy"]) == (want, error, lossy)


def test_boolean_map_needs_booleans(spark):
    with pytest.raises(ValueError):
        tr.apply(spark.createDataFrame([("a",)], "v string"), "v", [Step("TO_BOOLEAN", {"map": {"a": "false"}})])


def test_condition_takes_null_for_zero(spark):
    assert one(spark, None, lambda c: tr.condition(c, "GREATER_THAN", "-1")) is True


def test_infer_key_and_headers(spark):
    df = spark.createDataFrame([("1", "A-1", "x"), ("2", "A-2", "x")], "row string, customer_code string, t string")
    types = [r.asDict() for r in infer.infer_types(df).collect()]
    assert infer.infer_key(types) == "customer_code"
    assert infer.unique_headers(["a", None, " a ", "A"]) == ["a", "column_2", "a 2", "A 3"]
