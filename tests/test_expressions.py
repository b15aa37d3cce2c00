"""Scalar expressions on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from sedimenta.errors import InvalidInput
from sedimenta.functions import expressions as x
from sedimenta.functions.text import tokens


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_case(spark):
    df = spark.createDataFrame([("foo",), ("baz",), (None,), ("bar",)], "a string").coalesce(1)
    branches = [(F.col("a") == "foo", F.lit(123)), (F.col("a") == "bar", F.lit(456))]
    assert [r[0] for r in df.select(x.case(branches, F.lit("999"), "int")).collect()] == [123, 999, 999, 456]
    assert [r[0] for r in df.select(x.case(branches)).collect()] == [123, None, None, 456]


@pytest.mark.parametrize(
    ("column", "want"),
    [("like 'h%'", ["hello"]), ("like '%d'", ["world"]), ("like 'w_rld'", ["world"]), ("not like 'h%'", ["HELLO", "WORLD", "world"]), ("ilike 'h%'", ["HELLO", "hello"]), ("not ilike '%D'", ["HELLO", "hello"])],
)
def test_like(spark, column, want):
    df = spark.createDataFrame([("hello",), ("world",), ("HELLO",), ("WORLD",), (None,)], "a string")
    assert sorted(r[0] for r in df.where(x.parse(f"a {column}")).collect()) == want


def test_arithmetic(spark):
    assert one(spark, x.wrapping("+", F.lit(2147483647), F.lit(1), IntegerType())) == -2147483648
    assert one(spark, x.wrapping("-", F.lit(-2147483648), F.lit(1), IntegerType())) == 2147483647
    assert one(spark, x.wrapping("*", F.lit(65536), F.lit(65536), IntegerType())) == 0
    assert one(spark, x.wrapping("+", F.lit(None).cast("int"), F.lit(1), IntegerType())) is None
    with pytest.raises(InvalidInput):
        x.wrapping("+", F.lit(1), F.lit(1), StringType())
    assert (one(spark, x.int_div(F.lit(-7), F.lit(2))), one(spark, F.lit(-7) % F.lit(2))) == (-3, -1)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one(spark, x.int_div(F.lit(1), F.lit(0)))
    assert one(spark, x.safe_div(F.lit(-1.0), F.lit(0.0))) == -math.inf
    assert math.isnan(one(spark, x.safe_div(F.lit(0.0), F.lit(0.0))))


def test_logic(spark):
    null = F.lit(None).cast("boolean")
    assert one(spark, null | F.lit(True)) is True and one(spark, null & F.lit(False)) is False and one(spark, ~null) is None
    assert one(spark, x.in_list(F.lit(1), [2, F.lit(None).cast("int")])) is None
    assert one(spark, x.in_list(F.lit(1), [2, 1], negated=True)) is False
    assert one(spark, x.is_distinct_from(F.lit(1), F.lit(None).cast("int"))) is True
    assert (one(spark, x.is_true(null)), one(spark, x.is_false(null)), one(spark, x.is_unknown(null))) == (False, False, True)
    assert one(spark, x.conjunction([])) is True and one(spark, x.conjunction([F.lit(True), null])) is None
    assert one(spark, x.simple_case(F.lit(2), [(F.lit(1), F.lit("a")), (F.lit(2), F.lit("b"))])) == "b"


def test_tokens(spark):
    assert one(spark, tokens(F.lit("Ab1 c,\né"))) == ["Ab1", " ", "c", ",", "é"]
