"""Scalar expressions whose meaning differs from Spark's defaults, and shorthands for the rest.

Logic is three-valued (Kleene) everywhere; a NULL condition selects nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, ShortType

from ..errors import InvalidInput

_BITS = {ByteType: 8, ShortType: 16, IntegerType: 32, LongType: 64}


def parse(sql: str) -> Column:
    """A column from SQL text; types are coerced by the analyzer."""
    return F.expr(sql)


def wrapping(op: str, a: Column, b: Column, kind: DataType) -> Column:
    """``a op b`` for + - * in integers of ``kind`` that wrap around on overflow."""
    bits = _BITS.get(type(kind))
    if bits is None or op not in ("+", "-", "*"):
        raise InvalidInput(f"{op} on {kind.simpleString()} can't wrap")
    wide = "decimal(38,0)"
    x, y = a.cast(wide), b.cast(wide)
    exact = x + y if op == "+" else x - y if op == "-" else x * y
    size = F.lit(str(1 << bits)).cast(wide)
    half = F.lit(str(1 << bits - 1)).cast(wide)
    return (F.pmod((exact + half).cast(wide), size) - half).cast(kind)


def int_div(a: Column, b: Column) -> Column:
    """Quotient of integers, cut towards zero; an error for a zero divisor."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def safe_div(a: Column, b: Column) -> Column:
    """Quotient of floats by IEEE rules: infinities and NaN instead of an error."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(a.isNull(), None).when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(F.signum(a) * F.lit(float("inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def is_distinct_from(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def is_true(c: Column) -> Column:
    return c.eqNullSafe(F.lit(True))


def is_false(c: Column) -> Column:
    return c.eqNullSafe(F.lit(False))


def is_unknown(c: Column) -> Column:
    return c.isNull()


def in_list(c: Column, items: list, negated: bool = False) -> Column:
    """[NOT] IN over expressions or values; NULL items make a miss NULL."""
    hit = reduce(lambda x, y: x | y, [c == (i if isinstance(i, Column) else F.lit(i)) for i in items], F.lit(False))
    return ~hit if negated else hit


def case(branches: list[tuple[Column, Column]], otherwise: Column | None = None, then_type: str | None = None) -> Column:
    """Searched CASE: the first true branch; ELSE is tried as the type of THEN."""
    out = F
    for condition, value in branches:
        out = out.when(condition, value)
    if otherwise is None:
        return out
    return out.otherwise(otherwise.try_cast(then_type) if then_type else otherwise)


def simple_case(subject: Column, branches: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    return case([(subject == when, then) for when, then in branches], otherwise)


def conjunction(filters: list[Column]) -> Column:
    """All filters at once; true where there are none."""
    return reduce(lambda x, y: x & y, filters, F.lit(True))


def as_column(value: Column | str) -> Column:
    return F.expr(value) if isinstance(value, str) else value
