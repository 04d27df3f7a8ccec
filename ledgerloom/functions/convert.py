"""Conversion of values to a target's type: what can't be kept is refused, never bent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .equality import plain_decimal
from .text import CONVERT_FALSE, CONVERT_TRUE, GUID, INFER_FALSE, INFER_TRUE, is_blank, js_trim, right_trim, round_half_up, to_instant, to_number

RANGES = {"Integer": (-2147483648, 2147483647), "BigInt": (-9007199254740991, 9007199254740991)}


def _result(value: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error_code"))


def cross_provider(c: Column, target: str, max_length: int | None = None, scale: int | None = None, fixed_width: bool = False) -> Column:
    """(value, error_code) of a text for another provider's type.

    Refuses truncation, fractions for whole numbers, values out of range, rounding that
    loses digits, dates that don't exist and empty text for numbers. Null stays null.
    """
    t = js_trim(c)
    blank = is_blank(c)
    none = F.lit(None).cast("string")
    if target in ("String", "Memo"):
        v = right_trim(c) if fixed_width else c
        return _result(v, F.when(F.length(v) > max_length, "STRING_TOO_LONG") if max_length else none)
    if target in RANGES:
        n = to_number(c)
        lo, hi = RANGES[target]
        bad = F.when(c.isNotNull() & n.isNull(), "INVALID_NUMBER").when(n != F.floor(n), "FRACTIONAL_VALUE").when((n < lo) | (n > hi), "OUT_OF_RANGE")
        return _result(n.try_cast("bigint").cast("string"), bad)
    if target in ("Decimal", "Money", "Double"):
        n = to_number(c)
        rounded = n if scale is None else round_half_up(n, scale)
        lost = F.abs(rounded - n) > 1e-9 * F.greatest(F.abs(n), F.lit(1.0))
        return _result(plain_decimal(rounded.cast("decimal(38,10)")), F.when(c.isNotNull() & n.isNull(), "INVALID_NUMBER").when(lost, "PRECISION_LOST"))
    if target == "Boolean":
        low = F.lower(t)
        value = F.when(low.isin(CONVERT_TRUE), "true").when(low.isin(CONVERT_FALSE), "false")
        return _result(value, F.when(c.isNotNull() & value.isNull(), "INVALID_BOOLEAN"))
    if target in ("DateTime", "DateOnly"):
        at = to_instant(c)
        shown = F.date_format(at, "yyyy-MM-dd" if target == "DateOnly" else "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return _result(shown, F.when(c.isNotNull() & at.isNull(), "INVALID_DATE"))
    if target == "Uniqueidentifier":
        return _result(F.lower(F.regexp_replace(t, r"[{}]", "")), F.when(~blank & ~t.rlike(GUID), "INVALID_GUID"))
    raise ValueError(target)


def same_provider(c: Column, target: str, precision: int = 2) -> Column:
    """(value, error_code) of a text within one provider: numbers are rounded halves up, blank numbers read as 0."""
    none = F.lit(None).cast("string")
    n = F.when(is_blank(c) & c.isNotNull(), F.lit(0.0)).otherwise(to_number(c))
    bad = F.when(c.isNotNull() & n.isNull(), "INVALID_NUMBER")
    if target in RANGES:
        return _result(round_half_up(n, 0).cast("bigint").cast("string"), bad)
    if target in ("Decimal", "Money", "Double"):
        return _result(plain_decimal(round_half_up(n, precision).cast("decimal(38,10)")), bad)
    if target == "Boolean":
        return _result(c, F.when(c.isNotNull() & ~c.isin("true", "false"), "INVALID_BOOLEAN"))
    if target == "DateOnly":
        return _result(F.substring(c, 1, 10), none)
    return _result(c, none)


def staged_value(c: Column, kind: str) -> Column:
    """The text of a staged cell as its column's type reads it; empty is null, and what doesn't fit stays as it is."""
    t = F.nullif(c, F.lit(""))
    n = to_number(t)
    if kind in RANGES:
        whole = F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("string")
        return F.coalesce(F.when(n.isNotNull(), whole), t)
    if kind in ("Decimal", "Double", "Money"):
        return F.coalesce(plain_decimal(n.try_cast("decimal(38,10)")), t)
    if kind == "Boolean":
        low = F.lower(t)
        return F.when(low.isin(INFER_TRUE), "true").when(low.isin(INFER_FALSE), "false").otherwise(t)
    return t


def driver_value(c: Column, kind: str, target: str | None = None) -> Column:
    """A stored value as all systems take it: ISO 8601 text, base64, plain text; a reference with the table it leads to."""
    if target is not None:
        return F.when(c.isNotNull(), F.struct(c.cast("string").alias("id"), F.lit(target).alias("table_name")))
    if kind == "DateOnly":
        return F.date_format(c, "yyyy-MM-dd")
    if kind == "DateTime":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if kind == "File":
        return F.base64(c)
    return c.cast("string")
