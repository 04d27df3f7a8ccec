"""One equality for comparison, validation and change detection."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import CONVERT_FALSE, CONVERT_TRUE, js_trim, right_trim, round_half_up, to_instant, to_number

#: Texts beyond these limits aren't compared as JSON.
JSON_CHARS, JSON_DEPTH, JSON_NODES = 1_000_000, 64, 50_000


def normalize(c: Column, family: str, places: int = 10) -> Column:
    """The text that stands for a value in comparisons; equal values have equal texts.

    text: line breaks as LF, no white space at the end, '' as null. number: rounded to
    ``places``, no trailing zeros. boolean: true or false, '' as false. datetime: to the
    second in UTC. date: ten characters. guid: lower case, no braces. multiselect: sorted.
    """
    if family == "text":
        t = right_trim(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
        return F.when(t == "", None).otherwise(t)
    if family == "number":
        return plain_decimal(round_half_up(to_number(c.cast("string")), places).cast(f"decimal(38,{places})"))
    if family == "boolean":
        t = F.lower(js_trim(c.cast("string")))
        return F.when(t.isin(CONVERT_TRUE), "true").when(t.isin([*CONVERT_FALSE, ""]), "false").otherwise(t)
    if family == "datetime":
        at = to_instant(c.cast("string"))
        return F.when(at.isNull(), c.cast("string")).otherwise(F.date_format(F.date_trunc("second", at), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    if family == "date":
        return F.substring(c.cast("string"), 1, 10)
    if family == "guid":
        return F.lower(F.regexp_replace(c, r"[{}]", ""))
    if family == "multiselect":
        return F.array_join(F.transform(F.array_sort(F.transform(F.split(c, ","), lambda x: js_trim(x).try_cast("int"))), lambda x: x.cast("string")), ",")
    raise ValueError(family)


def plain_decimal(c: Column) -> Column:
    """A decimal as text without trailing zeros."""
    t = c.cast("string")
    t = F.when(t.contains("."), F.regexp_replace(F.regexp_replace(t, r"0+\z", ""), r"\.\z", "")).otherwise(t)
    return F.when(t.isin("-0", ""), "0").otherwise(t)


def decimals_equal(a: Column, b: Column, scale: int) -> Column:
    """Equal at a scale, halves rounded away from zero; two nulls are equal."""
    at = lambda c: F.round(c.cast("string").try_cast("decimal(38,18)"), scale)
    return at(a).eqNullSafe(at(b))


def values_equal(a: Column, b: Column, family: str, places: int | None = None) -> Column:
    if family == "number":
        x, y = to_number(a.cast("string")), to_number(b.cast("string"))
        close = F.abs(x - y) <= (0.5 * 10.0**-places if places is not None else 1e-9)
        return F.when(x.isNull() | y.isNull(), normalize(a, "text").eqNullSafe(normalize(b, "text"))).otherwise(close)
    return normalize(a, family).eqNullSafe(normalize(b, family))


def classify_difference(source: Column, target: Column, max_length: int | None) -> Column:
    """VALUE_LOST, VALUE_TRUNCATED, VALUE_MISMATCH, or null for equal values."""
    s, t = normalize(source, "text"), normalize(target, "text")
    cut = s.startswith(t) & (F.length(t) == max_length) & (F.length(s) > F.length(t)) if max_length else F.lit(False)
    return F.when(s.eqNullSafe(t), None).when(s.isNotNull() & t.isNull(), "VALUE_LOST").when(cut, "VALUE_TRUNCATED").otherwise("VALUE_MISMATCH")


#: Characters of base64 beyond which binaries aren't compared: 8 MiB.
MOST_BASE64 = -(-8 * 1024 * 1024 // 3) * 4


def binary_equal(a: Column, b: Column) -> Column:
    """Byte equality of texts that are hexadecimal (\\x...) or base64; null where either has more than 8 MiB."""
    raw = lambda c: F.when(c.startswith("\\x"), F.unhex(F.substring(c, 3, 1 << 30))).otherwise(F.try_to_binary(c, F.lit("base64")))
    large = lambda c: F.coalesce(F.length(c) > F.when(c.startswith("\\x"), 2 + 2 * 8 * 1024 * 1024).otherwise(MOST_BASE64), F.lit(False))
    return F.when(~(large(a) | large(b)), raw(a).eqNullSafe(raw(b)))


class _Refused(Exception):
    pass


def _pairs(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise _Refused("duplicate key")
    return out


def _canonical(text: str) -> str:
    """Sorted keys, exact numbers; refuses duplicate keys and what is beyond the limits."""
    value = json.loads(text, object_pairs_hook=_pairs, parse_int=Decimal, parse_float=Decimal)
    left, nodes = [(value, 1)], 0
    while left:
        v, depth = left.pop()
        nodes += 1
        if depth > JSON_DEPTH or nodes > JSON_NODES:
            raise _Refused("limits")
        if isinstance(v, (dict, list)):
            left += [(x, depth + 1) for x in (v.values() if isinstance(v, dict) else v)]
    number = lambda d: {"\0number": format(d.normalize(), "f")}  # noqa: E731  no text is mistaken for it
    return json.dumps(value, sort_keys=True, default=number, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def _json_verdict(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str, y: str) -> str:
        try:
            return "EQUAL" if _canonical(x) == _canonical(y) else "DIFFERENT"
        except (_Refused, RecursionError):
            return "NOT_COMPARABLE"
        except ValueError:
            return "DIFFERENT"

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)])


#: Built-in parsing decides texts up to this long and nested; longer numbers or exponents it may round.
_PLAIN_CHARS, _PLAIN_NESTED, _ROUNDED = 50_000, JSON_DEPTH, r"\d{16}|\d[eE]|-0"


def compare_json(a: Column, b: Column) -> Column:
    """EQUAL, DIFFERENT or NOT_COMPARABLE; Python looks only at texts within the limits that built-in parsing doesn't find equal."""
    long = (F.length(a) > JSON_CHARS) | (F.length(b) > JSON_CHARS)
    plain = lambda c: (F.length(c) <= _PLAIN_CHARS) & (F.regexp_count(c, F.lit(r"[\[{]")) <= _PLAIN_NESTED) & ~c.rlike(_ROUNDED)
    sorted_keys = lambda c: F.when(plain(c), F.to_json(F.try_parse_json(c)))  # noqa: E731  null where a key repeats
    same = F.coalesce(sorted_keys(a) == sorted_keys(b), F.lit(False))
    known = F.when(a.eqNullSafe(b), "EQUAL").when(a.isNull() | b.isNull(), "DIFFERENT").when(long, "NOT_COMPARABLE").when(same, "EQUAL")
    ask = lambda c: F.when(known.isNull(), c)  # noqa: E731  Spark calls it for all rows, so the others are null there
    return F.coalesce(known, _json_verdict(ask(a), ask(b)))
