"""Text, number, boolean and date readings of a column, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide what a value reads as. \z instead of
# $, which in Java also matches before a last line break.
SPACE = r"[\s\x{000b}\x{00a0}\x{feff}\p{Z}]"
NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
PLAIN_NUMBER = r"^-?\d+(\.\d+)?\z"
CURRENCY_SYMBOL = r"[$£€¥₹]"
CURRENCY_CODE = r"(?i)\b(USD|EUR|GBP|JPY|INR|AUD|CAD|CHF|CNY|SEK|NZD)\b"
MONEY_BODY = r"^-?\(?\s*(?:\d{1,3}(?:[,\s]\d{3})+|\d{1,3}(?:\.\d{3})+|\d+)(?:[.,]\d{1,4})?\s*\)?-?\z"
GROUPED = r"^-?\(?\s*(?:\d{1,3}(?:[,\s]\d{3})+|\d{1,3}(?:\.\d{3})+)(?:[.,]\d{1,4})?\s*\)?-?\z"
ISO_DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]|\z)"
SLASH_DATE_SHAPE = r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\z"
EMAIL_SHAPE = r"^[^\s@]+@[^\s@.]+\.[^\s@]{2,}\z"
EMAIL_RULE = r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}\z"
PHONE_RULE = r"^[+0-9][0-9\s().\-/]{4,}\z"
PHONE_SHAPE = r"^[+(]?\d[\d\s().-]{6,19}\z|^\(\d[\d\s().-]{6,19}\z"
PHONE_MARK = r"^\+|[\s()]"
URL_SHAPE = r"(?i)^(https?://|www\.)[^\s]+\z"
CURRENCY_SHAPE = r"^[-(]?\s*[$£€¥]\s?\d[\d,]*(\.\d{1,4})?\s*\)?\z"
PERCENT_SHAPE = r"^-?\d{1,3}(\.\d{1,4})?\s?%\z"
LEADING_ZERO = r"^-?0\d"
GUID = r"(?i)^\{?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\}?\z"
GUID_BARE = r"(?i)^[0-9a-f]{32}\z"
BOOLEAN_WORDS = ["true", "false", "yes", "no", "y", "n", "t", "f", "on", "off"]
PROFILE_BOOLEANS = ["true", "false", "0", "1", "yes", "no"]
RULE_TRUE, RULE_FALSE = ["true", "1", "y", "yes"], ["false", "0", "n", "no"]
CONVERT_TRUE, CONVERT_FALSE = ["true", "t", "yes", "y", "1"], ["false", "f", "no", "n", "0"]
INFER_TRUE, INFER_FALSE = ["true", "yes", "y", "1", "t"], ["false", "no", "n", "0", "f"]
INFER_BLANK = ["", "-", "n/a", "na", "null", "nil", "(blank)", "(null)", "#n/a"]


def js_trim(c: Column | str) -> Column:
    """Without white space of any script at either end, no-break spaces and byte-order marks included.

    Most texts begin and end with an ASCII mark, letter or digit, which is seen sooner than a pattern is tried.
    """
    c = F.col(c) if isinstance(c, str) else c
    plain = lambda x: F.ascii(x).between(33, 126)
    return F.when(plain(c) & plain(F.right(c, F.lit(1))), c).otherwise(F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", ""))


def left_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+", "")


def right_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+\z", "")


def is_blank(c: Column, trimmed: bool = False) -> Column:
    """Null, or nothing but white space. ``trimmed``, here and below: js_trim() has been at the column."""
    return c.isNull() | ((c if trimmed else js_trim(c)) == "")


def to_number(c: Column, trimmed: bool = False) -> Column:
    """The double that a text spells in decimal notation; null for anything else, blank text included."""
    t = c if trimmed else js_trim(c)
    return F.when(t.rlike(NUMERIC), t.try_cast("double"))


def number_or_zero(c: Column) -> Column:
    """As to_number(), but null and blank read as 0."""
    return F.when(is_blank(c), F.lit(0.0)).otherwise(to_number(c))


def to_instant(c: Column, trimmed: bool = False) -> Column:
    """Timestamp (UTC, without zone) of an ISO 8601 text, zone-less times taken as UTC; null for other text."""
    t = c if trimmed else js_trim(c)
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?\z")
    return F.when(iso, t.try_cast("timestamp")).cast("timestamp_ntz")


def round_half_up(c: Column, places: int) -> Column:
    """Rounds halves towards plus infinity."""
    m = 10**places
    return F.floor(c * F.lit(float(m)) + F.lit(0.5)) / F.lit(float(m))


def percent(part: Column, whole: Column) -> Column:
    """Of a whole, to one decimal, halves up; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(part * 1000.0 / F.greatest(whole, F.lit(1)) + 0.5) / 10.0)


# -- shapes of values

def looks_like_currency(c: Column) -> Column:
    marked = c.rlike(CURRENCY_SYMBOL) | c.rlike(CURRENCY_CODE)
    body = js_trim(F.regexp_replace(F.regexp_replace(c, CURRENCY_SYMBOL, ""), CURRENCY_CODE, ""))
    return (marked & body.rlike(MONEY_BODY)) | (~marked & c.rlike(GROUPED))


#: How every number, amount and date begins.
AMOUNT_OR_DATE = rf"(?i)^(?:[-(\d]|{CURRENCY_SYMBOL}|{CURRENCY_CODE.removeprefix('(?i)')})"


def shape_of(c: Column, trimmed: bool = False) -> Column:
    """BLANK, NUMBER, CURRENCY, BOOLEAN, DATE or TEXT; the first that fits, in this order.

    Texts that begin like none of the figures are told by one pattern.
    """
    t = c if trimmed else js_trim(c)
    boolean = F.lower(t).isin(BOOLEAN_WORDS)
    day = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1).try_cast("date").isNotNull()
    date = (t.rlike(ISO_DATE_SHAPE) & day) | t.rlike(SLASH_DATE_SHAPE)
    return (
        F.when(is_blank(t, True), "BLANK").when(~t.rlike(AMOUNT_OR_DATE), F.when(boolean, "BOOLEAN").otherwise("TEXT"))
        .when(t.rlike(PLAIN_NUMBER), "NUMBER").when(looks_like_currency(t), "CURRENCY").when(boolean, "BOOLEAN").when(date, "DATE").otherwise("TEXT")
    )


def currency_marker(c: Column) -> Column:
    """The symbol, else the code in upper case, else null."""
    symbol, code = F.regexp_extract(c, f"({CURRENCY_SYMBOL})", 1), F.upper(F.regexp_extract(c, CURRENCY_CODE, 1))
    return F.when(symbol != "", symbol).when(code != "", code)


def decimal_separator(c: Column) -> Column:
    """The mark before the decimals of a money text; null where it can't be told from a grouping mark."""
    body = F.regexp_replace(c, r"[^0-9.,]", "")
    last = F.regexp_extract(body, r"([.,])\d*\z", 1)
    both = body.contains(".") & body.contains(",")
    after = F.length(F.regexp_extract(body, r"[.,](\d*)\z", 1))
    once = F.length(F.regexp_replace(body, r"[^.,]", "")) == 1
    return F.when(last == "", None).when(both, last).when(once & (after != 3), last)


def decimal_places(c: Column, separator: Column | None = None) -> Column:
    """The digits after the decimal separator, which may be given."""
    mark = decimal_separator(c) if separator is None else separator
    return F.when(mark.isNotNull(), F.length(F.regexp_extract(F.regexp_replace(c, r"[^0-9.,]", ""), r"[.,](\d*)\z", 1))).otherwise(0)


def csv_cell(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula, quoted where RFC 4180 asks for it."""
    guarded = F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    quoted = F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(guarded.rlike(r'[",\r\n]'), quoted).otherwise(guarded), F.lit(""))


def excel_serial_to_date(c: Column) -> Column:
    """The date of a spreadsheet day number from 61 to 80000; null for others."""
    return excel_serial_to_instant(c).cast("date")


def excel_serial_to_instant(c: Column) -> Column:
    """The time (without zone) of a spreadsheet day number from 61 to 80000, its fraction to the nearest millisecond; null for others."""
    n = to_number(c)
    ms = F.floor(n * 86_400_000.0 + 0.5).cast("bigint")
    since = F.make_dt_interval(days=F.floor(ms / 86_400_000).cast("int"), secs=(F.pmod(ms, F.lit(86_400_000)) / 1000).cast("decimal(18,6)"))
    return F.when((n >= 61) & (n <= 80000), F.lit("1899-12-30").cast("timestamp_ntz") + since)


def is_boolean_word(c: Column) -> Column:
    """Whether a text spells yes or no, in any case."""
    return F.lower(js_trim(c)).isin(BOOLEAN_WORDS)


def display_value(c: Column, most: int = 256) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)
