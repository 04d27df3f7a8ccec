"""Column types and apparent meanings, from every value of text columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    CURRENCY_SHAPE, EMAIL_SHAPE, GUID, INFER_BLANK, INFER_FALSE, INFER_TRUE, LEADING_ZERO, PERCENT_SHAPE, PHONE_MARK, PHONE_SHAPE, URL_SHAPE, js_trim,
)
from ..session import spread

# Names and spellings that decide what a column is.
KEY_LIKE = re.compile(r"^(id|key|code|number|no|ref|reference)$|(_|\b)(id|key|code|guid|uuid|number|no|ref|reference)$", re.I)
NAME_LIKE = re.compile(r"name$|^name|title|description|label|subject", re.I)
DATE_NAME = re.compile(r"(^|[^a-z])(date|dob|birthday|created|modified|updated|start|end|due|expiry|expires|effective|closed|opened|received|shipped|invoiced|paid)([^a-z]|$)", re.I)
PERSON_NAME = re.compile(r"(^|[^a-z])(first_?name|last_?name|sur_?name|fore_?name|given_?name|middle_?name|full_?name|contact_?name)([^a-z]|$)", re.I)
INTEGER, DECIMAL = r"^-?\d{1,25}\z", r"^-?\d{1,15}(\.\d{1,10})?\z"
DATE_ONLY, DATE_TIME = r"^\d{4}-\d{2}-\d{2}\z", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?\z"
#: Whole numbers beyond this aren't safe in a double and stay text.
SAFE_INTEGER = 9007199254740991
INT_MAX = 2147483647
STRING_LENGTH, MEMO_FROM = 255, 4000


def _facts() -> list[Column]:
    """What the distinct values ``v`` of a column, each held by ``n`` rows, say; a null is a blank."""
    v, low = F.col("v"), F.lower("v")
    every = lambda cond: F.coalesce(F.bool_and(cond), F.lit(False))
    some = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    day = F.substring(v, 1, 10).try_cast("date").isNotNull()
    return [
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(v.isNotNull(), F.col("n"))), F.lit(0)).alias("held"),
        F.count(v).alias("distinct"),
        F.max(F.length(v)).alias("longest"),
        every(low.isin(INFER_TRUE + INFER_FALSE)).alias("boolean"),
        some(low.isin("true", "false", "yes", "no", "y", "n", "t", "f")).alias("wordy"),
        every(v.rlike(GUID)).alias("guid"),
        some(v.rlike(LEADING_ZERO) & v.rlike(INTEGER)).alias("zeros"),
        every(v.rlike(INTEGER)).alias("integer"),
        every(v.rlike(DECIMAL)).alias("decimal"),
        every(v.rlike(DATE_ONLY) & day).alias("date"),
        every((v.rlike(DATE_TIME) | v.rlike(DATE_ONLY)) & day).alias("datetime"),
        F.max(F.abs(v.try_cast("decimal(26,0)"))).alias("largest"),
    ]


def _texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as texts, spread so that a task counts a share of their values, however many rows one task reads."""
    return spread(df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in dict.fromkeys(columns)]))


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """field, type, rows, held, distinct_values, longest: a row for each column, from all rows in one pass.

    The first that every value that isn't blank fits: none String; spelled Boolean; GUID; digits
    with a leading zero text; Integer or BigInt (text beyond what a double holds exactly);
    Decimal; Date; DateTime; else String or, beyond 4000 characters, Memo. Equal values are
    counted before the shuffle and looked at once.
    """
    names = list(columns or df.columns)
    t = lambda n: js_trim(F.col(f"`{n}`"))
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.when(~F.lower(t(n)).isin(INFER_BLANK), t(n)).alias("v")) for n in names]))
    counts = _texts(df, names).select(cells.alias("c")).select("c.*").groupBy("field", "v").agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, field string")
    f = every.join(counts.groupBy("field").agg(*_facts()), "field", "left").fillna(0, ["rows", "held", "distinct"])
    text = F.when(F.col("longest") > MEMO_FROM, "Memo").otherwise("String")
    kind = (
        F.when(F.col("held") == 0, "String").when(F.col("boolean") & F.col("wordy"), "Boolean").when(F.col("guid"), "Uniqueidentifier").when(F.col("zeros"), text)
        .when(F.col("integer"), F.when(F.col("largest") > SAFE_INTEGER, text).when(F.col("largest") > INT_MAX, "BigInt").otherwise("Integer"))
        .when(F.col("decimal"), "Decimal").when(F.col("date"), "Date").when(F.col("datetime"), "DateTime").otherwise(text)
    )
    return f.orderBy("place").select("field", kind.alias("type"), "rows", "held", F.col("distinct").alias("distinct_values"), "longest")


def infer_key(types: Sequence[dict]) -> str | None:
    """The key column from rows of infer_types(): unique, never blank and named like one; else a unique GUID; else none."""
    whole = [t for t in types if t["rows"] and t["rows"] == t["held"] == t["distinct_values"]]
    return next((t["field"] for t in whole if KEY_LIKE.search(t["field"])), next((t["field"] for t in whole if t["type"] == "Uniqueidentifier"), None))


def infer_name_column(types: Sequence[dict]) -> str | None:
    text = [t["field"] for t in types if t["type"] == "String"]
    return next((n for n in text if NAME_LIKE.search(n)), text[0] if text else None)


def unique_headers(headers: Sequence[str | None]) -> list[str]:
    """Headers without control characters and outer space; blank ones numbered, repeated ones suffixed."""
    out: list[str] = []
    for i, h in enumerate(headers, 1):
        name = re.sub(r"[\x00-\x1f`]+", " ", h or "").strip() or f"column_{i}"
        n, base = 2, name
        while name.lower() in {o.lower() for o in out}:
            name, n = f"{base} {n}", n + 1
        out.append(name)
    return out


def semantic_types(df: DataFrame, columns: Sequence[str], most_distinct: int | None = None) -> DataFrame:
    """field, semantic, confidence, share, bad_values, bad_records: what the values of text columns appear to be.

    EMPTY; spreadsheet dates (all 15000 to 80000); EMAIL, URL, CURRENCY, PERCENTAGE, PHONE and
    IDENTIFIER (leading zeros) from four fifths of distinct values; CATEGORICAL; else null. The
    last two count the distinct values of an EMAIL column that are none, and their records.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), js_trim(F.col(f"`{c}`")).alias("v")) for c in columns]))
    long = _texts(df, columns).select(cells.alias("c")).select("c.*")
    counts = long.where("v is not null and v <> ''").groupBy("field", "v").agg(F.count("*").alias("n"))
    v = F.col("v")
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    serial = v.rlike(r"^\d{4,5}(\.\d+)?\z") & (v.try_cast("double") >= 15000) & (v.try_cast("double") <= 80000)
    stats = counts.groupBy("field").agg(
        F.sum("n").alias("held"), F.count("*").alias("distinct"), share(serial).alias("serial"), share(v.rlike(EMAIL_SHAPE)).alias("email"),
        share(v.rlike(URL_SHAPE)).alias("url"), share(v.rlike(CURRENCY_SHAPE)).alias("currency"), share(v.rlike(PERCENT_SHAPE)).alias("percentage"),
        share(v.rlike(PHONE_SHAPE) & v.rlike(PHONE_MARK)).alias("phone"), share(v.rlike(LEADING_ZERO)).alias("zeros"),
        F.count_if(~v.rlike(EMAIL_SHAPE)).alias("no_email"), F.coalesce(F.sum(F.when(~v.rlike(EMAIL_SHAPE), F.col("n"))), F.lit(0)).alias("no_email_records"),
    )
    names = df.sparkSession.createDataFrame([(c, bool(DATE_NAME.search(c)), bool(PERSON_NAME.search(c))) for c in columns], "field string, dated boolean, person boolean")
    f = names.join(stats, "field", "left")
    c = F.col
    kinds = [("EMAIL", "email"), ("URL", "url"), ("CURRENCY", "currency"), ("PERCENTAGE", "percentage"), ("PHONE", "phone")]
    semantic = F.when(c("held").isNull(), "EMPTY").when(c("serial") == 1, "EXCEL_SERIAL_DATE")
    confidence = F.when(c("held").isNull(), "HIGH").when(c("serial") == 1, F.when(c("dated"), "HIGH").otherwise("MEDIUM"))
    own = F.when(c("held").isNull(), 1.0).when(c("serial") == 1, c("serial"))
    for name, column in kinds:
        semantic, own = semantic.when(c(column) >= 0.8, name), own.when(c(column) >= 0.8, c(column))
        confidence = confidence.when(c(column) >= 0.8, F.when((c(column) >= 0.98) & F.lit(name != "PHONE"), "HIGH").otherwise("MEDIUM"))
    few = (c("distinct") >= 2) & (c("distinct") <= 25) & (c("held") >= 50) & (c("distinct") / c("held") < 0.05) & ~c("person")
    semantic = semantic.when(c("zeros") >= 0.8, "IDENTIFIER").when(few, "CATEGORICAL")
    confidence = confidence.when(c("zeros") >= 0.8, "HIGH").when(few, "HIGH")
    own = own.when(c("zeros") >= 0.8, c("zeros")).when(few, 1.0)
    out = f.select("field", semantic.alias("semantic"), confidence.alias("confidence"), F.round(own, 6).alias("share"), "no_email", "no_email_records")
    bad = lambda column: F.when(c("semantic") == "EMAIL", c(column)).otherwise(0)
    return out.select("field", "semantic", "confidence", "share", bad("no_email").alias("bad_values"), bad("no_email_records").alias("bad_records"))
