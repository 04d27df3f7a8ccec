"""Declarative data-quality rules: a count of violations for each, in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EMAIL_RULE, PHONE_RULE, is_blank, js_trim, to_instant, to_number

#: Rule kind to the code of its issue.
CODES = {
    "REQUIRED": "REQUIRED_VALUE_MISSING", "NOT_BLANK": "BLANK_VALUE", "MAX_LENGTH": "STRING_TOO_LONG", "MIN_LENGTH": "STRING_TOO_SHORT",
    "VALID_EMAIL": "INVALID_EMAIL", "VALID_PHONE": "INVALID_PHONE", "NUMERIC_RANGE": "VALUE_OUT_OF_RANGE", "DATE_RANGE": "DATE_OUT_OF_RANGE",
    "ALLOWED_VALUES": "VALUE_NOT_ALLOWED", "REGEX_PATTERN": "PATTERN_MISMATCH", "UNIQUE": "DUPLICATE_KEY",
}
SEVERITIES = ("INFO", "WARNING", "BLOCKER")
LONGEST_PATTERN = 200


@dataclass(frozen=True)
class Rule:
    kind: str
    column: str
    severity: str = "WARNING"
    minimum: float | str | None = None
    maximum: float | str | None = None
    values: Sequence[str] = field(default_factory=tuple)
    pattern: str = ""

    def __post_init__(self) -> None:
        if self.kind not in CODES or self.severity not in SEVERITIES:
            raise ValueError(f"unknown rule {self.kind} or severity {self.severity}")
        if len(self.pattern) > LONGEST_PATTERN:
            raise ValueError("the pattern is too long")


def violated(rule: Rule) -> Column:
    """True where a row breaks the rule; what can't be read as a number or date breaks no range."""
    c = F.col(f"`{rule.column}`").cast("string")
    t, blank = js_trim(c), is_blank(c)
    lo, hi = rule.minimum, rule.maximum
    outside = lambda v, cast: F.coalesce((v < cast(lo) if lo is not None else F.lit(False)) | (v > cast(hi) if hi is not None else F.lit(False)), F.lit(False))
    return {
        "REQUIRED": lambda: blank,
        "NOT_BLANK": lambda: c.isNotNull() & blank,
        "MAX_LENGTH": lambda: c.isNotNull() & (F.length(c) > int(hi)),
        "MIN_LENGTH": lambda: ~blank & (F.length(c) < int(lo)),
        "VALID_EMAIL": lambda: ~blank & ~t.rlike(EMAIL_RULE),
        "VALID_PHONE": lambda: ~blank & ~t.rlike(PHONE_RULE),
        "NUMERIC_RANGE": lambda: outside(to_number(c), lambda x: F.lit(float(x))),
        "DATE_RANGE": lambda: outside(to_instant(c), lambda x: F.lit(x).cast("timestamp_ntz")),
        "ALLOWED_VALUES": lambda: ~blank & ~t.isin(list(rule.values)),
        "REGEX_PATTERN": lambda: ~blank & ~c.rlike(rule.pattern),
    }[rule.kind]()


def evaluate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule, column_name, code, severity, affected: a row for each rule.

    Rules on rows share one pass; UNIQUE counts values beyond the first of each.
    """
    on_rows = [r for r in rules if r.kind != "UNIQUE"]
    parts = []
    about = lambda i, r, n: F.struct(F.lit(i).alias("rule"), F.lit(r.column).alias("column_name"), F.lit(CODES[r.kind]).alias("code"), F.lit(r.severity).alias("severity"), n.alias("affected"))
    if on_rows:
        wide = df.agg(*[F.count_if(F.coalesce(violated(r), F.lit(False))).alias(f"n{i}") for i, r in enumerate(on_rows)])
        parts.append(wide.select(F.inline(F.array(*[about(rules.index(r), r, F.col(f"n{i}")) for i, r in enumerate(on_rows)]))))
    for r in rules:
        if r.kind == "UNIQUE":
            counts = df.where(F.col(f"`{r.column}`").isNotNull()).groupBy(F.col(f"`{r.column}`").alias("value")).agg(F.count("*").alias("n"))
            parts.append(counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.inline(F.array(about(rules.index(r), r, F.col("n"))))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def violations(df: DataFrame, rule: Rule, row_id: str, most: int = 5) -> DataFrame:
    """row_id, value: a few rows that break a rule, the least ids first."""
    own = df.where(F.coalesce(violated(rule), F.lit(False)))
    return own.select(F.col(f"`{row_id}`").alias("row_id"), F.col(f"`{rule.column}`").cast("string").alias("value")).orderBy("row_id").limit(most)


def summary(issues: DataFrame) -> DataFrame:
    """code, affected, severity: all rows of a code together, at the worst severity."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    worst = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.max(rank).cast("int"))
    return issues.where("affected > 0").groupBy("code").agg(F.sum("affected").alias("affected"), worst.alias("severity"))


def derive(columns: Sequence[dict]) -> list[Rule]:
    """Rules that a target's column facts imply: required, max_length, minimum and maximum, format."""
    out = []
    for c in columns:
        name = c["name"]
        if c.get("required"):
            out.append(Rule("REQUIRED", name, "BLOCKER"))
        if c.get("max_length"):
            out.append(Rule("MAX_LENGTH", name, "BLOCKER", maximum=c["max_length"]))
        if c.get("minimum") is not None or c.get("maximum") is not None:
            out.append(Rule("NUMERIC_RANGE", name, "BLOCKER", minimum=c.get("minimum"), maximum=c.get("maximum")))
        if c.get("format") == "Email":
            out.append(Rule("VALID_EMAIL", name, "WARNING"))
    return out
