"""Ordered declarative transformations: each rule gives a value, an error or a loss, as columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import convert
from ..functions.equality import plain_decimal
from ..functions.text import GUID, GUID_BARE, RULE_FALSE, RULE_TRUE, is_blank, js_trim, left_trim, number_or_zero, right_trim, round_half_up

#: Input formats of dates: pattern (a prefix is enough) and the groups of year, month and day.
DATE_FORMATS = {
    "YYYY-MM-DD": (r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})", (1, 2, 3)),
    "DD/MM/YYYY": (r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})", (3, 2, 1)),
    "MM/DD/YYYY": (r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})", (3, 1, 2)),
    "DD-MM-YYYY": (r"^\s*(\d{1,2})-(\d{1,2})-(\d{4})", (3, 2, 1)),
    "DD.MM.YYYY": (r"^\s*(\d{1,2})\.(\d{1,2})\.(\d{4})", (3, 2, 1)),
    "YYYYMMDD": (r"^\s*(\d{4})(\d{2})(\d{2})", (1, 2, 3)),
    "YYYY/MM/DD": (r"^\s*(\d{4})/(\d{1,2})/(\d{1,2})", (1, 2, 3)),
}
AMBIGUOUS = r"^\s*\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\s*\z"



@dataclass(frozen=True)
class Step:
    """One rule: its kind and what it is told."""

    kind: str
    args: dict = field(default_factory=dict)


@dataclass
class Result:
    """A value so far, the code of the first error, and whether and why something was lost."""

    value: Column
    error: Column
    loss: Column


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def condition(c: Column, op: str, expected: str | None = None) -> Column:
    """One of the nine conditions. EQUALS trims and ignores case and takes null for ''; comparisons read null as 0."""
    folded = lambda x: F.lower(js_trim(F.coalesce(x, F.lit(""))))
    want = F.lit(expected).cast("string")
    number = number_or_zero(c)
    return {
        "EQUALS": lambda: folded(c) == folded(want),
        "NOT_EQUALS": lambda: folded(c) != folded(want),
        "CONTAINS": lambda: F.coalesce(F.lower(F.coalesce(c, F.lit(""))).contains(F.lower(F.coalesce(want, F.lit("")))), F.lit(False)),
        "STARTS_WITH": lambda: F.coalesce(F.lower(F.coalesce(c, F.lit(""))).startswith(F.lower(F.coalesce(want, F.lit("")))), F.lit(False)),
        "GREATER_THAN": lambda: F.coalesce(number > number_or_zero(want), F.lit(False)),
        "LESS_THAN": lambda: F.coalesce(number < number_or_zero(want), F.lit(False)),
        "IS_NULL": lambda: c.isNull(),
        "IS_NOT_NULL": lambda: c.isNotNull(),
        "IS_BLANK": lambda: is_blank(c),
    }[op]()


def _date(c: Column, a: dict, with_time: bool) -> tuple[Column, Column, Column]:
    fmt, t = a.get("format"), c
    if fmt:
        pattern, (y, m, d) = DATE_FORMATS[fmt]
        part = lambda i: F.regexp_extract(t, pattern, i).try_cast("int")
        day = F.when(t.rlike(pattern), F.concat_ws("-", F.lpad(part(y).cast("string"), 4, "0"), F.lpad(part(m).cast("string"), 2, "0"), F.lpad(part(d).cast("string"), 2, "0")).try_cast("date"))
        time = F.lit(None).cast("string")
    else:
        iso = r"^\s*(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2})?)(?:\.\d+)?Z?)?\s*\z"
        day = F.when(t.rlike(iso), F.regexp_extract(t, iso, 1).try_cast("date"))
        time = F.nullif(F.regexp_extract(t, iso, 2), F.lit(""))
    blank = is_blank(c)
    error = F.when(~blank & day.isNull(), "INVALID_DATE")
    if not with_time:
        return F.when(blank, None).otherwise(day.cast("string")), error, F.when(time.isNotNull() & ~time.rlike(r"^00:00(:00)?\z"), "TIME_DROPPED")
    full = F.concat(day.cast("string"), F.lit("T"), F.rpad(F.concat(F.coalesce(time, F.lit("00:00:00")), F.lit(":00")), 8, "0"), F.lit("Z"))
    return F.when(blank, None).otherwise(full), error, _null()


def _rule(c: Column, s: Step, source: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(value, error code, loss) of one rule on a text column."""
    a, ok = s.args, _null()
    blank = is_blank(c)
    number = number_or_zero(c)
    bad_number = F.when(c.isNotNull() & number.isNull(), "INVALID_NUMBER")
    mapped = lambda entries: F.coalesce(*[F.when(F.lower(js_trim(c)) == k.strip().lower(), F.lit(v)) for k, v in entries], _null()) if entries else _null()
    if s.kind == "IF_THEN":
        met = condition(source.get(a.get("column"), c), a["op"], a.get("expected"))
        if a["then"] == "SET_NULL":
            return F.when(~met, c), ok, ok
        if a["then"] == "SET_VALUE":
            return F.when(met, F.lit(a["value"])).otherwise(c), ok, ok
        inner = run(c, a["steps"], source)
        return F.when(met, inner.value).otherwise(c), F.when(met, inner.error), ok  # a loss inside isn't reported
    if s.kind == "CONCAT":
        parts = [F.lit(p["literal"]) if "literal" in p else source[p["column"]].cast("string") for p in a["parts"]]
        skip = a.get("skip_empty", True)
        joined = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), a.get("separator", "")) if skip else F.array_join(F.transform(F.array(*parts), lambda x: F.coalesce(x, F.lit(""))), a.get("separator", ""))
        return F.nullif(joined, F.lit("")), ok, ok
    if s.kind in ("VALUE_MAP", "CHOICE_MAP"):
        first = {}
        for k, v in a["entries"].items():
            first.setdefault(k.strip().lower(), v)
        entries = list(first.items())
        known = F.lower(js_trim(c)).isin(list(first)) if first else F.lit(False)
        policy = a.get("unmapped", "BLOCK")
        other = F.lit(a.get("default")) if policy == "DEFAULT" else _null()
        return F.when(known, mapped(entries)).otherwise(F.when(c.isNotNull(), other)), F.when(c.isNotNull() & ~known, "VALUE_MAP_MISSING") if policy == "BLOCK" else ok, ok
    if s.kind == "TO_BOOLEAN":
        t, own = F.lower(js_trim(c)), {k.strip().lower(): v for k, v in a.get("map", {}).items()}
        if any(not isinstance(v, bool) for v in own.values()):
            raise ValueError("a boolean map maps to booleans")
        yes = [*RULE_TRUE, *(k for k, v in own.items() if v)]
        no = [*RULE_FALSE, *(k for k, v in own.items() if not v)]
        value = F.when(t.isin([k for k, v in own.items() if v] or [""]) & (F.lit(bool(own)) & (t != "")), "true").when(t.isin([k for k, v in own.items() if not v] or [""]) & (t != ""), "false").when(t.isin(RULE_TRUE), "true").when(t.isin(RULE_FALSE), "false")
        return value, F.when(~blank & ~t.isin(yes + no), "VALUE_MAP_MISSING"), ok
    if s.kind in ("TO_DATE", "TO_DATETIME"):
        value, error, loss = _date(c, a, s.kind == "TO_DATETIME")
        if not a.get("format"):
            error = F.when(~blank & c.rlike(AMBIGUOUS), "AMBIGUOUS_DATE").otherwise(error)
        return F.when(error.isNull(), value), error, F.when(error.isNull(), loss)
    if s.kind == "TO_DECIMAL":
        scale = a.get("scale")
        rounded = number if scale is None else round_half_up(number, scale)
        return F.when(c.isNotNull() & bad_number.isNull(), plain_decimal(rounded.cast("decimal(38,10)"))), bad_number, F.when(rounded != number, "ROUNDED")
    if s.kind == "TO_INTEGER":
        whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
        return F.when(c.isNotNull(), whole.cast("string")), bad_number, F.when(whole != number, "FRACTION_DROPPED")
    if s.kind == "TO_GUID":
        t = F.lower(js_trim(c))
        bare = F.regexp_replace(t, r"[{}-]", "")
        whole = (t.rlike(GUID) & ~t.rlike(r"[{}]")) | t.rlike(GUID_BARE)
        hyphened = F.concat_ws("-", *[F.substring(bare, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
        return F.when(~blank & whole, hyphened), F.when(~blank & ~whole, "INVALID_GUID"), ok
    n = int(a.get("length") or 0)
    simple = {
        "TRIM": lambda: js_trim(c), "LEFT_TRIM": lambda: left_trim(c), "RIGHT_TRIM": lambda: right_trim(c),
        "UPPERCASE": lambda: F.upper(c), "LOWERCASE": lambda: F.lower(c),
        "REPLACE": lambda: F.replace(c, F.lit(a["find"]), F.lit(a.get("replace", ""))) if a["find"] else c,
        "PREFIX": lambda: F.concat(F.lit(a["text"]), c), "SUFFIX": lambda: F.concat(c, F.lit(a["text"])),
        "SUBSTRING": lambda: F.substring(c, max(0, int(a.get("start") or 0)) + 1, n if a.get("length") is not None else 1 << 30),
        "TRUNCATE": lambda: F.left(c, F.lit(n)) if n > 0 else c,
        "EMPTY_TO_NULL": lambda: F.when(~blank, c), "NULL_TO_EMPTY": lambda: F.coalesce(c, F.lit("")),
        "DEFAULT_IF_NULL": lambda: F.coalesce(c, F.lit(a["value"])), "DEFAULT_IF_BLANK": lambda: F.when(blank, F.lit(a["value"])).otherwise(c),
        "BLOCK_IF_NULL": lambda: c, "CONSTANT": lambda: F.lit(a["value"]), "TO_STRING": lambda: c,
    }
    if s.kind not in simple:
        raise ValueError(f"unknown rule {s.kind}")
    value = simple[s.kind]()
    error = F.when(c.isNull(), "REQUIRED_VALUE_MISSING") if s.kind == "BLOCK_IF_NULL" else ok
    loss = F.when(F.length(value) < F.length(c), "SHORTENED") if s.kind in ("SUBSTRING", "TRUNCATE") else ok
    return value, error, loss


def run(c: Column, steps: Sequence[Step], source: dict[str, Column]) -> Result:
    """Rules in order on one column; after an error the rest does nothing."""
    value, error, loss = c, _null(), _null()
    for s in steps:
        v, e, l = _rule(value, s, source)
        loss = F.when(error.isNull() & e.isNull(), F.coalesce(loss, l)).otherwise(loss)
        value = F.when(error.isNull(), v)
        error = F.coalesce(error, e)
    return Result(value, error, loss)


def apply(df: DataFrame, column: str, steps: Sequence[Step], into: str = "result") -> DataFrame:
    """``df`` with a struct column (value, error_code, lossy, loss, applied) of a pipeline on one column.

    ``applied`` counts the rules that changed the value. Projections are kept apart every
    few rules, so expressions stay small.
    """
    source = {c: F.col(f"`{c}`") for c in df.columns}
    out = df.withColumns({"_v": F.col(f"`{column}`").cast("string"), "_e": _null(), "_l": _null(), "_n": F.lit(0)})
    for s in steps:
        v, e, l = _rule(F.col("_v"), s, source)
        out = out.withColumns({"_nv": F.when(F.col("_e").isNull(), v), "_ne": F.coalesce(F.col("_e"), e), "_nl": F.when(F.col("_e").isNull() & e.isNull(), F.coalesce(F.col("_l"), l)).otherwise(F.col("_l"))})
        changed = F.col("_ne").isNull() & ~F.col("_nv").eqNullSafe(F.col("_v"))
        out = out.withColumns({"_n": F.col("_n") + changed.cast("int"), "_v": F.col("_nv"), "_e": F.col("_ne"), "_l": F.col("_nl")}).drop("_nv", "_ne", "_nl")
    result = F.struct(F.when(F.col("_e").isNull(), F.col("_v")).alias("value"), F.col("_e").alias("error_code"), F.col("_l").isNotNull().alias("lossy"), F.col("_l").alias("loss"), F.col("_n").alias("applied"))
    return out.withColumn(into, result).drop("_v", "_e", "_l", "_n")


def target_constraints(value: Column, max_length: int | None = None, required: bool = False) -> Column:
    """STRING_TOO_LONG or REQUIRED_VALUE_MISSING for what the target can't take, else null."""
    long = F.length(value) > max_length if max_length else F.lit(False)
    return F.when(F.coalesce(long, F.lit(False)), "STRING_TOO_LONG").when(is_blank(value) if required else F.lit(False), "REQUIRED_VALUE_MISSING")


# The code that a conversion's refusal is told as.
CONVERSION_CODES = {"STRING_TOO_LONG": "STRING_TOO_LONG", "INVALID_DATE": "INVALID_DATE", "INVALID_NUMBER": "INVALID_NUMBER"}


def convert_to_target(df: DataFrame, target: str, result: str = "result", cross: bool = True, max_length: int | None = None, scale: int | None = None) -> DataFrame:
    """``df``, whose ``result`` is from apply(), with its value converted to the target column's type after the rules.

    ``cross``: the target is another kind of system, whose types mean something else. A value
    that the type refuses becomes an error; one that already had an error keeps it.
    """
    r = lambda f: F.col(f"{result}.{f}")
    made = convert.cross_provider(r("value"), target, max_length, scale) if cross else convert.same_provider(r("value"), target, 2 if scale is None else scale)
    out = df.withColumn("_made", made)
    code = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in CONVERSION_CODES.items() for x in pair]), F.col("_made.error_code")), F.when(F.col("_made.error_code").isNotNull(), "TRANSFORMATION_FAILED"))
    error = F.coalesce(r("error_code"), code)
    return out.withColumn(result, F.struct(F.when(error.isNull(), F.col("_made.value")).alias("value"), error.alias("error_code"), r("lossy").alias("lossy"), r("loss").alias("loss"), r("applied").alias("applied"))).drop("_made")


# The columns of the three sheets that describe pipelines.
RULE_COLUMNS = ("source_table", "source_field", "step", "rule", "find", "replace_with", "value", "start", "length", "scale", "input_format", "separator", "skip_empty_parts", "on_unmapped", "default_value", "condition_field", "condition_operator", "condition_value", "action", "inside_step")
VALUE_COLUMNS = ("source_table", "source_field", "step", "from", "to")
PART_COLUMNS = ("source_table", "source_field", "step", "order", "field", "literal")
#: What each sheet column is called in a rule; ``value`` and ``text`` share one.
_NAMES = {"find": "find", "replace_with": "replace", "start": "start", "length": "length", "scale": "scale", "input_format": "format", "separator": "separator", "skip_empty_parts": "skip_empty", "on_unmapped": "unmapped", "default_value": "default", "condition_field": "column", "condition_operator": "op", "condition_value": "expected", "action": "then"}
_NUMBERS = ("start", "length", "scale")
_ENTRIES = {"VALUE_MAP": "entries", "CHOICE_MAP": "entries", "TO_BOOLEAN": "map"}


def to_sheets(pipelines: dict[tuple[str, str], Sequence[Step]]) -> tuple[list[dict], list[dict], list[dict]]:
    """Rows of the rules, value map and part sheets of pipelines by (table, field): a row for each rule, those inside another with its step."""
    rules, values, parts = [], [], []

    def put(table: str, name: str, steps: Sequence[Step], inside: str) -> None:
        for i, s in enumerate(steps, 1):
            step = f"{inside}.{i}" if inside else str(i)
            at = {"source_table": table, "source_field": name, "step": step}
            row = dict.fromkeys(RULE_COLUMNS) | at | {"rule": s.kind, "inside_step": inside or None}
            for column, arg in _NAMES.items():
                if s.args.get(arg) is not None:
                    row[column] = str(s.args[arg])
            row["value"] = s.args.get("value", s.args.get("text"))
            rules.append(row)
            values.extend(at | {"from": k, "to": str(v)} for k, v in s.args.get(_ENTRIES.get(s.kind, ""), {}).items())
            parts.extend(at | {"order": n, "field": p.get("column"), "literal": p.get("literal")} for n, p in enumerate(s.args.get("parts", ()), 1))
            put(table, name, s.args.get("steps", ()), step)

    for (table, name), steps in pipelines.items():
        put(table, name, steps, "")
        if not steps:
            rules.append(dict.fromkeys(RULE_COLUMNS) | {"source_table": table, "source_field": name, "rule": "NONE"})
    return rules, values, parts


def from_sheets(rules: Sequence[dict], values: Sequence[dict] = (), parts: Sequence[dict] = ()) -> dict[tuple[str, str], list[Step]]:
    """The pipelines that to_sheets() wrote; NONE stands for one without rules."""
    key = lambda r: (r["source_table"], r["source_field"])
    at = lambda rows, r: [x for x in rows if key(x) == key(r) and str(x["step"]) == str(r["step"])]
    order = lambda r: [int(n) for n in str(r["step"] or 0).split(".")]

    def build(own: list[dict], inside: str | None) -> list[Step]:
        out = []
        for r in sorted((r for r in own if (r.get("inside_step") or None) == inside and r["rule"] != "NONE"), key=order):
            kind, args = r["rule"], {}
            for column, arg in _NAMES.items():
                if r.get(column) is not None:
                    args[arg] = int(r[column]) if arg in _NUMBERS else str(r[column]).lower() == "true" if arg == "skip_empty" else r[column]
            if r.get("value") is not None:
                args["text" if kind in ("PREFIX", "SUFFIX") else "value"] = r["value"]
            if kind in _ENTRIES:
                args[_ENTRIES[kind]] = {x["from"]: x["to"].lower() == "true" if kind == "TO_BOOLEAN" else x["to"] for x in at(values, r)}
            if kind == "CONCAT":
                args["parts"] = [{"column": x["field"]} if x["field"] is not None else {"literal": x["literal"]} for x in sorted(at(parts, r), key=lambda x: int(x["order"]))]
            if kind == "IF_THEN" and args.get("then") == "APPLY":
                args["steps"] = build(own, str(r["step"]))
            out.append(Step(kind, args))
        return out

    return {k: build([r for r in rules if key(r) == k], None) for k in dict.fromkeys(map(key, rules))}


#: Pipelines that are offered ready made.
TEMPLATES: dict[str, list[Step]] = {
    "trim": [Step("TRIM")],
    "email": [Step("TRIM"), Step("LOWERCASE"), Step("EMPTY_TO_NULL")],
    "empty_to_null": [Step("TRIM"), Step("EMPTY_TO_NULL")],
    "yes_no": [Step("TO_BOOLEAN", {"map": {"y": True, "n": False}})],
    "active_inactive": [Step("TO_BOOLEAN", {"map": {"active": True, "inactive": False}})],
    "phone": [Step("TRIM"), Step("REPLACE", {"find": " "}), Step("REPLACE", {"find": "-"}), Step("REPLACE", {"find": "("}), Step("REPLACE", {"find": ")"}), Step("EMPTY_TO_NULL")],
}


def metrics(results: DataFrame, result: str = "result") -> DataFrame:
    """values, changed, lossy, nulls, failures of a transformed column."""
    r = lambda f: F.col(f"{result}.{f}")
    return results.agg(F.count("*").alias("rows"), F.count_if(r("applied") > 0).alias("changed"), F.count_if(r("lossy")).alias("lossy"), F.count_if(r("value").isNull() & r("error_code").isNull()).alias("nulls"), F.count_if(r("error_code").isNotNull()).alias("failures"))


def loss_impact(results: DataFrame, column: str, result: str = "result") -> DataFrame:
    """loss, records, longest: how many rows lose something, by kind, and their longest source text."""
    own = results.where(F.col(f"{result}.lossy"))
    return own.groupBy(F.col(f"{result}.loss").alias("loss")).agg(F.count("*").alias("records"), F.max(F.length(F.col(f"`{column}`").cast("string"))).alias("longest"))


def preview(df: DataFrame, column: str, steps: Sequence[Step], scanned: int = 500, shown: int = 25) -> DataFrame:
    """Distinct source values among the first rows, with what becomes of them: a bounded look, not a count."""
    few = df.select(F.col(f"`{column}`")).limit(scanned).dropDuplicates().orderBy(column).limit(shown)
    out = apply(few, column, steps)
    status = F.when(F.col("result.error_code").isNotNull(), "BLOCKED").when(F.col("result.lossy"), "WARNING").otherwise("OK")
    return out.select(F.col(column).alias("source"), F.col("result.value").alias("value"), status.alias("status"))
