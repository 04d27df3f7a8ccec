"""Findings over profiles and apparent meanings, and how ready the data is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Names that say what a column is for.
KEY_LIKE_NAME = r"(?i)(^|[^a-z])(id|key|code|no|num|number|ref|reference|sku|guid|uuid|account|barcode|isbn|ean)([^a-z]|\z)"
BARE_KEY_NAME = r"(?i)^(id|code|ref|reference|key|number|no|uuid|guid|pk)\z"
PII_NAME = r"(?i)(^|[^a-z])(email|e_mail|phone|mobile|telephone|ssn|nino|national_?insurance|passport|dob|date_?of_?birth|address|postcode|post_?code|zip|salary|iban|sort_?code|account_?number|credit_?card|card_?number)([^a-z]|\z)"
#: Meanings that no key has.
NEVER_A_KEY = ("CURRENCY", "PERCENTAGE", "PHONE", "EMAIL", "URL", "EXCEL_SERIAL_DATE")
#: From what share a column is often empty, almost unique, or of mixed kinds; how much longer than usual, and how long, an outlying text is.
OFTEN_EMPTY, NEARLY_UNIQUE, MIXED_PERCENT, LONG_FACTOR, LONG = 0.25, 0.98, 5, 8, 40

SEVERITIES = ("CRITICAL", "WARNING", "INFO")
COST = {"CRITICAL": 35, "WARNING": 10, "INFO": 2}
#: The rules in the order they are told, with what they are about.
CATEGORIES = {
    "NO_RELIABLE_KEY": "IDENTITY", "CANDIDATE_KEY": "IDENTITY", "KEY_MISSING_VALUES": "IDENTITY", "DUPLICATE_BUSINESS_KEY": "IDENTITY",
    "MONEY_AS_TEXT": "TYPE_COMPATIBILITY", "MIXED_VALUE_TYPES": "TYPE_COMPATIBILITY", "INCONSISTENT_BOOLEAN": "CONSISTENCY", "NUMERIC_PRECISION": "TYPE_COMPATIBILITY",
    "DUPLICATE_KEYS": "DUPLICATES", "NEARLY_UNIQUE_DUPLICATES": "DUPLICATES", "EMPTY_COLUMN": "COMPLETENESS", "HIGH_NULL_RATE": "COMPLETENESS",
    "INVALID_DATES": "VALIDITY", "INVALID_VALUES": "VALIDITY", "WHITESPACE": "CONSISTENCY", "LENGTH_SPREAD": "CONSISTENCY",
    "DATE_AS_NUMBER": "TYPE_COMPATIBILITY", "INVALID_EMAIL": "VALIDITY", "PHONE_FORMAT": "CONSISTENCY", "CATEGORICAL_VALUES": "TYPE_COMPATIBILITY",
    "IDENTIFIER_AS_TEXT": "TYPE_COMPATIBILITY", "CURRENCY_AS_TEXT": "TYPE_COMPATIBILITY", "PERCENTAGE_AS_TEXT": "TYPE_COMPATIBILITY", "POSSIBLE_PII": "PRIVACY",
}
#: Good news, or a decision to take: no score falls for these.
FREE = ("CANDIDATE_KEY", "CATEGORICAL_VALUES", "IDENTIFIER_AS_TEXT", "POSSIBLE_PII")
DIMENSIONS = ("IDENTITY", "COMPLETENESS", "CONSISTENCY", "VALIDITY", "TYPE_COMPATIBILITY", "RELATIONSHIPS")


def _could_identify(semantic: Column) -> Column:
    named = F.col("field").rlike(KEY_LIKE_NAME) | F.coalesce(semantic == "IDENTIFIER", F.lit(False))
    return named & ~F.col("field").startswith("__") & ~F.coalesce(semantic.isin(*NEVER_A_KEY), F.lit(False))


def _is_candidate(semantic: Column) -> Column:
    c = F.col
    return (c("examined") > 0) & F.coalesce(c("distinct_count") == c("examined"), F.lit(False)) & (c("null_count") + c("blank_count") == 0) & _could_identify(semantic)


def _own_name(field: Column, table: Column) -> Column:
    """Whether a key-like column is named after its own table, or only as a key: others refer to some other table."""
    flat = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    name, one = flat(field), F.regexp_replace(F.regexp_replace(flat(table), r"ies\z", "y\u0001"), r"s\z|\x01\z", "")
    return name.rlike(BARE_KEY_NAME) | name.contains(one) | one.contains(name)


def findings(profile: DataFrame, readings: DataFrame | None = None, key_columns: Sequence[str] = (), required: Sequence[str] = ()) -> DataFrame:
    """table_name, field, rule, severity, category, affected, root_cause, deducts: what profiles say is wrong or worth knowing.

    ``profile`` holds profile() rows of any number of tables; ``readings`` semantic_types()
    rows, with a table_name if there are several tables. ``key_columns`` are the tables'
    primary keys. A finding about a table has no field. All is as small as the tables' columns.
    """
    c = F.col
    if readings is None:
        p = profile.withColumn("semantic", F.lit(None).cast("string")).withColumn("bad_values", F.lit(0)).withColumn("bad_records", F.lit(0).cast("long"))
    else:
        p = profile.join(readings.select(*[k for k in ("table_name", "field") if k in readings.columns], "semantic", "bad_values", "bad_records"), [k for k in ("table_name", "field") if k in readings.columns], "left")
    table = Window.partitionBy("table_name")  # a row for each column of a table
    p = p.withColumn("candidate", _is_candidate(c("semantic"))).withColumn("keyless", ~F.max("candidate").over(table) & (F.max("examined").over(table) > 0))
    empty = c("null_count") + c("blank_count")
    shapes = {s: F.coalesce(c(f"{s}_shapes"), F.lit(0)) for s in ("number", "currency", "boolean", "date", "text")}
    populated = sum(list(shapes.values())[1:], shapes["number"])
    told = [shapes[s] for s in ("number", "currency", "date", "text")]
    most = F.greatest(*told)
    kinds = sum((F.when(s > 0, 1).otherwise(0) for s in told[1:]), F.when(told[0] > 0, 1).otherwise(0))
    only_money = (shapes["currency"] > 0) & (shapes["date"] == 0) & (shapes["text"] == 0)
    is_key = c("field").isin(list(key_columns)) if key_columns else F.lit(False)
    needed = c("field").isin(list(required)) if required else F.lit(False)
    reads = lambda s: c("semantic") == s
    critical_if = lambda cond: F.when(cond, "CRITICAL").otherwise("WARNING")
    warning, info, critical, none = F.lit("WARNING"), F.lit("INFO"), F.lit("CRITICAL"), F.lit(0)
    per_mille = F.floor((populated - most) * 1000.0 / F.greatest(populated, F.lit(1)) + 0.5)
    rules: dict[str, tuple[Column, Column, Column]] = {
        "CANDIDATE_KEY": (c("candidate"), info, none),
        "KEY_MISSING_VALUES": (is_key & (empty > 0), critical, empty),
        "DUPLICATE_BUSINESS_KEY": (_could_identify(c("semantic")) & (c("duplicate_groups") > 0) & _own_name(c("field"), c("table_name")), critical_if(c("keyless")), c("rows_in_collision")),
        "MONEY_AS_TEXT": (shapes["currency"] > 0, critical_if(c("decimal_marks") > 1), shapes["currency"]),
        "MIXED_VALUE_TYPES": (~only_money & (kinds > 1) & (populated > most) & (per_mille >= 10 * MIXED_PERCENT), warning, populated - most),
        "INCONSISTENT_BOOLEAN": (c("boolean_spellings") > 2, warning, shapes["boolean"]),
        "NUMERIC_PRECISION": ((c("over_two_decimals") > 0) & (c("max_decimals") > 2), info, c("over_two_decimals")),
        "DUPLICATE_KEYS": (is_key & (c("duplicate_count") > 0), critical, c("duplicate_count")),
        "NEARLY_UNIQUE_DUPLICATES": (~is_key & (c("duplicate_count") > 0) & (c("distinct_count") >= NEARLY_UNIQUE * c("examined")) & (c("distinct_count") != c("examined")), warning, c("duplicate_count")),
        "EMPTY_COLUMN": ((c("examined") > 0) & (empty >= c("examined")), warning, c("examined")),
        "HIGH_NULL_RATE": ((empty < c("examined")) & (empty >= OFTEN_EMPTY * c("examined")) & (c("examined") > 0), critical_if(needed), empty),
        "INVALID_DATES": (c("invalid_date_count") > 0, critical, c("invalid_date_count")),
        "INVALID_VALUES": (c("invalid_count") > 0, warning, c("invalid_count")),
        "WHITESPACE": (c("whitespace_count") > 0, warning, c("whitespace_count")),
        "LENGTH_SPREAD": ((c("max_length") >= LONG) & (c("avg_length") > 0) & (c("max_length") >= LONG_FACTOR * c("avg_length")), info, none),
        "DATE_AS_NUMBER": (reads("EXCEL_SERIAL_DATE"), warning, c("examined")),
        "INVALID_EMAIL": (reads("EMAIL") & (c("bad_values") > 0), warning, c("bad_records")),
        "PHONE_FORMAT": (reads("PHONE"), info, c("examined")),
        "CATEGORICAL_VALUES": (reads("CATEGORICAL"), info, none),
        "IDENTIFIER_AS_TEXT": (reads("IDENTIFIER"), info, none),
        "CURRENCY_AS_TEXT": (reads("CURRENCY") & (shapes["currency"] == 0), warning, c("examined")),
        "PERCENTAGE_AS_TEXT": (reads("PERCENTAGE"), warning, c("examined")),
    }
    cause = lambda r: F.when(c("keyless"), F.concat(F.lit("IDENTITY:"), c("table_name"))) if r == "DUPLICATE_BUSINESS_KEY" else F.lit(None).cast("string")
    made = [F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(r).alias("rule"), severity.alias("severity"), n.cast("long").alias("affected"), cause(r).alias("root_cause"))) for r, (hit, severity, n) in rules.items()]
    by_field = p.select("table_name", "field", F.inline(F.array_compact(F.array(*made))))
    personal = c("field").rlike(PII_NAME) | F.coalesce(reads("EMAIL"), F.lit(False))
    tables = p.groupBy("table_name").agg(F.bool_or("keyless").alias("keyless"), F.max("examined").alias("examined"), F.bool_or(personal).alias("personal"))
    whole = [
        F.when(c("keyless"), F.struct(F.lit("NO_RELIABLE_KEY").alias("rule"), critical.alias("severity"), c("examined").cast("long").alias("affected"), F.concat(F.lit("IDENTITY:"), c("table_name")).alias("root_cause"))),
        F.when(c("personal"), F.struct(F.lit("POSSIBLE_PII").alias("rule"), info.alias("severity"), F.lit(0).cast("long").alias("affected"), F.lit(None).cast("string").alias("root_cause"))),
    ]
    by_table = tables.select("table_name", F.lit(None).cast("string").alias("field"), F.inline(F.array_compact(F.array(*whole))))
    category = F.element_at(F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair]), c("rule"))
    out = by_table.unionByName(by_field).select("table_name", "field", "rule", "severity", category.alias("category"), "affected", "root_cause", (~c("rule").isin(*FREE)).alias("deducts"))
    return sort_findings(out)


def sort_findings(found: DataFrame) -> DataFrame:
    """Worst first, then in the order of the rules, then by table and field."""
    place = lambda names, column: F.array_position(F.array(*map(F.lit, names)), F.col(column))
    return found.orderBy(place(SEVERITIES, "severity"), place(CATEGORIES, "rule"), "table_name", "field")


def filter_findings(found: DataFrame, table: str | None = None, rule: str | None = None, severity: str | None = None, after: tuple[str, str, str] | None = None, most: int = 1000) -> DataFrame:
    """A page of findings in the order of (table_name, rule, field), from behind the ``after`` row; 1,000 at most."""
    for column, value in (("table_name", table), ("rule", rule), ("severity", severity)):
        if value is not None:
            found = found.where(F.col(column) == value)
    at = F.struct("table_name", "rule", F.coalesce("field", F.lit("")).alias("field"))
    if after is not None:
        found = found.where(at > F.struct(*map(F.lit, after)))
    return found.orderBy("table_name", "rule", F.coalesce("field", F.lit(""))).limit(max(1, min(1000, most)))


def candidate_keys(profile: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """table_name, field: unique, never blank, named or reading like a key."""
    return findings(profile, readings).where("rule = 'CANDIDATE_KEY'").select("table_name", "field")


def near_misses(profile: DataFrame, most: int = 3) -> DataFrame:
    """table_name, field, rank: the columns most distinct of those named like keys, or of all if none is."""
    share = F.col("distinct_count") / F.col("examined")
    own = profile.where(~F.col("field").startswith("__") & (F.col("examined") > 0) & F.col("distinct_count").isNotNull()).withColumn("_key", _could_identify(F.lit(None).cast("string")).cast("int"))
    own = own.withColumn("_any", F.max("_key").over(Window.partitionBy("table_name"))).where("_key = _any")
    rank = F.row_number().over(Window.partitionBy("table_name").orderBy(share.desc(), "field"))
    return own.withColumn("rank", rank).where(F.col("rank") <= most).select("table_name", "field", "rank")


def _folded(found: DataFrame, *by: str) -> DataFrame:
    """Findings that deduct, those of one root cause as the worst of them."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("int")
    own = found.where("deducts").withColumn("_cause", F.coalesce("root_cause", F.concat_ws("|", "rule", "table_name", F.coalesce("field", F.lit("")))))
    return own.groupBy(*by, "_cause").agg(F.min(rank).alias("_rank")).select(*by, F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("_rank")).alias("severity"))


def _dimension(found: DataFrame) -> DataFrame:
    return found.withColumn("dimension", F.when(F.col("category") == "DUPLICATES", "IDENTITY").when(F.col("category").isin(*DIMENSIONS), F.col("category")))


def readiness(found: DataFrame, relationships: bool = False) -> DataFrame:
    """dimension, score, criticals, warnings, infos of every dimension: 100 less 35, 10 or 2 for each defect, not below 0.

    One defect deducts once, however many findings tell of it. Relationships have no score
    unless they were looked at.
    """
    n = lambda s: F.count_if(F.col("severity") == s)
    counts = _folded(_dimension(found).where("dimension is not null"), "dimension").groupBy("dimension").agg(n("CRITICAL").alias("criticals"), n("WARNING").alias("warnings"), n("INFO").alias("infos"))
    every = found.sparkSession.createDataFrame([(d, d != "RELATIONSHIPS" or relationships) for d in DIMENSIONS], "dimension string, assessed boolean")
    out = every.join(counts, "dimension", "left").fillna(0, ["criticals", "warnings", "infos"])
    score = F.greatest(F.lit(0), F.lit(100) - sum((F.col(f"{s.lower()}s") * v for s, v in COST.items()), F.lit(0)))
    return out.select("dimension", F.when(F.col("assessed"), score.cast("long")).alias("score"), "criticals", "warnings", "infos")


def band(found: DataFrame, relationships: bool = False) -> DataFrame:
    """score, band: the mean of the assessed dimensions, and READY, NEEDS_ATTENTION or HIGH_RISK."""
    score = readiness(found, relationships).agg(F.floor(F.avg("score") + 0.5).cast("long").alias("score"))
    out = score.join(F.broadcast(_folded(found).agg(F.count_if(F.col("severity") == "CRITICAL").alias("_n"))))  # one row each
    c = F.col
    return out.select("score", F.when((c("_n") >= 3) | (c("score") < 50), "HIGH_RISK").when((c("_n") > 0) | (c("score") < 80), "NEEDS_ATTENTION").otherwise("READY").alias("band"))


def verdict(found: DataFrame, overrides: DataFrame) -> DataFrame:
    """verdict, blockers, warnings, information, overridden of what stands before a load.

    ``found`` has code, object, severity (BLOCKER, WARNING, INFORMATION) and overridable;
    ``overrides`` code and object, each for one finding of one object. BLOCKED: something
    that nobody may override; BLOCKED_PENDING_OVERRIDE: somebody has to decide.
    """
    o = overrides.select(F.col("code").alias("_c"), F.coalesce("object", F.lit("")).alias("_o")).distinct()
    own = found.join(o, (F.col("code") == F.col("_c")) & (F.coalesce("object", F.lit("")) == F.col("_o")), "left")
    is_a = lambda s: F.col("severity") == s
    left = is_a("BLOCKER") & F.col("_c").isNull()
    out = own.agg(F.count_if(left & ~F.col("overridable")).alias("_hard"), F.count_if(left).alias("_left"), F.count_if(is_a("BLOCKER")).alias("blockers"), F.count_if(is_a("WARNING")).alias("warnings"), F.count_if(is_a("INFORMATION")).alias("information"))
    c = F.col
    which = F.when(c("_hard") > 0, "BLOCKED").when(c("_left") > 0, "BLOCKED_PENDING_OVERRIDE").when(c("warnings") > 0, "READY_WITH_WARNINGS").otherwise("READY")
    return out.select(which.alias("verdict"), "blockers", "warnings", "information", (c("blockers") - c("_left")).alias("overridden"))
