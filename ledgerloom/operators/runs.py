"""What a run left behind: failures by category, what may be tried again, what still has to be done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .match import spread_join

# Failure code, category, and whether trying again is safe without a correction.
CATEGORIES = {
    "REQUIRED_VALUE_MISSING": ("DATA", "CORRECTION_REQUIRED"), "INVALID_NUMBER": ("DATA", "CORRECTION_REQUIRED"), "INVALID_DATE": ("DATA", "CORRECTION_REQUIRED"),
    "INVALID_GUID": ("DATA", "CORRECTION_REQUIRED"), "STRING_TOO_LONG": ("DATA", "CORRECTION_REQUIRED"), "VALUE_MAP_MISSING": ("MAPPING", "CORRECTION_REQUIRED"),
    "MAPPING_INVALID": ("MAPPING", "CORRECTION_REQUIRED"), "LOOKUP_UNRESOLVED": ("REFERENCE", "CORRECTION_REQUIRED"), "PRINCIPAL_UNRESOLVED": ("REFERENCE", "CORRECTION_REQUIRED"),
    "DUPLICATE_SOURCE_KEY": ("IDENTITY", "CORRECTION_REQUIRED"), "AMBIGUOUS_TARGET_MATCH": ("IDENTITY", "CORRECTION_REQUIRED"), "ALREADY_EXISTS": ("IDENTITY", "CORRECTION_REQUIRED"),
    "THROTTLED": ("TARGET", "SAFE_TO_RETRY"), "TIMEOUT": ("TARGET", "RECONCILE_FIRST"), "FORBIDDEN": ("TARGET", "RETRY_BLOCKED"),
}


def failure_categories(failures: DataFrame, code: str = "error_code") -> DataFrame:
    """category, retry, records of failures; codes that aren't listed are UNKNOWN and have to be reconciled first."""
    category = F.create_map(*[F.lit(x) for k, (c, _) in CATEGORIES.items() for x in (k, c)])
    retry = F.create_map(*[F.lit(x) for k, (_, r) in CATEGORIES.items() for x in (k, r)])
    own = F.col(code)
    out = failures.where(own.isNotNull()).select(F.coalesce(F.try_element_at(category, own), F.lit("UNKNOWN")).alias("category"), F.coalesce(F.try_element_at(retry, own), F.lit("RECONCILE_FIRST")).alias("retry"))
    return out.groupBy("category", "retry").agg(F.count("*").alias("records"))


def deferred_counts(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(status), F.lit("NONE")).alias("deferred_status")).agg(F.count("*").alias("records"))


def attempt_metrics(records: DataFrame, problems: DataFrame) -> DataFrame:
    """attempt, the number of records by outcome, first_at, last_at and problem_records of each attempt of a run.

    ``records`` (attempt, outcome, updated_at) counts what each attempt settled;
    ``problems`` (attempt, source_id) may name a record more than once.
    """
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o.lower())
    done = records.groupBy("attempt").agg(*map(n, ("CREATED", "UPDATED", "UNCHANGED", "SKIPPED", "FAILED", "UNRESOLVED")), F.min("updated_at").alias("first_at"), F.max("updated_at").alias("last_at"))
    bad = problems.groupBy(F.col("attempt").alias("_a")).agg(F.count_distinct("source_id").alias("problem_records"))
    both = done.join(bad, F.col("attempt").eqNullSafe(F.col("_a")), "full")
    counts = [c for c in done.columns if c not in ("attempt", "first_at", "last_at")]
    return both.select(F.coalesce("attempt", "_a").alias("attempt"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "first_at", "last_at", "problem_records")


def identity_impact(unresolved: DataFrame, principal: str, record: str, field: str) -> DataFrame:
    """principal, records, fields: what depends on each user that wasn't found."""
    return unresolved.groupBy(F.col(principal).alias("principal")).agg(F.count_distinct(record).alias("records"), F.count_distinct(field).alias("fields"))


def cap_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """The first rows of each group: a stored list is capped, its counts are taken before."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def recover_writes(intents: DataFrame, target: DataFrame, intent_key: str, target_key: str) -> DataFrame:
    """source_id, finding, next: what became of writes whose outcome isn't known.

    Updates are repeated. A create is looked for by its evidence: one hit was written,
    none is ABSENT and may be repeated, several are for a person to decide.
    """
    hits = target.groupBy(F.col(f"`{target_key}`").alias("_k")).agg(F.count("*").alias("_n")).where("_k is not null")
    out = spread_join(intents.withColumn("_k", F.col(f"`{intent_key}`")), hits, "_k")
    n, create = F.coalesce("_n", F.lit(0)), F.col("operation") == "CREATE"
    finding = F.when(F.col("_k").isNull(), "UNCLEAR").when(n == 0, "ABSENT").when(n == 1, "PRESENT").otherwise("MULTIPLE")
    action = F.when(~create, "RETRY").when(finding == "PRESENT", "CONFIRM").when(finding == "ABSENT", "RETRY").otherwise("PERSON")
    return out.select("source_id", finding.alias("finding"), action.alias("next"))


#: Kinds of evidence that a write left, the surest first.
EVIDENCE = ("PRESERVED_ID", "ALTERNATE_KEY", "BUSINESS_KEY", "RECORDED_TARGET_ID")


def recover_by_evidence(intents: DataFrame, target: DataFrame, target_id: str, by: dict[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """source_id, evidence, finding, target_id, next for writes whose outcome isn't known, by the first evidence that each has.

    ``by`` names, for each kind of EVIDENCE, the column of ``intents`` with an array of key parts (null
    where a write left none, or with a null part) and the columns of ``target`` that they are looked
    for in, as text without regard to case. Each kind is one join of the writes that no surer kind
    could speak for: a row that one kind finds absent isn't looked for again by a weaker one.

    One hit is CONFIRMED, none may be written again (RETRY), several or no evidence are for a PERSON.
    Updates are repeated: they change one known row to the same values.
    """
    fold = lambda parts: F.when(F.forall(parts, lambda x: x.isNotNull() & (F.trim(x.cast("string")) != "")), F.transform(parts, lambda x: F.lower(F.trim(x.cast("string")))))
    left = intents.withColumn("_update", F.col("operation") == "UPDATE")
    done = left.where("_update").select("source_id", F.lit(None).cast("string").alias("evidence"), F.lit("NOT_LOOKED_FOR").alias("finding"), F.lit(None).cast("string").alias("target_id"), F.lit("RETRY").alias("next"))
    left = left.where("not _update")
    for kind in [k for k in EVIDENCE if k in by]:
        column, keys = by[kind]
        own = left.withColumn("_k", fold(F.col(f"`{column}`")))
        parts = fold(F.array(*[F.col(f"`{k}`").cast("string") for k in keys]))
        hits = target.select(parts.alias("_k"), F.col(f"`{target_id}`").cast("string").alias("_t")).where("_k is not null").groupBy("_k").agg(F.count("*").alias("_n"), F.min("_t").alias("_t"))
        met = own.where("_k is not null").join(hits, "_k", "left")
        n = F.coalesce("_n", F.lit(0))
        finding = F.when(n == 0, "ABSENT").when(n == 1, "PRESENT").otherwise("MULTIPLE")
        action = F.when(n == 0, "RETRY").when(n == 1, "CONFIRM").otherwise("PERSON")
        done = done.unionByName(met.select("source_id", F.lit(kind).alias("evidence"), finding.alias("finding"), F.when(n == 1, F.col("_t")).alias("target_id"), action.alias("next")))
        left = own.where("_k is null").drop("_k")
    none = left.select("source_id", F.lit(None).cast("string").alias("evidence"), F.lit("NO_EVIDENCE").alias("finding"), F.lit(None).cast("string").alias("target_id"), F.lit("PERSON").alias("next"))
    return done.unionByName(none)


def remediation(**issues: DataFrame) -> DataFrame:
    """All issues as one list: origin, and table_name, record_id, field, code, severity, detail where they have them."""
    names = ("table_name", "record_id", "field", "code", "severity", "detail")
    out = None
    for origin, df in issues.items():
        own = df.select(F.lit(origin).alias("origin"), *[(F.col(n).cast("string") if n in df.columns else F.lit(None).cast("string")).alias(n) for n in names])
        out = own if out is None else out.unionAll(own)
    return out
