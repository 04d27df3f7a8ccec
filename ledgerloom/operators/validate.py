"""After a load: is everything there, is it equal, do references hold, do totals agree."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.equality import classify_difference
from ..plans.metadata import Table, schema_diff
from .relate import broken_references
from .transform import Step, run

#: Worst last.
OUTCOMES = ("PASS", "WARNING", "INCOMPLETE", "FAIL")
RECORD_OUTCOMES = ("CREATED", "UPDATED", "UNCHANGED", "SKIPPED", "FAILED", "UNRESOLVED")


def worst(outcome: Column) -> Column:
    """The worst outcome of a group: an aggregate."""
    ranks = F.array(*map(F.lit, OUTCOMES))
    return F.element_at(ranks, F.max(F.array_position(ranks, outcome)).cast("int"))


def record_differences(source: DataFrame, target: DataFrame, mapping: DataFrame, source_id: str, target_id: str, fields: Sequence[tuple[str, str, int | None]]) -> DataFrame:
    """source_id, field, type: MISSING_IN_TARGET, or how a field (source, target, max length) differs."""
    s = source.select(F.col(f"`{source_id}`").alias("source_id"), *[F.col(f"`{a}`").cast("string").alias(f"s{i}") for i, (a, _, _) in enumerate(fields)])
    t = target.select(F.col(f"`{target_id}`").alias("target_id"), F.lit(True).alias("there"), *[F.col(f"`{b}`").cast("string").alias(f"t{i}") for i, (_, b, _) in enumerate(fields)])
    both = s.join(mapping.select("source_id", "target_id"), "source_id", "left").join(t, "target_id", "left")
    made = [F.struct(F.lit(b).alias("field"), F.when(F.col("there"), classify_difference(F.col(f"s{i}"), F.col(f"t{i}"), n)).alias("type")) for i, (_, b, n) in enumerate(fields)]
    gone = F.struct(F.lit(None).cast("string").alias("field"), F.when(F.col("there").isNull(), "MISSING_IN_TARGET").alias("type"))
    return both.select("source_id", F.inline(F.array(gone, *made))).where("type is not null")


def compare_records(source: DataFrame, target: DataFrame, mapping: DataFrame, source_id: str, target_id: str, fields: Sequence[tuple[str, str, int | None]], steps: dict[str, Sequence[Step]] | None = None, references: dict[str, DataFrame] | None = None) -> DataFrame:
    """source_id, field, type, outcome of every difference, and of every field that can't be compared.

    The source is transformed first. A rule that refuses a value makes it NOT_COMPARABLE, which is
    never a difference. A reference is compared with the target id that ``references`` (source_id,
    target_id) expects; without one it isn't compared. Records that the run left as they were
    (outcome SKIPPED in ``mapping``) differ as PRE_EXISTING_DIFFERENCE, a warning.
    """
    steps, references = steps or {}, references or {}
    columns = {c: F.col(f"`{c}`") for c in source.columns}
    made = [run(columns[a].cast("string"), steps.get(a, ()), columns) for a, _, _ in fields]
    s = source.select(F.col(f"`{source_id}`").alias("source_id"), *[x for i, r in enumerate(made) for x in (r.value.alias(f"s{i}"), r.error.alias(f"e{i}"))])
    for i, (a, _, _) in enumerate(fields):
        if a in references:
            m = references[a].select(F.col("source_id").cast("string").alias("_m"), F.col("target_id").cast("string").alias("_mt"))
            s = s.join(m, F.col(f"s{i}") == F.col("_m"), "left").withColumn(f"e{i}", F.when(F.col(f"s{i}").isNotNull() & F.col("_mt").isNull(), "NO_MAPPING")).withColumn(f"s{i}", F.col("_mt")).drop("_m", "_mt")
    t = target.select(F.col(f"`{target_id}`").alias("target_id"), F.lit(True).alias("there"), *[F.col(f"`{b}`").cast("string").alias(f"t{i}") for i, (_, b, _) in enumerate(fields)])
    outcome = F.col("outcome") if "outcome" in mapping.columns else F.lit("CREATED").alias("outcome")
    both = s.join(mapping.select("source_id", "target_id", outcome), "source_id", "left").join(t, "target_id", "left")
    old = F.coalesce(F.col("outcome") == "SKIPPED", F.lit(False))

    def told(i: int, a: str, b: str, most: int | None) -> Column:
        if a in references:
            kind = F.when(~F.lower(f"s{i}").eqNullSafe(F.lower(f"t{i}")), "LOOKUP_MISMATCH")
        else:
            kind = classify_difference(F.col(f"s{i}"), F.col(f"t{i}"), most)
        kind = F.when(old & kind.isNotNull(), "PRE_EXISTING_DIFFERENCE").otherwise(kind)
        unknown = F.lit(None).cast("string") if a in references else F.lit("NOT_COMPARABLE")
        return F.struct(F.lit(b).alias("field"), F.when(F.col("there"), F.when(F.col(f"e{i}").isNotNull(), unknown).otherwise(kind)).alias("type"))

    gone = F.struct(F.lit(None).cast("string").alias("field"), F.when(F.col("there").isNull(), "MISSING_IN_TARGET").alias("type"))
    out = both.select("source_id", F.inline(F.array(gone, *[told(i, *f) for i, f in enumerate(fields)]))).where("type is not null")
    return out.withColumn("outcome", F.when(F.col("type") == "NOT_COMPARABLE", "INCOMPLETE").when(F.col("type") == "PRE_EXISTING_DIFFERENCE", "WARNING").otherwise("FAIL"))


def pairing(source: DataFrame, target: DataFrame, mapping: DataFrame, source_id: str, target_id: str) -> DataFrame:
    """source_id, target_id, in_target: each source row with the target row its mapping leads to."""
    s = source.select(F.col(f"`{source_id}`").alias("source_id"))
    t = target.select(F.col(f"`{target_id}`").alias("_t"))
    out = s.join(mapping.select("source_id", "target_id"), "source_id", "left").join(t, F.col("target_id") == F.col("_t"), "left")
    return out.select("source_id", "target_id", F.col("_t").isNotNull().alias("in_target"))


def duplicate_attribution(groups: DataFrame, key: Sequence[str], ids: str, mapping: DataFrame, samples: int = 5) -> DataFrame:
    """The key, attributable: whether a run wrote one of a duplicate group's sampled rows; null if it didn't and not all were sampled.

    ``groups`` has an array of row ids and a count for each group; ``mapping`` the run's target ids.
    """
    long = groups.select(*key, "count", F.explode(F.slice(F.array_sort(ids), 1, samples)).alias("_id"))
    own = mapping.select(F.col("target_id").cast("string").alias("_id"), F.lit(True).alias("_own")).distinct()
    out = long.join(own, "_id", "left").groupBy(*key).agg(F.coalesce(F.bool_or("_own"), F.lit(False)).alias("hit"), F.count("*").alias("seen"), F.max("count").alias("n"))
    return out.select(*key, F.when(F.col("hit"), True).when(F.col("seen") < F.col("n"), None).otherwise(False).alias("attributable"))


def aggregate_pushdown(df: DataFrame, columns: Sequence[str], scale: int = 2) -> DataFrame:
    """column_name, count, total, lowest, highest: exact decimals, as text, in one pass."""
    d = lambda c: F.col(f"`{c}`").cast(f"decimal(18,{scale})")
    wide = df.agg(*[F.struct(F.lit(c).alias("column_name"), F.count(d(c)).alias("count"), F.sum(d(c)).cast("string").alias("total"), F.min(d(c)).cast("string").alias("lowest"), F.max(d(c)).cast("string").alias("highest")).alias(f"a{i}") for i, c in enumerate(columns)])
    return wide.select(F.inline(F.array(*[F.col(f"a{i}") for i in range(len(columns))])))


def aggregates_agree(source: DataFrame, target: DataFrame, columns: Sequence[tuple[str, str]], scale: int = 2) -> DataFrame:
    """column_name, measure, source_value, target_value, outcome; nothing on both sides is NOT_VERIFIED."""
    s = aggregate_pushdown(source, [a for a, _ in columns], scale)
    names = F.create_map(*[F.lit(x) for a, b in columns for x in (a, b)])
    t = aggregate_pushdown(target, [b for _, b in columns], scale).select(F.col("column_name").alias("_t"), *[F.col(c).alias(f"t_{c}") for c in ("count", "total", "lowest", "highest")])
    both = s.join(t, F.element_at(names, F.col("column_name")) == F.col("_t"))
    rows = F.array(*[F.struct(F.lit(m.upper()).alias("measure"), F.col(m).cast("string").alias("source_value"), F.col(f"t_{m}").cast("string").alias("target_value")) for m in ("count", "total", "lowest", "highest")])
    out = both.select("column_name", F.inline(rows))
    outcome = F.when(F.col("source_value").isNull() & F.col("target_value").isNull(), "NOT_VERIFIED").when(F.col("source_value").eqNullSafe(F.col("target_value")), "PASS").otherwise("FAIL")
    return out.withColumn("outcome", outcome)


def validate(source: DataFrame, target: DataFrame, mapping: DataFrame, source_id: str, target_id: str, fields: Sequence[tuple[str, str, int | None]], references: Sequence[tuple[str, DataFrame, str]] = (), unique: Sequence[str] = (), totals: Sequence[tuple[str, str]] = (), schemas: tuple[Table, Table] | None = None) -> DataFrame:
    """check_name, outcome, affected: SCHEMA, ROW_COUNT, RECORD_EXISTENCE, FIELD_VALUES, REFERENCES, UNIQUENESS, AGGREGATES.

    A check that nothing was asked of isn't PASS but left out.
    """
    found = record_differences(source, target, mapping, source_id, target_id, fields)
    kinds = found.agg(F.count_if(F.col("type") == "MISSING_IN_TARGET").alias("gone"), F.count_if(F.col("type") != "MISSING_IN_TARGET").alias("wrong"))
    n = source.agg(F.count("*").alias("s")).join(F.broadcast(target.agg(F.count("*").alias("t"))))  # one row each
    check = lambda name, outcome, affected: F.struct(F.lit(name).alias("check_name"), outcome.alias("outcome"), affected.cast("long").alias("affected"))
    rows = F.when(F.col("s") == F.col("t"), "PASS").when(F.col("t") > F.col("s"), "WARNING").otherwise("FAIL")
    fail = lambda c: F.when(c > 0, "FAIL").otherwise("PASS")
    parts = [n.select(check("ROW_COUNT", rows, F.abs(F.col("s") - F.col("t"))).alias("c"))]
    parts += [kinds.select(F.explode(F.array(check("RECORD_EXISTENCE", fail(F.col("gone")), F.col("gone")), check("FIELD_VALUES", fail(F.col("wrong")), F.col("wrong")))).alias("c"))]
    if references:
        broken = None
        for column, parent, key in references:
            own = broken_references(target, column, parent, key).agg(F.count("*").alias("n"))
            broken = own if broken is None else broken.unionAll(own)
        parts.append(broken.agg(F.sum("n").alias("n")).select(check("REFERENCES", fail(F.col("n")), F.col("n")).alias("c")))
    if unique:
        complete = target.where(" and ".join(f"`{k}` is not null" for k in unique))
        parts.append(complete.groupBy(*[F.col(f"`{k}`") for k in unique]).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n")).select(check("UNIQUENESS", F.when(F.col("n") > 0, "WARNING").otherwise("PASS"), F.col("n")).alias("c")))
    if totals:
        parts.append(aggregates_agree(source, target, totals).agg(F.count_if(F.col("outcome") == "FAIL").alias("n")).select(check("AGGREGATES", fail(F.col("n")), F.col("n")).alias("c")))
    if schemas:
        rows = schema_diff([schemas[0]], [replace(schemas[1], name=schemas[0].name)])
        breaking, other = sum(r["breaking"] for r in rows), sum(r["status"] != "MATCH" for r in rows)
        parts.append(source.sparkSession.range(1).select(check("SCHEMA", F.lit("FAIL" if breaking else "WARNING" if other else "PASS"), F.lit(other)).alias("c")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select("c.*")


def outcome_counts(results: DataFrame) -> DataFrame:
    """table_name and the number of records by outcome, with what they add up to."""
    out = results.groupBy("table_name").agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in RECORD_OUTCOMES])
    c = F.col
    return out.withColumn("written", c("created") + c("updated")).withColumn("accounted", sum((c(o.lower()) for o in RECORD_OUTCOMES[1:]), c("created"))).withColumn("expected_in_target", c("accounted") - c("failed") - c("unresolved"))


def coverage_percent(examined: Column, eligible: Column) -> Column:
    """Of what could be examined, to one decimal; never 0 for some or 100 for not all."""
    p = F.floor(examined * 1000.0 / F.greatest(eligible, F.lit(1)) + 0.5) / 10.0
    return F.when(eligible == 0, 100.0).when((examined > 0) & (p == 0), 0.1).when((examined < eligible) & (p >= 100), 99.9).otherwise(p)


MODES = ("FULL", "SAMPLED", "NOT_VERIFIED")


def coverage_mode(examined: Column, eligible: Column) -> Column:
    """FULL, SAMPLED or NOT_VERIFIED, from the counts alone; nothing to examine is FULL."""
    return F.when((eligible == 0) | (examined >= eligible), "FULL").when(examined == 0, "NOT_VERIFIED").otherwise("SAMPLED")


def combined_coverage(parts: DataFrame) -> DataFrame:
    """mode, eligible, examined, percent of (mode, eligible, examined) rows together: the weakest mode, and sums."""
    ranks = F.array(*map(F.lit, MODES))
    out = parts.agg(F.max(F.array_position(ranks, F.col("mode"))).cast("int").alias("_m"), F.coalesce(F.sum("eligible"), F.lit(0)).alias("eligible"), F.coalesce(F.sum("examined"), F.lit(0)).alias("examined"))
    return out.select(F.coalesce(F.try_element_at(ranks, F.col("_m")), F.lit("FULL")).alias("mode"), "eligible", "examined", coverage_percent(F.col("examined"), F.col("eligible")).alias("percent"))
