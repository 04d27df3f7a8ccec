"""A load as a Spark job in three passes, with an identity map to resume from.

Pass 1 loads tables parents first, pass 2 fills the references that a cycle had left open, and pass 3
sets what the target's writes would have overwritten: who made and changed a record, and when.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators.match import by_key, by_primary_id, preflight, spread_join
from ..operators.transform import Step, run
from . import write
from .metadata import load_order

MAP_SCHEMA = "run_id string, table_name string, source_id string, target_id string, outcome string, updated_at timestamp, error_code string"
GOOD = ("CREATED", "UPDATED", "UNCHANGED")
ISSUE = "array<struct<severity:string,code:string,field:string>>"


@dataclass(frozen=True)
class Entity:
    """One table of a load: how its columns map, what they go through, and what they refer to."""

    name: str
    source_id: str
    target_id: str
    fields: Sequence[tuple[str, str]]  # (source, target), references included
    steps: dict[str, Sequence[Step]] = field(default_factory=dict)  # by source column
    references: dict[str, str] = field(default_factory=dict)  # source column -> entity
    match: str = "PRIMARY_ID"
    key: Sequence[tuple[str, str]] = ()
    required: Sequence[str] = ()
    lenient: Sequence[str] = ()  # references that may lead nowhere
    strategy: str = "UPSERT"
    generated: bool = False  # the target makes its own keys; else a new row keeps its source id
    people: dict[str, str] = field(default_factory=dict)  # source column with a user -> target column
    stamps: Sequence[tuple[str, str]] = ()  # (source, target) columns that only pass 3 writes


def ordered(entities: Sequence[Entity]) -> tuple[list[Entity], list[tuple[str, str]]]:
    order = load_order([e.name for e in entities], [(e.name, p, c not in e.required) for e in entities for c, p in e.references.items()])
    by_name = {e.name: e for e in entities}
    return [by_name[n] for n in order.tables], order.deferred


def mapped(identity_map: DataFrame, table: str) -> DataFrame:
    """source_id, target_id: the newest good mapping of each source row of a table."""
    own = identity_map.where((F.col("table_name") == table) & F.col("outcome").isin(*GOOD) & F.col("source_id").isNotNull())
    newest = F.max(F.struct("updated_at", "run_id", "target_id")).alias("newest")
    return own.groupBy("source_id").agg(newest).select("source_id", F.col("newest.target_id").alias("target_id"))


def snapshot(identity_map: DataFrame) -> DataFrame:
    """The newest entry of each row of each table: a map that has grown by many runs, with one entry a row again.

    A good entry stands before a failed one, however old, as the row is in the target.
    """
    good = F.col("outcome").isin(*GOOD)
    others = [c for c in identity_map.columns if c not in ("table_name", "source_id")]
    newest = F.max(F.struct(good.alias("_good"), F.col("updated_at").alias("_at"), F.col("run_id").alias("_run"), F.struct(*others).alias("entry"))).alias("newest")
    out = identity_map.where("source_id is not null").groupBy("table_name", "source_id").agg(newest)
    return out.select("table_name", "source_id", "newest.entry.*").select(*identity_map.columns)


def _issue(when: Column, severity: str, code: Column | str, column: str) -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    return F.when(when, F.struct(F.lit(severity).alias("severity"), code.alias("code"), F.lit(column).alias("field")))


def prepare(entity: Entity, source: DataFrame, identity_map: DataFrame, deferred: Sequence[tuple[str, str]] = (), people: DataFrame | None = None, fallback: str | None = None) -> DataFrame:
    """_sid, v_<column> (the value for the target), p_<column> (the user) and issues, a row for each source row.

    Every step of a row adds its issues (severity, code, field) to one list, in the order of the
    fields: values that a step refuses, and what it loses; references that lead nowhere (for ``lenient``
    ones a warning, and the value is left empty); required values that are missing; users without a
    mapping in ``people`` (source_id, target_id): an error, or with a ``fallback`` user a warning. A row
    with an error is blocked.
    """
    columns = {c: F.col(f"`{c}`") for c in source.columns}
    made = {s: run(columns[s].cast("string"), entity.steps.get(s, ()), columns) for s, _ in entity.fields}
    issues: list[Column] = []
    for s, r in made.items():
        issues += [_issue(r.error.isNotNull(), "ERROR", r.error, s), _issue(r.error.isNull() & r.loss.isNotNull(), "WARNING", r.loss, s)]
    out = source.select(F.col(f"`{entity.source_id}`").cast("string").alias("_sid"), *[r.value.alias(f"v_{s}") for s, r in made.items()], F.array(*issues).cast(ISSUE).alias("_made"), *[F.col(f"`{c}`").cast("string").alias(f"p_{c}") for c in entity.people])
    later: list[Column] = []
    for column, parent in entity.references.items():
        if (entity.name, parent) in deferred:
            out = out.withColumn(f"v_{column}", F.lit(None).cast("string"))
            continue
        up = mapped(identity_map, parent).select(F.col("source_id").alias("_p"), F.col("target_id").alias(f"_t_{column}"))
        out = spread_join(out.withColumn("_p", F.col(f"v_{column}")), up, "_p").drop("_p")
        lost = F.col(f"_r_{column}").isNotNull() & F.col(f"v_{column}").isNull()
        out = out.withColumn(f"_r_{column}", F.col(f"v_{column}")).withColumn(f"v_{column}", F.col(f"_t_{column}")).drop(f"_t_{column}")
        later.append(_issue(lost, "WARNING" if column in entity.lenient and column not in entity.required else "ERROR", "LOOKUP_UNRESOLVED", column))
    for column in entity.required:
        given = F.col(f"_r_{column}").isNull() if f"_r_{column}" in out.columns else F.lit(True)  # a reference that leads nowhere has been told
        later.append(_issue(is_blank(F.col(f"v_{column}")) & given, "ERROR", "REQUIRED_VALUE_MISSING", column))
    for column in entity.people:
        known = (people if people is not None else source.sparkSession.createDataFrame([], "source_id string, target_id string")).select(F.col("source_id").alias("_p"), F.col("target_id").alias("_t"))
        out = spread_join(out.withColumn("_p", F.col(f"p_{column}")), known, "_p").drop("_p")
        missing = F.col(f"_q_{column}")
        out = out.withColumn(f"_q_{column}", F.col(f"p_{column}").isNotNull() & F.col("_t").isNull())
        out = out.withColumn(f"p_{column}", F.coalesce("_t", F.when(missing, F.lit(fallback)))).drop("_t")
        later.append(_issue(missing, "ERROR" if fallback is None else "WARNING", "PRINCIPAL_UNRESOLVED" if fallback is None else "PRINCIPAL_FALLBACK_APPLIED", column))
    issues_of = F.array_compact(F.concat(F.col("_made"), F.array(*later).cast(ISSUE)))
    return out.select("_sid", *[f"v_{s}" for s in made], *[f"p_{c}" for c in entity.people], issues_of.alias("issues"))


def plan_entity(entity: Entity, source: DataFrame, target: DataFrame, identity_map: DataFrame, run_id: str, deferred: Sequence[tuple[str, str]] = (), people: DataFrame | None = None, fallback: str | None = None) -> DataFrame:
    """source_id, target_id, action, error_code, issues and the target's columns for every source row that this run hasn't dealt with.

    Rows with a mapping of this run that didn't fail are left out, so a run that was broken off goes
    on where it was. Rows without an id, or with one that another row has, conflict.
    """
    done = identity_map.where((F.col("run_id") == run_id) & (F.col("table_name") == entity.name) & (F.col("outcome") != "FAILED") & F.col("source_id").isNotNull()).select(F.col("source_id").alias("_done")).distinct()
    ready = prepare(entity, source, identity_map, deferred, people, fallback)
    out = spread_join(ready, done.select(F.col("_done").alias("_sid"), F.lit(True).alias("_done")), "_sid").where("_done is null").drop("_done")
    if entity.match == "BUSINESS_KEY":
        matches = by_key(out.select("_sid", *[f"v_{s}" for s, _ in entity.key]), target, "_sid", entity.target_id, [f"v_{s}" for s, _ in entity.key], [t for _, t in entity.key])
    else:
        matches = by_primary_id(out.select("_sid"), target, "_sid", entity.target_id)
    shown = [(f"v_{s}", t) for s, t in entity.fields if t != entity.target_id]
    acts = preflight(out, target, matches, "_sid", entity.target_id, shown, entity.strategy, keep=[c for c in out.columns if c != "_sid"])
    errors = F.filter("issues", lambda x: x["severity"] == "ERROR")
    blocked = F.size(errors) > 0
    issues = F.when(~blocked & F.col("conflict").isNotNull(), F.array_append("issues", F.struct(F.lit("ERROR").alias("severity"), F.col("conflict").alias("code"), F.lit(entity.source_id).alias("field")))).otherwise(F.col("issues"))
    values = [F.col(f"v_{s}").alias(t) for s, t in entity.fields if t != entity.target_id] + [F.col(f"p_{s}").alias(t) for s, t in entity.people.items()]
    action = F.when(blocked, "BLOCKED").otherwise(F.col("action"))
    return acts.select("source_id", F.col("target_id").cast("string").alias("target_id"), action.alias("action"), F.coalesce(F.get(errors, F.lit(0))["code"], F.col("conflict")).alias("error_code"), issues.cast(ISSUE).alias("issues"), *values)


def written_columns(entity: Entity) -> list[str]:
    return [t for _, t in entity.fields if t != entity.target_id] + list(entity.people.values())


def apply_actions(entity: Entity, actions: DataFrame, target: DataFrame, run_id: str, save: write.Save) -> tuple[DataFrame, DataFrame]:
    """The target after the actions, and source_id, target_id, outcome, error_code of every row.

    No row is written over but those that were matched: a new row whose key is taken fails.
    """
    columns = written_columns(entity)
    changed = actions.where("action = 'UPDATE'").withColumn(entity.target_id, F.col("target_id"))
    after, updates = write.update(target, changed, entity.target_id, columns, save)
    after, creates = write.create(after, actions.where("action = 'CREATE'"), "source_id", entity.target_id, columns, entity.generated, f"{run_id}-{entity.name}", save)
    row = lambda df, target_id, outcome, error: df.select("source_id", target_id.alias("target_id"), outcome.alias("outcome"), error.alias("error_code"))
    c = F.col
    good = c("outcome") == "UPDATED"
    rest = actions.where("action not in ('CREATE', 'UPDATE')")
    same = c("action") == "UNCHANGED"
    out = row(updates, F.when(good, c("target_id")), F.when(good, "UPDATED").otherwise("FAILED"), F.when(~good, c("outcome")))
    out = out.unionByName(row(creates, c("_key"), c("outcome"), c("error_code")))
    return after, out.unionByName(row(rest, F.when(same, c("target_id")), F.when(same, "UNCHANGED").otherwise("FAILED"), F.when(~same, F.coalesce("error_code", "action"))))


def _overlay(target: DataFrame, entity: Entity, values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``target`` with ``values`` (_own: its id, and the columns) where they aren't null."""
    new = values.select(F.col("_own").cast("string").alias("_id"), *[F.col(c).alias(f"_w{i}") for i, c in enumerate(columns)])
    both = spread_join(target.withColumn("_id", F.col(f"`{entity.target_id}`").cast("string")), new, "_id")
    at = {c: i for i, c in enumerate(columns)}
    return both.select(*[F.coalesce(F.col(f"_w{at[c]}").cast(target.schema[c].dataType), F.col(f"`{c}`")).alias(c) if c in at else F.col(f"`{c}`") for c in target.columns])


def migrate(spark: SparkSession, entities: Sequence[Entity], sources: dict[str, DataFrame], targets: dict[str, DataFrame], run_id: str, save: write.Save, identity_map: DataFrame | None = None, people: DataFrame | None = None, fallback: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The targets after a load and its identity map. ``save(df, name)`` writes a table and gives it back.

    The map only grows: each table adds a part of its own, written once, and what refers to the table
    reads that part beside the map that was given, not the parts of other tables. snapshot() makes a
    grown map short again. Stamps are those of the rows that this run wrote.
    """
    before = identity_map if identity_map is not None else spark.createDataFrame([], MAP_SCHEMA)
    order, deferred = ordered(entities)
    out, parts = dict(targets), {}
    known = lambda *names: _union([before, *[parts[n] for n in names if n in parts]])
    for e in order:
        actions = save(plan_entity(e, sources[e.name], out[e.name], known(e.name, *e.references.values()), run_id, deferred, people, fallback), f"{run_id}-{e.name}-actions")
        after, outcomes = apply_actions(e, actions, out[e.name], run_id, save)
        out[e.name] = save(after, f"{run_id}-{e.name}")
        parts[e.name] = save(outcomes.select(F.lit(run_id).alias("run_id"), F.lit(e.name).alias("table_name"), "source_id", "target_id", "outcome", F.current_timestamp().alias("updated_at"), "error_code"), f"{run_id}-map-{e.name}")
    for name, parent in deferred:
        e = next(e for e in order if e.name == name)
        own, up = mapped(known(name), name), mapped(known(parent), parent)
        for column in [c for c, p in e.references.items() if p == parent]:
            links = sources[name].select(F.col(f"`{e.source_id}`").cast("string").alias("source_id"), F.col(f"`{column}`").cast("string").alias("_p"))
            links = links.join(own.select("source_id", F.col("target_id").alias("_own")), "source_id").join(up.select(F.col("source_id").alias("_p"), F.col("target_id").alias("_pt")), "_p")
            to = dict(e.fields)[column]
            out[name] = save(_overlay(out[name], e, links.select("_own", F.col("_pt").alias(to)), [to]), f"{run_id}-{name}-pass2-{column}")
    for e in order:
        if e.stamps:
            own = known(e.name).where((F.col("run_id") == run_id) & (F.col("table_name") == e.name) & F.col("outcome").isin("CREATED", "UPDATED")).select("source_id", F.col("target_id").alias("_own")).distinct()
            marks = sources[e.name].select(F.col(f"`{e.source_id}`").cast("string").alias("source_id"), *[F.col(f"`{s}`").alias(t) for s, t in e.stamps]).join(own, "source_id")
            out[e.name] = save(_overlay(out[e.name], e, marks, [t for _, t in e.stamps]), f"{run_id}-{e.name}-pass3")
    return out, known(*[e.name for e in order])


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def run_status(outcomes: dict[str, int], warnings: int = 0) -> str:
    if outcomes.get("UNRESOLVED"):
        return "NEEDS_RECONCILIATION"
    if outcomes.get("FAILED"):
        return "COMPLETED_WITH_ERRORS"
    return "COMPLETED_WITH_WARNINGS" if warnings else "COMPLETED"
