"""Writes of a load as Spark jobs: keys for new rows, rows created, rows updated, an outcome for each."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.match import spread_join

Save = Callable[[DataFrame, str], DataFrame]


def _guid(*parts: Column) -> Column:
    """A key in the form of a GUID that follows from ``parts`` alone, so that another attempt makes the same one."""
    h = F.md5(F.concat_ws("\u001f", *parts))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def allocate(rows: DataFrame, by: str, target: DataFrame, key: str, name: str, save: Save) -> DataFrame:
    """``rows`` with a new ``_key`` (text) each that no row of the target has.

    Whole-number keys follow the greatest one of the target, in the order of ``by``: ranges of rows are
    sorted and written, counted, and each row's number is its place in its range and the rows before it.
    Other keys are GUIDs that follow from ``name`` and ``by``; those that the target has already, looked
    for by a join, are made again from another number.
    """
    if isinstance(target.schema[key].dataType, T.IntegralType):
        at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        own = save(rows.orderBy(by).select("*", F.spark_partition_id().alias("_part"), at.alias("_at")), f"{name}-numbered")
        top = target.agg(F.coalesce(F.max(F.col(f"`{key}`").cast("long")), F.lit(0))).first()[0]
        starts, before = [], top + 1
        for part, n in sorted((r["_part"], r["count"]) for r in own.groupBy("_part").count().collect()):  # a row for each task
            starts.append((part, before))
            before += n
        offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part int, _before long"))
        return own.join(offsets, "_part").withColumn("_key", (F.col("_at") + F.col("_before")).cast("string")).drop("_part", "_at", "_before")
    held = target.select(F.lower(F.col(f"`{key}`").cast("string")).alias("_held"))
    done, left, attempt = None, rows, 0
    while True:
        made = save(left.withColumn("_key", _guid(F.lit(name), F.col(by).cast("string"), F.lit(str(attempt)))), f"{name}-keys{attempt}")
        free = made.join(held, made["_key"] == held["_held"], "left_anti")
        done = free if done is None else done.unionByName(free)
        left = made.join(held, made["_key"] == held["_held"], "left_semi").drop("_key")
        if left.isEmpty():
            return done
        attempt += 1


def supplied(rows: DataFrame, own: str, target: DataFrame, key: str) -> DataFrame:
    """``rows`` with the ``_key`` (text) that each brings, and a ``_clash``: ALREADY_EXISTS if the target has it, INVALID_KEY if it is none."""
    held = target.select(F.lower(F.col(f"`{key}`").cast("string")).alias("_low")).where("_low is not null").distinct().withColumn("_held", F.lit(True))
    made = rows.withColumn("_key", F.col(own).try_cast(target.schema[key].dataType).cast("string")).withColumn("_low", F.lower("_key"))
    out = spread_join(made, held, "_low", [own])
    clash = F.when(F.col("_key").isNull(), "INVALID_KEY").when(F.col("_held"), "ALREADY_EXISTS")
    return out.withColumn("_clash", clash).drop("_low", "_held")


def _typed(target: DataFrame, column: str, value: Column) -> Column:
    return value.cast(target.schema[column].dataType).alias(column)


def created(target: DataFrame, rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The target and its new rows: their ``_key`` and writable columns; all others are null."""
    new = rows.select(*[_typed(target, c, F.col("_key") if c == key else F.col(f"`{c}`") if c in columns else F.lit(None)) for c in target.columns])
    return target.unionByName(new)


def _id(key: str) -> Column:
    return F.col(f"`{key}`").cast("string")


def updated(target: DataFrame, rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The target with ``columns`` of its rows replaced by those of ``rows`` (one at most for each key)."""
    written = [c for c in columns if c != key]
    new = rows.select(_id(key).alias("_id"), F.lit(True).alias("_new"), *[F.col(f"`{c}`").alias(f"_w{i}") for i, c in enumerate(written)])
    both = spread_join(target.withColumn("_id", _id(key)), new, "_id")
    at = {c: i for i, c in enumerate(written)}
    return both.select(*[F.when(F.col("_new"), F.col(f"_w{at[c]}").cast(target.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) if c in at else F.col(f"`{c}`") for c in target.columns])


def update_outcomes(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with an ``outcome``: UPDATED, NOT_FOUND (the target has no such key, or none is given), or CONFLICT for several updates of one key, of which none is done."""
    own = rows.withColumn("_id", _id(key))
    n = own.where("_id is not null").groupBy("_id").agg(F.count("*").alias("_n"))
    held = target.select(_id(key).alias("_id")).where("_id is not null").distinct().withColumn("_held", F.lit(True))
    out = spread_join(own, n.join(held, "_id", "left"), "_id")
    return out.withColumn("outcome", F.when(F.col("_held").isNull(), "NOT_FOUND").when(F.col("_n") > 1, "CONFLICT").otherwise("UPDATED")).drop("_id", "_n", "_held")


def update(target: DataFrame, rows: DataFrame, key: str, columns: Sequence[str], save: Save) -> tuple[DataFrame, DataFrame]:
    """The target after the updates that could be done, and ``rows`` with their outcomes. ``rows`` hold ``key`` and ``columns``."""
    outcomes = save(update_outcomes(target, rows, key), "update-outcomes")
    return updated(target, outcomes.where("outcome = 'UPDATED'"), key, columns), outcomes


def create(target: DataFrame, rows: DataFrame, by: str, key: str, columns: Sequence[str], generated: bool, name: str, save: Save) -> tuple[DataFrame, DataFrame]:
    """The target after the creates that could be done, and ``rows`` with ``_key``, ``outcome`` (CREATED or FAILED) and ``error_code``.

    A ``generated`` key is made for each row; else each brings its own in ``by``, and one that the target
    has is never written over: ALREADY_EXISTS. Of rows that bring the same key none is created.
    """
    if generated:
        keyed = allocate(rows, by, target, key, name, save).withColumn("_clash", F.lit(None).cast("string"))
    else:
        keyed = supplied(rows, by, target, key)
        twice = keyed.where("_clash is null").groupBy(F.lower("_key").alias("_low")).agg(F.count("*").alias("_n")).where("_n > 1")
        keyed = spread_join(keyed.withColumn("_low", F.lower("_key")), twice, "_low", [by])
        keyed = keyed.withColumn("_clash", F.coalesce("_clash", F.when(F.col("_n") > 1, "DUPLICATE_SOURCE_ID"))).drop("_low", "_n")
    done = F.col("_clash").isNull()
    outcomes = save(keyed.select(*[F.col(f"`{c}`") for c in rows.columns if c not in ("_key", "outcome", "error_code")], F.when(done, F.col("_key")).alias("_key"), F.when(done, "CREATED").otherwise("FAILED").alias("outcome"), F.col("_clash").alias("error_code")), f"{name}-created")
    return created(target, outcomes.where("outcome = 'CREATED'"), key, columns), outcomes
