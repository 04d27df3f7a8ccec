"""Reconciling two datasets record by record, by an explicit key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.equality import normalize, values_equal
from .match import spread_join

PART = "\u001f"


@dataclass(frozen=True)
class Field:
    """A compared pair of columns; ``family`` as in functions.equality.normalize()."""

    left: str
    right: str
    family: str = "text"
    places: int | None = None


def key_of(columns: Sequence[Column], families: Sequence[str] | None = None) -> Column:
    """Normalised key parts joined by U+001F; null if any part is null or empty."""
    parts = [normalize(c.cast("string"), f) for c, f in zip(columns, families or ["text"] * len(columns), strict=True)]
    return F.when(F.forall(F.array(*parts), lambda p: p.isNotNull() & (p != "")), F.concat_ws(PART, *parts))


def keyed(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``df`` with _key and _held: how many rows hold the key (0 for a blank one)."""
    own = df.withColumn("_key", key_of([F.col(f"`{k}`") for k in key]))
    counts = own.where("_key is not null").groupBy("_key").agg(F.count("*").alias("_held"))
    return spread_join(own, counts, "_key").withColumn("_held", F.coalesce("_held", F.lit(0)))


def pair(left: DataFrame, right: DataFrame, left_key: Sequence[str], right_key: Sequence[str], fields: Sequence[Field]) -> DataFrame:
    """key, side facts and a verdict for each key of either side.

    A key that a side holds more than once excludes all its rows there: DUPLICATE_KEY. One
    duplicated on the left isn't missing there; one duplicated on the right leaves the
    left row ONLY_IN_LEFT. Blank keys (a row each side's count) are BLANK_KEY.
    """
    def side(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
        own = df.select(key_of([F.col(f"`{k}`") for k in key]).alias("key"), *[F.col(f"`{getattr(f, name)}`").alias(f"{name}_{i}") for i, f in enumerate(fields)])
        # one aggregation counts a key's rows and keeps its values; they are used only if it is held once
        kept = [F.first(f"{name}_{i}").alias(f"{name}_{i}") for i in range(len(fields))]
        return own.groupBy("key").agg(F.count("*").alias(f"{name}_rows"), *kept)

    ls, rs = side(left, left_key, "left"), side(right, right_key, "right")
    both = ls.join(rs, ls["key"].eqNullSafe(rs["key"]), "full").select(F.coalesce(ls["key"], rs["key"]).alias("key"), *[c for c in ls.columns + rs.columns if c != "key"]).fillna(0, ["left_rows", "right_rows"])
    differing = [F.when(~values_equal(F.col(f"left_{i}").cast("string"), F.col(f"right_{i}").cast("string"), f.family, f.places), F.struct(F.lit(f.left).alias("field"), F.col(f"left_{i}").cast("string").alias("left_value"), F.col(f"right_{i}").cast("string").alias("right_value"))) for i, f in enumerate(fields)]
    changes = F.filter(F.array(*differing), lambda d: d.isNotNull()) if fields else F.array().cast("array<struct<field:string,left_value:string,right_value:string>>")
    l, r = F.col("left_rows"), F.col("right_rows")
    verdict = (
        F.when(F.col("key").isNull(), "BLANK_KEY").when((l == 1) & (r == 1), F.when(F.size("changes") > 0, "VALUE_DIFFERS").otherwise("MATCHED"))
        .when((l == 1) & (r != 1), "ONLY_IN_LEFT").when((l == 0) & (r == 1), "ONLY_IN_RIGHT").otherwise("DUPLICATE_KEY")
    )
    return both.withColumn("changes", F.when((l == 1) & (r == 1), changes)).withColumn("verdict", verdict).select("key", "left_rows", "right_rows", "verdict", "changes")


def totals(pairs: DataFrame) -> DataFrame:
    """The counters of a comparison, which add up: matched + different + one-sided = records less excluded."""
    l, r, v = F.col("left_rows"), F.col("right_rows"), F.col("verdict")
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = pairs.agg(
        s(l).alias("left_records"), s(r).alias("right_records"),
        s((v == "MATCHED").cast("int")).alias("matched"), s((v == "VALUE_DIFFERS").cast("int")).alias("different"),
        s((v == "ONLY_IN_LEFT").cast("int")).alias("only_in_left"), s((v == "ONLY_IN_RIGHT").cast("int")).alias("only_in_right"),
        s(F.when(v == "BLANK_KEY", l)).alias("left_blank"), s(F.when(v == "BLANK_KEY", r)).alias("right_blank"),
        s(F.when((v != "BLANK_KEY") & (l > 1), l)).alias("left_duplicates"), s(F.when((v != "BLANK_KEY") & (r > 1), r)).alias("right_duplicates"),
    )
    c = F.col
    # a right row whose key is duplicated on the left is excluded with it
    return out.withColumn("reconciles", c("matched") + c("different") + c("only_in_left") == c("left_records") - c("left_blank") - c("left_duplicates"))


def differences(pairs: DataFrame) -> DataFrame:
    """key, type, field, left_value, right_value: a row for each differing field or one-sided, duplicated or blank key."""
    fields = pairs.where("verdict = 'VALUE_DIFFERS'").select("key", F.col("verdict").alias("type"), F.inline("changes"))
    other = pairs.where("verdict not in ('VALUE_DIFFERS', 'MATCHED')").select("key", F.col("verdict").alias("type"), *[F.lit(None).cast("string").alias(c) for c in ("field", "left_value", "right_value")])
    return fields.unionByName(other)


def differences_by_type(pairs: DataFrame) -> DataFrame:
    """type, records of the differences: a record that differs in several fields counts once."""
    return pairs.where("verdict <> 'MATCHED'").groupBy(F.col("verdict").alias("type")).agg(F.count("*").alias("records"))


def filter_differences(found: DataFrame, type: str | None = None, field: str | None = None, after: tuple[str, str, str] | None = None, most: int = 1000) -> DataFrame:
    """A page of differences in the order of (key, type, field), from behind the ``after`` row; 1,000 at most."""
    for column, value in (("type", type), ("field", field)):
        if value is not None:
            found = found.where(F.col(column) == value)
    order = [F.coalesce("key", F.lit("")), F.col("type"), F.coalesce("field", F.lit(""))]
    if after is not None:
        found = found.where(F.struct(*order) > F.struct(*map(F.lit, after)))
    return found.orderBy(*order).limit(max(1, min(1000, most)))


def set_reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows, all columns and repeats counted, that one side has more often: ``side`` is ONLY_IN_LEFT or ONLY_IN_RIGHT.

    One shuffle: rows of both sides are counted together.
    """
    names = left.columns
    both = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    counted = both.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return counted.select(F.when(F.col("_n") > 0, "ONLY_IN_LEFT").otherwise("ONLY_IN_RIGHT").alias("side"), F.abs("_n").alias("rows"), *[F.col(f"`{c}`") for c in names])


def schema_check(left: Sequence[str], right: Sequence[str], key: Sequence[tuple[str, str]], fields: Sequence[Field]) -> str:
    """FAIL if a key column is missing on a side, WARNING if a compared one is, else PASS."""
    gone = lambda pairs: any(a not in left or b not in right for a, b in pairs)
    return "FAIL" if gone(key) else "WARNING" if gone([(f.left, f.right) for f in fields]) else "PASS"


def compare_datasets(left: DataFrame, right: DataFrame, key: Sequence[tuple[str, str]], fields: Sequence[Field]) -> DataFrame:
    """check_name, outcome: SCHEMA, ROW_COUNT, RECORD_EXISTENCE and FIELD_VALUES. Without its key nothing else is looked at; a missing field isn't compared."""
    verdict = schema_check(left.columns, right.columns, key, fields)
    first = left.sparkSession.createDataFrame([("SCHEMA", verdict)], "check_name string, outcome string")
    if verdict == "FAIL":
        return first
    there = [f for f in fields if f.left in left.columns and f.right in right.columns]
    return first.unionAll(checks(pair(left, right, [a for a, _ in key], [b for _, b in key], there), len(there)))


def checks(pairs: DataFrame, fields: int) -> DataFrame:
    """ROW_COUNT, RECORD_EXISTENCE and FIELD_VALUES with PASS, WARNING or FAIL."""
    t = totals(pairs)
    c = F.col
    sided = c("only_in_left") + c("only_in_right")
    excluded = c("left_blank") + c("right_blank") + c("left_duplicates") + c("right_duplicates")
    usable = c("matched") + c("different") + sided
    rows = F.when(c("left_records") == c("right_records"), "PASS").otherwise("WARNING")
    existence = F.when((sided > 0) | (usable == 0), "FAIL").when(excluded > 0, "WARNING").otherwise("PASS")
    values = F.when(F.lit(fields == 0) | (c("different") == 0), "PASS").otherwise("FAIL")
    return t.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check_name"), v.alias("outcome")) for n, v in (("ROW_COUNT", rows), ("RECORD_EXISTENCE", existence), ("FIELD_VALUES", values))])))
