"""Which target record a source record is, and what a run would do about it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.equality import normalize
from ..functions.text import is_blank, js_trim

STRATEGIES = ("SKIP_EXISTING", "CREATE_ONLY", "UPSERT", "SYNC")


#: Rows without a key are dealt over so many groups, so they don't meet in one task of a join.
SPREAD = 1024


def spread_join(rows: DataFrame, other: DataFrame, key: str, spread: Sequence[str] = ()) -> DataFrame:
    """A left join on ``key`` in which null keys, which match nothing, are spread by other columns (all by default)."""
    own = list(spread) or [f.name for f in rows.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]  # these can't be hashed
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in own]), F.lit(SPREAD))).otherwise(F.lit(0))
    none = F.pmod(F.xxhash64(F.col(key)), F.lit(1)).cast("int")  # 0, but not as a constant, which the optimizer would take out of the join's keys
    out = rows.withColumn("_salt", salt.cast("int")).join(other.withColumn("_salt", none), [key, "_salt"], "left")
    return out.drop("_salt")


def _doubtful(source: DataFrame, source_id: str) -> DataFrame:
    """source_id, _id_conflict of ids that more than one row has: what is done for one could be meant for another."""
    own = source.groupBy(F.col(f"`{source_id}`").alias("source_id")).agg(F.count("*").alias("_n"))
    return own.where("source_id is not null and _n > 1").select("source_id", F.lit("DUPLICATE_SOURCE_ID").alias("_id_conflict"))


def _id_conflict() -> Column:
    return F.when(F.col("source_id").isNull(), "SOURCE_ID_MISSING").otherwise(F.col("_id_conflict"))


def with_claims(out: DataFrame) -> DataFrame:
    """A target goes to the first source row that claims it; the others conflict. Rows without an id of their own claim nothing."""
    out = spread_join(out, _doubtful(out, "source_id"), "source_id", ["target_id"])
    out = out.withColumn("conflict", F.coalesce(_id_conflict(), F.col("conflict"))).withColumn("target_id", F.when(F.col("conflict").isNull(), F.col("target_id")))
    first = out.where("target_id is not null").groupBy("target_id").agg(F.min("source_id").alias("_first"))
    out = spread_join(out, first, "target_id", ["source_id"])
    late = F.coalesce(F.col("source_id") > F.col("_first"), F.lit(False))
    return out.select("source_id", F.when(~late, F.col("target_id")).alias("target_id"), F.coalesce(F.col("conflict"), F.when(late, "DUPLICATE_SOURCE_KEY")).alias("conflict"))


def by_primary_id(source: DataFrame, target: DataFrame, source_id: str, target_id: str) -> DataFrame:
    """source_id, target_id, conflict for each row of ``source``: equal ids, whatever their case.

    A null id is SOURCE_ID_MISSING, one that several rows have DUPLICATE_SOURCE_ID for them all,
    and one that differs from several target ids only by case AMBIGUOUS_TARGET_MATCH.
    """
    fold = lambda c: F.lower(F.col(f"`{c}`").cast("string"))
    s = source.select(F.col(f"`{source_id}`").alias("source_id"), fold(source_id).alias("_k"))
    t = target.select(F.col(f"`{target_id}`").alias("target_id"), fold(target_id).alias("_k")).where("_k is not null").groupBy("_k").agg(F.count("*").alias("_n"), F.min("target_id").alias("target_id"))
    out = spread_join(s, t, "_k", ["source_id"])
    several = F.col("_n") > 1
    return with_claims(out.select("source_id", F.when(~several, F.col("target_id")).alias("target_id"), F.when(several, "AMBIGUOUS_TARGET_MATCH").alias("conflict")))


def by_key(source: DataFrame, target: DataFrame, source_id: str, target_id: str, source_key: Sequence[str], target_key: Sequence[str], business: bool = True) -> DataFrame:
    """source_id, target_id, conflict for each row of ``source``: equal keys, part by part, case and outer white space aside.

    A missing part is BUSINESS_KEY_INCOMPLETE (or no match for an alternate key), several
    targets AMBIGUOUS_TARGET_MATCH, a key seen before DUPLICATE_SOURCE_KEY, a null or repeated id as
    in by_primary_id(): never a guess. Target rows with a missing part match nothing.
    """
    text = lambda c: F.col(f"`{c}`").cast("string")
    parts = lambda key: F.array(*[F.lower(js_trim(text(c))) for c in key])
    complete = lambda key: ~F.exists(F.array(*map(text, key)), lambda x: is_blank(x))
    s = source.select(F.col(f"`{source_id}`").alias("source_id"), F.when(complete(source_key), parts(source_key)).alias("_key"))
    s = spread_join(s, _doubtful(s, "source_id"), "source_id", ["_key"]).withColumn("_bad", _id_conflict()).drop("_id_conflict")
    s = s.withColumn("_k", F.when(F.col("_bad").isNull(), F.col("_key")))
    t = target.where(complete(target_key)).select(F.col(f"`{target_id}`").alias("target_id"), parts(target_key).alias("_k")).groupBy("_k").agg(F.count("*").alias("_n"), F.min("target_id").alias("target_id"))
    first = s.where("_k is not null").groupBy("_k").agg(F.min("source_id").alias("_first"))
    out = spread_join(s, first.join(t, "_k", "left"), "_k", ["source_id"])
    conflict = (
        F.when(F.col("_bad").isNotNull(), F.col("_bad")).when(F.col("_key").isNull(), "BUSINESS_KEY_INCOMPLETE" if business else None)
        .when(F.col("source_id") > F.col("_first"), "DUPLICATE_SOURCE_KEY").when(F.col("_n") > 1, "AMBIGUOUS_TARGET_MATCH")
    )
    out = out.withColumn("conflict", conflict)
    return out.select("source_id", F.when(F.col("conflict").isNull(), F.col("target_id")).alias("target_id"), "conflict")


def latest_mapping(identity_map: DataFrame, run_id: str) -> DataFrame:
    """source_id, target_id: the newest mapping that didn't fail; one of the current run wins, and of equally new ones the greatest target id."""
    own = identity_map.where("outcome <> 'FAILED' and target_id is not null")
    newest = F.max(F.struct((F.col("run_id") == run_id).alias("own"), "updated_at", "target_id")).alias("newest")
    return own.groupBy("source_id").agg(newest).select("source_id", F.col("newest.target_id").alias("target_id"))


def resolve_lookup(rows: DataFrame, column: str, mapping: DataFrame, target_ids: DataFrame, into: str) -> DataFrame:
    """``rows`` with the target id that a reference leads to: by the identity map, else the same id in the target."""
    own = rows.withColumn("_ref", F.col(f"`{column}`"))
    m = mapping.select(F.col("source_id").alias("_ref"), F.col("target_id").alias("_mt"))
    t = target_ids.select(F.col(target_ids.columns[0]).alias("_ref"), F.col(target_ids.columns[0]).alias("_t"))
    out = spread_join(spread_join(own, m, "_ref"), t, "_ref")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c != into], F.coalesce("_mt", "_t").alias(into))


def decide(matched: Column, blocked: Column, conflict: Column, changed: Column, strategy: str) -> Column:
    """CREATE, UPDATE, UNCHANGED, CONFLICT or BLOCKED."""
    if strategy not in STRATEGIES:
        raise ValueError(strategy)
    existing = {"SKIP_EXISTING": F.lit("UNCHANGED"), "CREATE_ONLY": F.lit("CONFLICT")}.get(strategy, F.when(changed, "UPDATE").otherwise("UNCHANGED"))
    return F.when(blocked, "BLOCKED").when(conflict.isNotNull(), "CONFLICT").when(~matched, "CREATE").otherwise(existing)


def preflight(source: DataFrame, target: DataFrame, matches: DataFrame, source_id: str, target_id: str, fields: Sequence[tuple[str, str]], strategy: str, required: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """source_id, target_id, action, changes, conflict and the ``keep`` columns: what a run would do with each source row.

    Every row of ``source`` makes one row, rows without an id and rows that repeat one included: they
    conflict, whatever the matches say of them. ``target`` has each id once.
    """
    text = lambda c: F.col(f"`{c}`").cast("string")
    blocked = F.exists(F.array(*map(text, required)), lambda x: is_blank(x)) if required else F.lit(False)
    s = source.select(F.col(f"`{source_id}`").alias("source_id"), *[text(a).alias(f"s{i}") for i, (a, _) in enumerate(fields)], blocked.alias("_blocked"), *[F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)])
    t = target.select(F.col(f"`{target_id}`").alias("target_id"), F.lit(True).alias("_there"), *[text(b).alias(f"t{i}") for i, (_, b) in enumerate(fields)])
    one = F.count("*") == 1  # what is known of an id, once
    known = matches.where("source_id is not null").groupBy("source_id").agg(F.when(one, F.min("target_id")).alias("target_id"), F.when(one, F.min("conflict")).otherwise("DUPLICATE_SOURCE_ID").alias("conflict"))
    out = spread_join(s, known, "source_id").withColumn("conflict", F.when(F.col("source_id").isNull(), "SOURCE_ID_MISSING").otherwise(F.col("conflict")))
    out = spread_join(out, t, "target_id", ["source_id"])
    change = lambda i, b: F.when(~normalize(F.col(f"s{i}"), "text").eqNullSafe(normalize(F.col(f"t{i}"), "text")), F.lit(b))
    changes = F.array_sort(F.array_compact(F.array(*[change(i, b) for i, (_, b) in enumerate(fields)])))
    there = F.coalesce("_there", F.lit(False))
    out = out.withColumn("changes", F.when(there, F.array_join(changes, ",")))
    action = decide(there, F.col("_blocked"), F.col("conflict"), F.col("changes") != "", strategy)
    return out.select("source_id", "target_id", action.alias("action"), "changes", "conflict", *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)])


def action_totals(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("records"))


def principals(source: DataFrame, target: DataFrame, tiers: Sequence[tuple[str, int]], source_id: str, target_id: str) -> DataFrame:
    """source_id, target_id, tier, confidence, ambiguous: users matched by the first tier that has hits, if just one.

    Each tier is one join with the target's values grouped, so no user meets more than one row of a tier.
    """
    out = source
    for i, (column, _) in enumerate(tiers):
        fold = F.lower(js_trim(F.col(f"`{column}`").cast("string")))
        t = target.where(~is_blank(F.col(f"`{column}`").cast("string"))).groupBy(fold.alias(f"_k{i}")).agg(F.count("*").alias(f"_n{i}"), F.min(target_id).alias(f"_t{i}"))
        out = spread_join(out.withColumn(f"_k{i}", F.nullif(fold, F.lit(""))), t, f"_k{i}", [source_id])
    hit = lambda i: F.col(f"_n{i}").isNotNull()
    pick = lambda f: F.coalesce(*[F.when(hit(i), f(i)) for i in range(len(tiers))])
    n = pick(lambda i: F.col(f"_n{i}"))
    one = n == 1
    return out.select(F.col(source_id).alias("source_id"), F.when(one, pick(lambda i: F.col(f"_t{i}"))).alias("target_id"), F.when(one, pick(lambda i: F.lit(tiers[i][0]))).alias("tier"), F.when(one, pick(lambda i: F.lit(tiers[i][1]))).alias("confidence"), F.coalesce(n > 1, F.lit(False)).alias("ambiguous"))
