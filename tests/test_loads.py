"""Loads and pages over ids, keys and sizes that clean tables don't have."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import match
from ledgerloom.operators.transform import Step
from ledgerloom.plans import migrate, write
from ledgerloom.sources import paging


@pytest.fixture
def save(spark, tmp_path):
    n = iter(range(10_000))

    def save(df, name):
        path = str(tmp_path / f"{name}-{next(n)}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_new_rows_never_take_the_place_of_others(spark, save):
    """A source row whose id another target row holds: it fails, or gets a key of its own."""
    source = spark.createDataFrame([(1, "A"), (2, "C")], "id long, name string")
    target = spark.createDataFrame([(1, "B"), (7, "C")], "tid long, title string")
    e = migrate.Entity("t", "id", "tid", [("name", "title")], match="BUSINESS_KEY", key=[("name", "title")])
    out, known = migrate.migrate(spark, [e], {"t": source}, {"t": target}, "r", save)
    assert rows(out["t"]) == [(1, "B"), (7, "C")]
    assert rows(known.select("source_id", "target_id", "outcome", "error_code")) == [("1", None, "FAILED", "ALREADY_EXISTS"), ("2", "7", "UNCHANGED", None)]
    own = migrate.Entity("t", "id", "tid", [("name", "title")], match="BUSINESS_KEY", key=[("name", "title")], generated=True)
    out, known = migrate.migrate(spark, [own], {"t": source}, {"t": target}, "r", save)
    assert rows(out["t"]) == [(1, "B"), (7, "C"), (8, "A")]
    assert rows(known.select("source_id", "target_id", "outcome")) == [("1", "8", "CREATED"), ("2", "7", "UNCHANGED")]
    again, known2 = migrate.migrate(spark, [own], {"t": source}, {"t": out["t"]}, "r", save, known)
    assert rows(again["t"]) == rows(out["t"]) and known2.count() == 2  # nothing is left to do


def test_generated_text_keys_follow_from_the_row_and_avoid_those_there(spark, save):
    new = spark.createDataFrame([(f"s{i}", i) for i in range(50)], "sid string, v int")
    empty = spark.createDataFrame([], "key string, v int")
    first = {r.sid: r._key for r in write.allocate(new, "sid", empty, "key", "run", save).collect()}
    assert len(set(first.values())) == 50
    taken = spark.createDataFrame([(first["s3"].upper(), 0), (first["s4"], 0)], "key string, v int")
    after = {r.sid: r._key for r in write.allocate(new, "sid", taken, "key", "run", save).collect()}
    assert {k for k in first if first[k] != after[k]} == {"s3", "s4"} and len(set(after.values())) == 50


def test_generated_numbers_over_many_tasks(spark, save):
    new = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 3 % 5000).alias("sid"))
    target = spark.createDataFrame([(40,), (None,)], "key int")
    got = {r.sid: int(r._key) for r in write.allocate(new, "sid", target, "key", "run", save).collect()}
    assert got == {i: 41 + i for i in range(5000)}


def test_updates_and_creates_tell_what_became_of_each(spark, save):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id int, t string, u string")
    changes = spark.createDataFrame([(1, "A"), (2, "B"), (2, "BB"), (9, "N"), (None, "M")], "id int, t string")
    after, told = write.update(target, changes, "id", ["t"], save)
    assert rows(told) == [(1, "A", "UPDATED"), (2, "B", "CONFLICT"), (2, "BB", "CONFLICT"), (9, "N", "NOT_FOUND"), (None, "M", "NOT_FOUND")]
    assert rows(after) == [(1, "A", "x"), (2, "b", "y"), (3, "c", "z")]
    new = spark.createDataFrame([("3", "c"), ("4", "d"), ("x", "e"), (None, "f"), ("5", "g"), ("5", "h")], "sid string, t string")
    after, told = write.create(target, new, "sid", "id", ["t"], False, "n", save)
    assert rows(after) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "z"), (4, "d", None)]
    assert {(r.t, r.outcome, r.error_code) for r in told.collect()} == {("c", "FAILED", "ALREADY_EXISTS"), ("d", "CREATED", None), ("e", "FAILED", "INVALID_KEY"), ("f", "FAILED", "INVALID_KEY"), ("g", "FAILED", "DUPLICATE_SOURCE_ID"), ("h", "FAILED", "DUPLICATE_SOURCE_ID")}
    assert rows(write.update(target, changes.limit(0), "id", ["t"], save)[0]) == rows(target)


def test_preflight_tells_of_every_row_once(spark):
    source = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d"), (None, "e")], "id long, name string")
    target = spark.createDataFrame([(1, "a"), (2, "D")], "tid long, title string")
    m = match.by_primary_id(source, target, "id", "tid")
    assert m.count() == 5
    got = match.preflight(source, target, m, "id", "tid", [("name", "title")], "UPSERT")
    assert rows(got.select("source_id", "action", "conflict")) == [(1, "CONFLICT", "DUPLICATE_SOURCE_ID")] * 2 + [(2, "UPDATE", None), (None, "CONFLICT", "SOURCE_ID_MISSING"), (None, "CONFLICT", "SOURCE_ID_MISSING")]
    assert {r.action: r.records for r in match.action_totals(got).collect()} == {"CONFLICT": 4, "UPDATE": 1}


def test_keys_are_equal_part_by_part(spark):
    source = spark.createDataFrame([(1, "a|b", "c"), (2, "x", None), (3, "x", " "), (4, " P ", "q"), (5, "A|B", "C")], "sid int, a string, b string")
    target = spark.createDataFrame([(10, "a", "b|c"), (11, "x", None), (12, "p", "Q"), (13, None, "x")], "tid int, a string, b string")
    got = match.by_key(source, target, "sid", "tid", ["a", "b"], ["a", "b"])
    assert rows(got) == [(1, None, None), (2, None, "BUSINESS_KEY_INCOMPLETE"), (3, None, "BUSINESS_KEY_INCOMPLETE"), (4, 12, None), (5, None, "DUPLICATE_SOURCE_KEY")]
    cased = match.by_primary_id(spark.createDataFrame([("x",), ("Y",)], "sid string"), spark.createDataFrame([("X",), ("x",), ("y",)], "tid string"), "sid", "tid")
    assert rows(cased) == [("Y", "y", None), ("x", None, "AMBIGUOUS_TARGET_MATCH")]


def test_null_keys_are_spread(spark, save):
    """99 of 100 references are null: no task of a join gets more than a small part of them."""
    n = 40_000
    df = spark.range(n, numPartitions=4).select(F.col("id"), F.when(F.col("id") % 100 == 0, F.col("id")).alias("ref"))
    other = spark.range(n).select(F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = match.resolve_lookup(df, "ref", other, other.select("source_id"), "to")
        assert "_salt" in out._jdf.queryExecution().optimizedPlan().toString()
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == n and max(sizes) < n / 4 * 1.3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    got = {r.id: r.to for r in out.where("id % 100 = 0 or id < 3").collect()}
    assert got[1] is None and got[200] == 201


def test_three_passes_and_a_resumed_run(spark, save):
    """References of a cycle, stamps of written rows only, one entry a row after a snapshot."""
    people = spark.createDataFrame([("a", "b", "t1", "u1"), ("b", "a", "t2", "u9"), ("c", None, "t3", None)], "id string, boss string, made string, who string")
    target = spark.createDataFrame([("c", None, "old", None)], "pid string, boss string, made_on string, owner string")
    users = spark.createDataFrame([("u1", "U1")], "source_id string, target_id string")
    e = migrate.Entity("person", "id", "pid", [("id", "pid"), ("boss", "boss")], references={"boss": "person"}, people={"who": "owner"}, stamps=[("made", "made_on")], strategy="SKIP_EXISTING")
    out, known = migrate.migrate(spark, [e], {"person": people}, {"person": target}, "r1", save, people=users, fallback="SYS")
    assert rows(out["person"]) == [("a", "b", "t1", "U1"), ("b", "a", "t2", "SYS"), ("c", None, "old", None)]
    broken = known.where("source_id <> 'b'").unionByName(known.where("source_id = 'b'").withColumn("outcome", F.lit("FAILED")).withColumn("target_id", F.lit(None).cast("string")))
    left = out["person"].where("pid <> 'b'")
    again, grown = migrate.migrate(spark, [e], {"person": people}, {"person": left}, "r1", save, broken, people=users, fallback="SYS")
    assert rows(again["person"]) == rows(out["person"]) and grown.count() == 4
    short = migrate.snapshot(grown)
    assert {r.source_id: r.outcome for r in short.collect()} == {"a": "CREATED", "b": "CREATED", "c": "UNCHANGED"} and short.count() == 3
    strict = migrate.prepare(e, people, known, people=users)
    assert {r._sid: [tuple(i) for i in r.issues] for r in strict.collect()}["b"] == [("ERROR", "PRINCIPAL_UNRESOLVED", "who")]


def test_all_issues_of_a_row_are_told(spark):
    source = spark.createDataFrame([("1", "x", "toolong", "9", " ")], "id string, n string, s string, ref string, need string")
    e = migrate.Entity("t", "id", "tid", [("n", "n"), ("s", "s"), ("ref", "ref"), ("need", "need")], {"n": [Step("TO_INTEGER")], "s": [Step("TRUNCATE", {"length": 3})]}, {"ref": "other"}, required=["need"])
    got = migrate.prepare(e, source, spark.createDataFrame([], migrate.MAP_SCHEMA)).first()
    assert [tuple(i) for i in got.issues] == [("ERROR", "INVALID_NUMBER", "n"), ("WARNING", "SHORTENED", "s"), ("ERROR", "LOOKUP_UNRESOLVED", "ref"), ("ERROR", "REQUIRED_VALUE_MISSING", "need")]


def test_pages_of_any_size(spark, save):
    df = spark.range(0, 2503, numPartitions=6).select((F.col("id") * 7 % 2503).alias("k"), F.lit("v").alias("v")).unionByName(spark.createDataFrame([(None, "none")], "k long, v string"))
    pages = paging.Pages(df, ["k"], 500, save)
    assert (pages.total, pages.count) == (2504, 6)
    keys = [[r.k for r in pages.page(n).collect()] for n in range(1, 8)]
    assert sum(keys, []) == [None, *range(2503)] and [len(k) for k in keys] == [500] * 5 + [4, 0]
    assert rows(pages.numbered().where("page = 6").select("k", "place")) == [(k, k + 1) for k in range(2499, 2503)]
    last, seen = None, []
    for _ in range(7):
        got = paging.after(df.where("k is not null"), ["v", "k"], last, 500).collect()
        seen += [r.k for r in got]
        last = [got[-1].v, got[-1].k] if got else last
    assert seen == list(range(2503))
    assert paging.Pages(df.limit(0), ["k"], 10, save).page(1).count() == 0
    with pytest.raises(ValueError):
        paging.Pages(df, ["k"], 0, save)


def test_tables_with_maps_are_written(spark, save):
    """Columns that can't be hashed stay as they are."""
    target = spark.sql("SELECT 1 AS id, map('a', 1) AS m, 'x' AS t UNION ALL SELECT CAST(NULL AS INT), map('b', 2), 'y'")
    after, _ = write.update(target, spark.createDataFrame([(1, "z")], "id int, t string"), "id", ["t"], save)
    assert {(r.id, tuple(r.m.items()), r.t) for r in after.collect()} == {(1, (("a", 1),), "z"), (None, (("b", 2),), "y")}
