"""Streams with state: late rows, breaks and starts again, many batches against the finished table."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.operators import runs
from ledgerloom.streaming import state

START = datetime(2024, 1, 1)
SCHEMA = "sid string, tid string, at timestamp"
PICK = {"source_id": "sid", "target_id": "tid", "updated_at": "at"}


def put(spark, folder, rows):
    spark.createDataFrame([(s, t, START + timedelta(minutes=m) if m is not None else None) for s, t, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_newest_mapping_over_breaks_and_late_rows(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = spark.createDataFrame([], SCHEMA).schema
    follow = lambda keep=3_600_000: {r.source_id: r.target_id for r in state.follow_map(spark, folder, schema, PICK, out, check, "10 minutes", keep, files=1).collect()}
    put(spark, folder, [("a", "1", 0), ("a", "2", 5), ("b", "1", 3), (None, "x", 4), ("c", "x", None)])
    assert follow() == {"a": "2", "b": "1"}
    put(spark, folder, [("a", "0", 2), ("b", "9", 60)])  # an older entry changes nothing
    assert follow() == {"a": "2", "b": "9"}
    put(spark, folder, [("a", "late", 40), ("d", "1", 61)])  # before the watermark, which is 10 minutes before the newest
    assert follow() == {"a": "2", "b": "9", "d": "1"}
    told = spark.read.parquet(out)
    assert sorted(map(tuple, told.select("source_id", "target_id", "change").collect())) == [("a", "2", "NEW"), ("b", "1", "NEW"), ("b", "9", "CHANGED"), ("d", "1", "NEW")]
    assert follow() == {"a": "2", "b": "9", "d": "1"} and spark.read.parquet(out).count() == 4  # nothing new, nothing told
    put(spark, folder, [("z", "1", 600)])
    follow()
    put(spark, folder, [("a", "3", 601), ("z", "2", 602)])  # state of a has gone by now: it begins anew
    assert follow() == {"a": "3", "b": "9", "d": "1", "z": "2"}
    assert spark.read.parquet(out).where("source_id = 'a'").orderBy("updated_at").select("change").collect()[-1].change == "NEW"


def test_stream_of_many_batches_agrees_with_the_table(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = [(f"s{i * 7 % 40}", f"t{i:04}", i) for i in range(600)]
    for k in range(0, 600, 150):
        put(spark, folder, rows[k : k + 150])
    schema = spark.createDataFrame([], SCHEMA).schema
    got = {r.source_id: r.target_id for r in state.follow_map(spark, folder, schema, PICK, out, check, files=1).collect()}
    want = {}
    for s, t, _ in rows:
        want[s] = t
    assert got == want


def test_sessions_of_a_stream_and_of_a_table(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = [("k", "x", m) for m in (0, 10, 35, 100, 101)] + [("j", "x", 7), (None, "x", 8), ("j", "x", None), ("end", "x", 1000)]
    put(spark, folder, rows)
    table = spark.read.parquet(folder)
    want = {("k", 0, 65, 3), ("k", 100, 131, 2), ("j", 7, 37, 1), ("end", 1000, 1030, 1)}
    told = lambda df: {(r.key, *[int((x - START).total_seconds() // 60) for x in (r.session_start, r.session_end)], r.n) for r in df.collect()}
    assert told(state.sessions(table, "at", "30 minutes", "1 hour", "sid")) == want
    stream = spark.readStream.schema(table.schema).parquet(folder)
    state.sessions(stream, "at", "30 minutes", "1 hour", "sid").writeStream.outputMode("append").option("checkpointLocation", check).option("path", out).format("parquet").trigger(availableNow=True).start().awaitTermination()
    assert told(spark.read.parquet(out)) == {w for w in want if w[0] != "end"}  # the last one may go on


def test_recovery_by_evidence(spark):
    intents = spark.createDataFrame([(1, "UPDATE", ["1"], None), (2, "CREATE", ["1"], ["a", "b"]), (3, "CREATE", ["9"], ["a", "b"]), (4, "CREATE", None, [" A ", "B"]), (5, "CREATE", None, ["c", "d"]), (6, "CREATE", None, ["a", None]), (7, "CREATE", None, None)], "source_id int, operation string, kept array<string>, business array<string>")
    target = spark.createDataFrame([(1, "a", "b"), (2, "c", "d"), (3, "C", "D"), (4, None, "q")], "tid int, x string, y string")
    got = runs.recover_by_evidence(intents, target, "tid", {"BUSINESS_KEY": ("business", ["x", "y"]), "PRESERVED_ID": ("kept", ["tid"])})
    assert sorted(map(tuple, got.collect())) == [
        (1, None, "NOT_LOOKED_FOR", None, "RETRY"), (2, "PRESERVED_ID", "PRESENT", "1", "CONFIRM"), (3, "PRESERVED_ID", "ABSENT", None, "RETRY"), (4, "BUSINESS_KEY", "PRESENT", "1", "CONFIRM"),
        (5, "BUSINESS_KEY", "MULTIPLE", None, "PERSON"), (6, None, "NO_EVIDENCE", None, "PERSON"), (7, None, "NO_EVIDENCE", None, "PERSON"),
    ]
    assert runs.recover_by_evidence(intents.limit(0), target, "tid", {"PRESERVED_ID": ("kept", ["tid"])}).agg(F.count("*")).first()[0] == 0
