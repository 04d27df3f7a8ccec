"""Planning on the driver, and a load from end to end."""

from datetime import datetime, timezone

import pytest

from ledgerloom.operators.transform import Step
from ledgerloom.plans import cron, issues, migrate
from ledgerloom.plans import metadata as md


def test_names():
    assert md.bare("dbo.new_CustomerName") == "customername"
    assert md.table_similarity("dbo.Customers", "customer") == 1.0
    assert md.pair_tables(["Customers", "Orders"], ["order", "customer", "x"]) == [("Customers", "customer", 1.0), ("Orders", "order", 1.0)]


@pytest.mark.parametrize(("s", "t", "verdict"), [("Integer", "BigInt", "COMPATIBLE"), ("BigInt", "Integer", "LOSSY"), ("Integer", "String", "CONVERSION_REQUIRED"), ("DateTime", "DateOnly", "LOSSY"), ("File", "String", "INCOMPATIBLE"), ("Boolean", "DateTime", "INCOMPATIBLE"), ("String", "Integer", "CONVERSION_REQUIRED")])
def test_compatibility(s, t, verdict):
    assert md.compatibility(md.Column("a", s), md.Column("b", t)) == verdict


def test_sql_types():
    assert [md.sql_type(x) for x in ("nvarchar(40)", "varchar(max)", "numeric(18,4)", "uuid", "geometry")] == ["String", "Memo", "Decimal", "Uniqueidentifier", "Other"]


def test_schema_diff_and_mapping():
    a = md.Table("t", (md.Column("id", "Integer"), md.Column("old", "String"), md.Column("n", "BigInt")))
    b = md.Table("t", (md.Column("id", "Integer"), md.Column("n", "Integer"), md.Column("must", "String", required=True)), "id")
    rows = {(r["column"], r["status"], r["breaking"]) for r in md.schema_diff([a], [b])}
    assert rows == {("id", "MATCH", False), ("old", "SOURCE_ONLY", False), ("n", "DIFFERENT", True), ("must", "TARGET_ONLY", True)}
    mapping = md.auto_map(a, b)
    assert [m["status"] for m in mapping] == ["AUTO_MAPPED", "UNMAPPED", "AUTO_MAPPED"]
    codes = {code: severity for severity, code, _, _ in issues.plan_issues([issues.PlanTable("t", a, b, mapping)])}
    assert codes["REQUIRED_TARGET_COLUMN_UNMAPPED"] == "BLOCKER" and codes["LOSSY_CONVERSION"] == "WARNING"


def test_load_order():
    o = md.load_order(["order", "customer", "region"], [("order", "customer", False), ("customer", "region", True)])
    assert o.tables == ["region", "customer", "order"] and not o.deferred
    o = md.load_order(["account", "contact"], [("account", "contact", True), ("contact", "account", False), ("account", "account", True)])
    assert o.tables == ["account", "contact"] and o.deferred == [("account", "account"), ("account", "contact")]
    assert md.load_order(["a", "b"], [("a", "b", False), ("b", "a", False)]).unresolved == [["a", "b"]]


@pytest.mark.parametrize(("expression", "after", "zone", "want"), [
    ("*/15 * * * *", (2024, 1, 1, 10, 7), "UTC", (2024, 1, 1, 10, 15)),
    ("0 9 * * mon", (2024, 1, 1, 9, 0), "UTC", (2024, 1, 8, 9, 0)),
    ("0 0 1 * fri", (2024, 1, 1, 0, 0), "UTC", (2024, 1, 5, 0, 0)),
    ("30 2 * * *", (2024, 3, 31, 0, 0), "Europe/Berlin", (2024, 3, 31, 1, 30)),
    ("0 0 29 2 *", (2023, 1, 1, 0, 0), "UTC", (2024, 2, 29, 0, 0)),
])
def test_cron(expression, after, zone, want):
    assert cron.next_run(expression, datetime(*after, tzinfo=timezone.utc), zone) == datetime(*want, tzinfo=timezone.utc)


def test_cron_refuses():
    for bad in ("* * * *", "61 * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            cron.parse(bad)


def test_migrate_twice_and_self_reference(spark, tmp_path):
    nations = spark.createDataFrame([("1", " France "), ("2", "Spain")], "id string, name string")
    people = spark.createDataFrame([("a", "1", None), ("b", "2", "a"), ("c", "9", None)], "id string, nation string, boss string")
    targets = {"nation": spark.createDataFrame([("2", "Old")], "nid string, label string"), "person": spark.createDataFrame([], "pid string, nation string, boss string")}
    plan = [
        migrate.Entity("person", "id", "pid", [("id", "pid"), ("nation", "nation"), ("boss", "boss")], references={"nation": "nation", "boss": "person"}),
        migrate.Entity("nation", "id", "nid", [("id", "nid"), ("name", "label")], {"name": [Step("TRIM")]}),
    ]
    n = iter(range(1000))

    def save(df, name):
        path = str(tmp_path / f"{name}-{next(n)}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    out, known = migrate.migrate(spark, plan, {"nation": nations, "person": people}, targets, "r1", save)
    assert sorted(map(tuple, out["nation"].collect())) == [("1", "France"), ("2", "Spain")]
    assert sorted(map(tuple, out["person"].collect())) == [("a", "1", None), ("b", "2", "a")]
    outcomes = {(r.table_name, r.source_id): r.outcome for r in known.collect()}
    assert outcomes == {("nation", "1"): "CREATED", ("nation", "2"): "UPDATED", ("person", "a"): "CREATED", ("person", "b"): "CREATED", ("person", "c"): "FAILED"}
    again, known2 = migrate.migrate(spark, plan, {"nation": nations, "person": people}, out, "r1", save, known)
    assert sorted(map(tuple, again["person"].collect())) == sorted(map(tuple, out["person"].collect()))
    assert known2.where("outcome <> 'FAILED'").count() == 4
    assert migrate.run_status({"FAILED": 1}) == "COMPLETED_WITH_ERRORS"
