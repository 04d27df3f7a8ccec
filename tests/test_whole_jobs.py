"""Operators over whole tables, past the sizes and rows that the smallest tables have."""

import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.operators import findings, infer, match, profile
from ledgerloom.plans import issues
from ledgerloom.plans import metadata as md
from ledgerloom.sources import files
from ledgerloom.sources import tables as src


def test_distinct_counts_are_exact_at_any_size(spark):
    n = 60_000
    df = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 55_000).alias("half"), F.lit(None).cast("string").alias("none"))
    got = {r.field: r for r in profile.duplication(profile.value_counts(df)).collect()}
    assert (got["row_id"].distinct_count, got["row_id"].duplicate_count) == (n, 0)
    assert (got["half"].distinct_count, got["half"].duplicate_count) == (55_000, 5_000)
    own = profile.profile(df, "big")
    assert {r.field: (r.distinct_count, r.basis) for r in own.collect()} == {"row_id": (n, "EXACT"), "half": (55_000, "EXACT"), "none": (0, "EXACT")}
    assert [tuple(r) for r in findings.candidate_keys(own).collect()] == [("big", "row_id")]
    assert [r.field for r in findings.findings(own).where("rule = 'CANDIDATE_KEY'").collect()] == ["row_id"]


def test_discovered_relationships_are_told_as_found(spark, monkeypatch):
    """Verdicts and counts of the query are those of discover(), orders too."""
    from ledgerloom import queries as q
    from ledgerloom.operators import relate

    from .conftest import SMALL

    want = {(r.child_table, r.parent_table): (r.verdict, r.orphan_records, r.child_records) for r in q.QUERIES["relationships"](spark, SMALL).collect()}
    customers = spark.read.parquet(f"{SMALL}/customer.parquet").count()
    assert want["customer", "nation"] == ("INFERRED", 0, customers) and want["orders", "customer"][1] > 0
    monkeypatch.setattr(relate, "INFERRED_COVERAGE", 1.0)
    got = {(r.child_table, r.parent_table): (r.verdict, r.orphan_records, r.child_records) for r in q.QUERIES["relationships"](spark, SMALL).collect()}
    assert got == {k: ("POSSIBLE" if k == ("orders", "customer") else v[0], *v[1:]) for k, v in want.items()}


def test_no_group_or_task_holds_a_whole_table(spark):
    """J18 limits ids before it shuffles them; the preview doesn't gather the table."""
    from ledgerloom import queries as q

    from .conftest import SMALL

    plan = lambda name: q.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan("J18_duplicate_attribution")
    assert "TakeOrderedAndProject" in plan("t_preview") and "REPARTITION_BY_NUM" not in plan("t_preview")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_unmatched_rows_are_spread(spark):
    """Rows without a match or key share no window and no join key."""
    source = spark.range(3000).select(F.col("id").alias("sid"), F.when(F.col("id") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"))
    target = spark.range(5).select((F.col("id") + 10_000).alias("tid"), F.concat(F.lit("K"), F.col("id")).alias("k"))
    by_id, by_key = match.by_primary_id(source, target, "sid", "tid"), match.by_key(source, target, "sid", "tid", ["k"], ["k"])
    assert "Window" not in plan(by_id) + plan(by_key) and "_salt" in plan(by_id) and "_salt" in plan(by_key)
    assert by_id.where("target_id is null and conflict is null").count() == 3000
    rows = {r.source_id: (r.target_id, r.conflict) for r in by_key.collect()}
    assert rows[0] == (None, "BUSINESS_KEY_INCOMPLETE") and rows[1] == (10_001, None) and rows[502] == (None, "DUPLICATE_SOURCE_KEY") and rows[7] == (None, None) and len(rows) == 3000


def test_first_claim_wins(spark):
    claims = spark.createDataFrame([(1, 7, None), (2, 7, None), (3, None, None), (4, 8, "X"), (0, 8, None)], "source_id int, target_id int, conflict string")
    assert {tuple(r) for r in match.with_claims(claims).collect()} == {(1, 7, None), (2, None, "DUPLICATE_SOURCE_KEY"), (3, None, None), (4, None, "X"), (0, 8, None)}


def test_types_are_inferred_without_expanding_rows(spark):
    df = spark.createDataFrame([("1", "x", None), ("2", "", "n/a"), ("1", "007", " ")], "a string, b string, c string")
    out = infer.infer_types(df)
    assert "Expand" not in plan(out)
    assert [tuple(r) for r in out.collect()] == [("a", "Integer", 3, 3, 2, 1), ("b", "String", 3, 2, 2, 3), ("c", "String", 3, 0, 0, None)]
    assert [tuple(r)[:4] for r in infer.infer_types(df.limit(0)).collect()] == [("a", "String", 0, 0), ("b", "String", 0, 0), ("c", "String", 0, 0)]


def test_values_are_counted_in_shares_of_what_a_task_reads(spark):
    """Types and meanings of a table that one task reads: its rows are dealt out before their values are counted."""
    df = spark.range(0, 2000, 1, 1).selectExpr("concat(id, '@a.example') AS `mail.to`", "CAST(id % 3 AS STRING) AS _at", "CAST(NULL AS STRING) AS none")
    for out in (infer.semantic_types(df, df.columns), infer.infer_types(df), profile.value_counts(df), profile.column_stats(df)):
        below = plan(out).rpartition("Generate")[2]
        assert "RepartitionByExpression" in below and "Aggregate" not in below
    assert [tuple(r)[:3] for r in infer.semantic_types(df, df.columns).orderBy("field").collect()] == [("_at", "CATEGORICAL", "HIGH"), ("mail.to", "EMAIL", "HIGH"), ("none", "EMPTY", "HIGH")]
    assert [tuple(r)[:5] for r in infer.infer_types(df).collect()] == [("mail.to", "String", 2000, 2000, 2000), ("_at", "Integer", 2000, 2000, 3), ("none", "String", 2000, 0, 0)]
    sizes = [r["count"] for r in session.spread(df).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2000 and len(sizes) == 4 and max(sizes) < 700
    same = session.spread(spark.range(0, 4000, 1, 40).selectExpr("1 AS a"))  # equal rows, read by 40 tasks
    assert same.groupBy(F.spark_partition_id()).count().count() > 1


def test_repeated_rows_stay_repeated(spark):
    rows = spark.createDataFrame([("Ab", 1), ("Ab", 1), ("cd", 2), ("CD", 3)], "k string, n int")
    want = spark.createDataFrame([("Ab",), ("ab",), ("Cd",)], "k string")
    assert sorted(tuple(r) for r in src.retrieve_by_ids(rows, "k", want, ignore_case=True).collect()) == [("Ab", 1), ("Ab", 1), ("CD", 3), ("cd", 2)]


def test_evidence_of_equal_names_in_two_folders(spark, tmp_path):
    for d, text in (("a", "one"), ("b", "two")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.csv").write_text(text)
    recorded = src.manifest(spark, str(tmp_path)).cache()
    assert {r.name for r in recorded.collect()} == {"a/x.csv", "b/x.csv"}
    assert [r.verdict for r in src.verify_evidence(spark, str(tmp_path), recorded).collect()] == ["VALID", "VALID"]


def test_workbooks_of_a_folder(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    for name, head, n in (("a", "id", 1), ("b", "id", 2), ("c", "other", 3)):
        with zipfile.ZipFile(tmp_path / f"{name}.xlsx", "w") as z:
            rows = "".join(f"<row>{cell(x)}{cell(y)}</row>" for x, y in ((head, "v"), (n, "x"), ("", "")))
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    assert {tuple(r) for r in files.read_xlsx(spark, str(tmp_path / "[ab].xlsx")).collect()} == {("1", "x"), ("2", "x")}
    with pytest.raises(ValueError):
        files.read_xlsx(spark, str(tmp_path))


def test_delimited_files_are_split_unless_a_cell_holds_a_break(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"x"\n2,"y"\n')
    (tmp_path / "b.csv").write_text('id,t\n1,"x\nz"\n2,y\n')
    assert not files.has_line_breaks(spark, str(tmp_path / "a.csv")) and files.has_line_breaks(spark, str(tmp_path / "b.csv"))
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "b.csv")).collect()] == [("1", "x\nz"), ("2", "y")]


def test_ordinals_have_no_gaps(spark):
    out = files.staged(spark.range(1000).repartition(7).toDF("v")).collect()
    assert sorted(r._ordinal for r in out) == list(range(1000)) and all(r._id == str(r._ordinal) for r in out)


def test_plan_issue_codes():
    c = md.Column
    s = md.Table("s", (c("id", "Integer"), c("name", "Memo"), c("kind", "String"), c("owner", "Lookup", targets=("users",), required=True)), "id")
    d = md.Table("d", (c("pk", "Integer", identity=True), c("name", "String", max_length=10), c("kind", "Picklist"), c("must", "String", required=True)), "pk", keys=(("name",),), inactive_keys=(("name",),), name_column="name")
    mapping = [{"source": "name", "target": "name", "status": "MANUAL"}, {"source": "kind", "target": "kind", "status": "MANUAL"}, {"source": "owner", "target": None, "status": "UNMAPPED"}]
    table = issues.PlanTable("t", s, d, mapping, "AUTO_SUGGESTED", "ALTERNATE_KEY", ("name",), choices={"kind": issues.Choice({"a": None})}, source_rows=0, target_rows=3, automation=2, audit=frozenset())
    options = issues.Options("CREATE_ONLY", True, frozenset({"owner", "created_on", "modified_by"}), (5, 1, 1), can_impersonate=True, bypass_logic=True, suppress_flows=True)
    found = {(a, b) for a, b, _, _ in issues.plan_issues([table], options)}
    assert found >= {
        ("BLOCKER", "OBJECT_MAPPING_UNCONFIRMED"), ("INFO", "CROSS_PROVIDER_IDENTITY"), ("INFO", "TARGET_IDENTITY_KEY"), ("BLOCKER", "CHOICE_MAPPING_INCOMPLETE"), ("WARNING", "LOSSY_CONVERSION"), ("BLOCKER", "REQUIRED_TARGET_COLUMN_UNMAPPED"),
        ("INFO", "UNMAPPED_COLUMNS"), ("BLOCKER", "ALTERNATE_KEY_NOT_ACTIVE"), ("WARNING", "TARGET_HAS_DATA_CREATE_ONLY"), ("INFO", "SOURCE_EMPTY"), ("WARNING", "SERVER_SIDE_LOGIC"), ("BLOCKER", "DEPENDENCY_MISSING_IN_TARGET"),
        ("BLOCKER", "BUSINESS_LOGIC_BYPASS"), ("WARNING", "FLOW_TRIGGERS_SUPPRESSED"), ("BLOCKER", "PRINCIPALS_AMBIGUOUS"), ("BLOCKER", "FALLBACK_NOT_CONFIGURED"), ("WARNING", "AUDIT_IMPERSONATION"), ("INFO", "OWNERSHIP_NOT_APPLICABLE"), ("WARNING", "CREATED_ON_NOT_PRESERVABLE"), ("WARNING", "MODIFIED_BY_NOT_PRESERVABLE"),
    }
    assert issues.plan_issues([]) == [("BLOCKER", "NO_TABLES_SELECTED", None, None)] and not issues.can_run([("BLOCKER", "X", None, None)])
    own = issues.plan_issues([issues.PlanTable("t", s, d, mapping, match="BUSINESS_KEY", business_key=("name",), choices={"kind": issues.Choice({})}), issues.PlanTable("u", None, d), issues.PlanTable("v", s, None)], issues.Options("SYNC"))
    assert {b for _, b, _, _ in own} >= {"PRIMARY_KEY_MISMATCH", "BUSINESS_KEY_UNIQUENESS", "CHOICE_MAPPING_MISSING", "TABLE_MISSING_IN_SOURCE", "TABLE_MISSING_IN_TARGET", "SYNC_STRATEGY"}


def test_verdicts(spark):
    rows = lambda *r: spark.createDataFrame(r, "code string, object string, severity string, overridable boolean")
    none = spark.createDataFrame([], "code string, object string")
    one = lambda *r, o=none: findings.verdict(rows(*r), o).first().verdict
    assert one(("A", "t", "INFORMATION", True)) == "READY" and one(("A", "t", "WARNING", True)) == "READY_WITH_WARNINGS"
    assert one(("A", "t", "BLOCKER", False)) == "BLOCKED" and one(("A", "t", "BLOCKER", True), o=spark.createDataFrame([("A", "u")], "code string, object string")) == "BLOCKED_PENDING_OVERRIDE"
    assert one(("A", None, "BLOCKER", True), o=spark.createDataFrame([("A", None)], "code string, object string")) == "READY"
