"""Sketches against exact counts, and records found in XML documents."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import sketches
from ledgerloom.sources import files


def test_sketches_of_parts_keep_their_bounds(spark):
    """Skewed values in four parts: merged sketches say the same as one of all rows, within what they state."""
    n = 60_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit("warm")).otherwise(F.concat(F.lit("v"), F.col("id") % 9000)).alias("v"), F.sqrt(F.col("id").cast("double")).alias("x"), F.col("id"), F.lit(None).cast("string").alias("none"))
    parts = None
    for k in range(4):
        own = sketches.partials(df.where(F.pmod(F.xxhash64("id"), F.lit(4)) == k), ["v", "x", "none"])
        parts = own if parts is None else parts.unionByName(own)
    got = {r.field: r for r in sketches.preview(sketches.merged(parts)).collect()}
    exact = {r.v: r.n for r in df.groupBy("v").agg(F.count("*").alias("n")).collect()}
    v, x = got["v"], got["x"]
    assert (v.rows, v.filled, v.basis, v.p50) == (n, n, "APPROXIMATE", None) and abs(v.distinct_about - len(exact)) <= v.distinct_error < 0.03 * len(exact)
    top = {t.item: t["count"] for t in v.top_values}
    assert {"hot", "warm"} <= set(top) and all(abs(c - exact[i]) <= v.count_error for i, c in top.items())
    for q, value in ((0.05, x.p05), (0.5, x.p50), (0.95, x.p95)):
        assert abs(df.where(F.col("x") <= value).count() / n - q) <= 2 * x.rank_error
    assert (got["none"].filled, got["none"].distinct_about, got["none"].top_values) == (0, 0, [])
    assert sketches.preview(sketches.merged(sketches.partials(df.limit(0), ["v", "x"]))).count() == 0


def test_records_are_found_over_documents(spark, tmp_path):
    """The shallowest repeats win, then the most in all documents together."""
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.xml").write_text("<r><head><n/><n/><n/></head><row id='1'><a>x</a></row><row id='2'><a>y</a></row><foot/><foot/><foot/></r>")
    (tmp_path / "x" / "b.xml").write_text("<r><row id='3'><a>z</a><a>w</a></row><row id='4'/><foot/></r>")
    (tmp_path / "x" / "c.xml").write_text("")
    got = {(r.depth, r.tag): r.records for r in files.record_paths(spark, str(tmp_path / "x")).collect()}
    assert got == {(0, "row"): 4, (0, "foot"): 3, (1, "n"): 3, (1, "a"): 2}
    assert files.find_record_tag(spark, str(tmp_path / "x")) == "row"
    rows = {r["@id"]: r["a"] for r in files.read_xml(spark, str(tmp_path / "x")).collect()}
    assert rows == {"1": "x", "2": "y", "3": "z; w", "4": None} or rows["3"] == "z; w"
    for bad, word in (("<!DOCTYPE r [<!ENTITY e 'x'>]><r><a/><a/></r>", "declaration"), ("<r><a/></r>", "repeated")):
        (tmp_path / "bad.xml").write_text(bad)
        with pytest.raises(ValueError, match=word):
            files.find_record_tag(spark, str(tmp_path / "bad.xml"))


def test_a_sheet_is_read_some_rows_at_a_time(spark, tmp_path):
    """25,000 rows with shared texts: read in order, a few thousand at a time, in little memory."""
    import tracemalloc
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    n = 25_000
    with zipfile.ZipFile(tmp_path / "big.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>na</t><t>me</t></si><si><t>same</t></si></sst>")
        body = "".join(f'<row><c r="A{i}"><v>{i}</v></c><c r="C{i}" t="s"><v>2</v></c></row>' for i in range(n))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>{body}</sheetData></worksheet>')
    df = files.read_xlsx(spark, str(tmp_path / "big.xlsx"))
    assert df.columns == ["id", "column_2", "name"] and df.count() == n
    assert df.agg(F.sum(F.col("id").cast("long")), F.count_distinct("name"), F.count("column_2")).first()[:] == (n * (n - 1) // 2, 1, 0)
    data = (tmp_path / "big.xlsx").read_bytes()
    tracemalloc.start()
    assert sum(1 for _ in files.workbook_rows(data)) == n + 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000_000
