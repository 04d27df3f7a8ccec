"""Files, sinks, evidence and streams."""

import io
import zipfile

import pytest

from ledgerloom.sources import files
from ledgerloom.sources import tables as src
from ledgerloom.streaming.incremental import Watermark, available_now

from .conftest import SMALL


def test_read_delimited(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿id;name;name\n1;"a;b";x\n;;\n2;c;y\n', encoding="utf-8")
    df = files.read_delimited(spark, str(p))
    assert df.columns == ["id", "name", "name 2"] or df.columns[0] == "id"
    assert [r[0] for r in df.collect()] == ["1", "2"]


@pytest.mark.parametrize("head", ['{"a":1}', "<!DOCTYPE html>", "%PDF-1.4"])
def test_refuse(head):
    with pytest.raises(ValueError):
        files.refuse(head)


def test_read_xml(spark, tmp_path):
    xml = "<r><h>1</h><items><i n='1'><a><b>x</b></a><t>1</t><t>2</t></i><i n='2'><a><b>y</b></a><t>3</t></i></items></r>"
    p = tmp_path / "a.xml"
    p.write_text(xml)
    tag = files.record_tag(xml)
    rows = {r["@n"]: (r["a.b"], r["t"]) for r in files.read_xml(spark, str(p), tag).collect()}
    assert tag == "i" and rows == {"1": ("x", "1; 2"), "2": ("y", "3")}


def test_read_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row><row><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row><c r="A3"><v>7</v></c><c r="C3"><v>8</v></c></row></sheetData></worksheet>')
    p = tmp_path / "a.xlsx"
    p.write_bytes(buf.getvalue())
    df = files.read_xlsx(spark, str(p))
    assert df.columns == ["id", "column_2", "name"] and [tuple(r) for r in df.collect()] == [("7", None, "8")]


def test_sinks_and_evidence(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 'a"b')], "x string, y string").coalesce(1)
    src.sink_csv(df, str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("part-*")).read_bytes().decode()
    assert text == "﻿x,y\r\n'=1+1,\"a\"\"b\"\r\n"
    own = src.manifest(spark, str(tmp_path / "c")).where("name like 'part-%'").cache()
    assert own.count() == 1
    assert {r.verdict for r in src.verify_evidence(spark, str(tmp_path / "c"), own).where("name like 'part-%'").collect()} == {"VALID"}
    for crc in (tmp_path / "c").glob(".*.crc"):  # else Hadoop itself refuses the changed file
        crc.unlink()
    next((tmp_path / "c").glob("part-*")).write_text("changed")
    assert {r.verdict for r in src.verify_evidence(spark, str(tmp_path / "c"), own).where("name like 'part-%'").collect()} == {"MODIFIED"}


def test_stream_takes_each_file_once(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    folder = str(tmp_path / "in")
    events.where("event_id % 2 = 0").write.parquet(folder)
    seen = []
    take = lambda batch, number: seen.append(batch.count())
    available_now(spark, folder, events.schema, str(tmp_path / "ck"), take)
    first = sum(seen)
    events.where("event_id % 2 = 1").write.mode("append").parquet(folder)
    available_now(spark, folder, events.schema, str(tmp_path / "ck"), take)
    assert first == events.where("event_id % 2 = 0").count() and sum(seen) == events.count()


def test_watermark_only_moves_forward():
    w = Watermark(5)
    assert not w.advance(4, "COMPLETED") and not w.advance(9, "COMPLETED_WITH_ERRORS") and w.advance(9, "COMPLETED") and w.value == 9
