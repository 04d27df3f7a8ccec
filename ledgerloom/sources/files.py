"""Files: delimited text, XML and workbooks, with headers found rather than assumed."""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank
from ..operators.infer import unique_headers
from ..session import ship_package

HEADER_ROWS, MOST_INFLATED, MOST_COLUMNS, MOST_DEPTH = 20, 256 << 20, 300, 4


def sniff_delimiter(line: str) -> str:
    """The most frequent of comma, semicolon and tab outside quotes in a first line."""
    bare = re.sub(r'"[^"]*"', "", line.lstrip("\ufeff"))
    return max((",", ";", "\t"), key=bare.count)


def refuse(head: str) -> None:
    """Refuses what isn't a table: JSON, HTML and PDF, by how it begins."""
    start = head.lstrip("\ufeff \t\r\n")[:64].lower()
    for mark, name in (("{", "JSON"), ("[", "JSON"), ("<!doctype html", "HTML"), ("<html", "HTML"), ("%pdf", "PDF")):
        if start.startswith(mark):
            raise ValueError(f"{name} isn't read as a table")


def find_header(rows: list[list[str | None]]) -> int:
    """The first of the rows with two or more filled cells, else with one; else 0."""
    filled = [sum(bool((c or "").strip()) for c in r) for r in rows[:HEADER_ROWS]]
    return next((i for i, n in enumerate(filled) if n >= 2), next((i for i, n in enumerate(filled) if n == 1), 0))


def drop_blank_rows(df: DataFrame) -> DataFrame:
    return df.where(F.exists(F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns]), lambda c: ~is_blank(c)))


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell goes over several lines, which leaves lines with an odd number of quotes."""
    return not spark.read.text(path).where(F.regexp_count("value", F.lit('"')) % 2 == 1).isEmpty()


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, headers made unique, blank rows left out. Only the first line is read on the driver.

    Files are split among tasks, unless a cell holds a line break; then each is read by one.
    """
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    refuse(line)
    df = spark.read.csv(path, sep=sniff_delimiter(line), header=True, multiLine=has_line_breaks(spark, path), escape='"', encoding="UTF-8")
    return drop_blank_rows(df.toDF(*unique_headers([c.lstrip("\ufeff") if not re.fullmatch(r"_c\d+", c) else None for c in df.columns])))


def prepare_sheet(rows: DataFrame, order: str, cells: str = "cells") -> tuple[DataFrame, dict]:
    """A table from rows of an array of texts in the order of a column, and a report of what was done.

    Rows above the header, blank rows and columns beyond the last named one go; unnamed columns
    within are numbered, repeated names suffixed.
    """
    head = [list(r[0] or []) for r in rows.orderBy(order).select(cells).limit(HEADER_ROWS).collect()]
    at = find_header(head)
    header = head[at] if head else []
    width = max((i + 1 for i, h in enumerate(header) if (h or "").strip()), default=0)
    names = unique_headers(header[:width])
    if len(names) > MOST_COLUMNS:
        raise ValueError("too many columns")
    start = rows.orderBy(order).limit(at + 1).agg(F.max(order)).first()[0]
    data = rows.where(F.col(order) > F.lit(start)) if head else rows
    out = data.select(*[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)]) if names else data.select()
    filled = drop_blank_rows(out) if names else out
    total, kept = data.count(), filled.count()
    return filled, {"header_row": at, "columns": len(names), "unnamed": sum(not (h or "").strip() for h in header[:width]), "blank_rows": total - kept, "rows": kept}


def record_tag(xml: str) -> str:
    """The element whose repeats are the records: the shallowest that repeats under one parent, then the one with most."""
    root = ElementTree.fromstring(xml)
    level = [root]
    while level:
        counts = Counter()
        for parent in level:
            own = Counter(c.tag for c in parent)
            counts.update({t: n for t, n in own.items() if n > 1})
        if counts:
            return max(sorted(counts), key=counts.__getitem__)
        level = [c for p in level for c in p]
    raise ValueError("no repeated element")


def flatten(df: DataFrame) -> DataFrame:
    """Nested fields as dotted columns, repeats joined with '; ', to a depth of four."""
    def walk(t: T.DataType, c, name: str, depth: int) -> list:
        if isinstance(t, T.StructType) and depth < MOST_DEPTH:
            return [x for f in t for x in walk(f.dataType, c[f.name], f"{name}.{f.name}" if name else f.name, depth + 1)]
        if isinstance(t, T.ArrayType):
            text = F.transform(c, lambda x: F.to_json(x) if isinstance(t.elementType, T.StructType) else x.cast("string"))
            return [F.array_join(text, "; ").alias(name)]
        return [(F.to_json(c) if isinstance(t, (T.StructType, T.MapType)) else c.cast("string")).alias(name)]

    columns = [x for f in df.schema for x in walk(f.dataType, F.col(f"`{f.name}`"), f.name, 0)]
    if len(columns) > MOST_COLUMNS:
        raise ValueError("too many columns")
    return df.select(*columns)


def record_paths(spark: SparkSession, path: str) -> DataFrame:
    """depth, tag, records: how often each element repeats under one parent, over all documents under a path.

    Each document is read on the task that has it, element by element; what is behind is forgotten, so
    only the open elements and their counts are held. Type declarations are refused (depth -1).
    """

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                content = data.as_py()
                found: Counter = Counter()
                if b"<!DOCTYPE" in content or b"<!ENTITY" in content:
                    found[-1, ""] = 1
                else:
                    open_counts: list[Counter] = []
                    for event, element in ElementTree.iterparse(io.BytesIO(content), ("start", "end")):
                        if event == "start":
                            if open_counts:
                                open_counts[-1][element.tag] += 1
                            open_counts.append(Counter())
                        else:
                            for tag, n in open_counts.pop().items():
                                if n > 1:
                                    found[len(open_counts), tag] += n
                            element.clear()
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int32()), pa.array([t for _, t in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["depth", "tag", "n"])

    ship_package(spark)
    told = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content").mapInArrow(paths, "depth int, tag string, n long")
    return told.groupBy("depth", "tag").agg(F.sum("n").alias("records"))


def find_record_tag(spark: SparkSession, path: str) -> str:
    """The element whose repeats are the records: the shallowest that repeats under one parent, then the one with most, in all documents together."""
    first = record_paths(spark, path).orderBy("depth", F.desc("records"), "tag").first()
    if first is None:
        raise ValueError("no repeated element")
    if first["depth"] < 0:
        raise ValueError("a document with a type declaration isn't read")
    return first["tag"].split("}")[-1]


def read_xml(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """Records of an element, found if it isn't named, as flat text columns; attributes are named with '@'."""
    return flatten(spark.read.format("xml").option("rowTag", tag or find_record_tag(spark, path)).option("attributePrefix", "@").option("inferSchema", "false").load(path))


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Rows of a sheet that are held at a time.
SHEET_ROWS = 2000


def _elements(source, tag: str) -> Iterator[ElementTree.Element]:
    """Each element of a tag as soon as it is closed; it is emptied, and forgotten by its parent, before the next."""
    above: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(source, ("start", "end")):
        if event == "start":
            above.append(element)
            continue
        above.pop()
        if element.tag == _NS + tag:
            yield element
            (above[-1] if above else element).clear()


def workbook_rows(data: bytes, sheet: int = 1) -> Iterator[list[str | None]]:
    """The cells of one sheet of a workbook as text, a row at a time; the texts that cells share are held."""

    def text_of(e: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in e.iter(f"{_NS}t"))

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > MOST_INFLATED:
            raise ValueError("the workbook is too large")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as part:
                shared = [text_of(s) for s in _elements(part, "si")]
        with z.open(f"xl/worksheets/sheet{sheet}.xml") as part:
            for row in _elements(part, "row"):
                cells: list[str | None] = []
                for c in row.iterfind(f"{_NS}c"):
                    at = 0
                    for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                        at = at * 26 + ord(ch) - 64
                    cells += [None] * (max(at, 1) - 1 - len(cells))
                    value = c.find(f"{_NS}v")
                    if c.get("t") == "inlineStr":
                        cells.append(text_of(c))
                    else:
                        cells.append(None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text)
                yield cells


def read_xlsx(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """One sheet of each workbook under a path as text columns, named by their common header.

    A workbook is one zipped file of bounded size, which can only be read from its beginning: a task
    reads each, SHEET_ROWS rows at a time, and only headers reach the driver.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, place = workbook_rows(data.as_py(), sheet), 0
                head = list(islice(rows, HEADER_ROWS))
                left = chain(head[find_header(head) :], rows)
                while own := list(islice(left, SHEET_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(range(place, place + len(own)), pa.int64()), pa.array(own, pa.list_(pa.string()))], ["path", "place", "cells"])
                    place += len(own)

    cells = files.mapInArrow(parse, "path string, place long, cells array<string>")
    headers = [r[0] for r in cells.where("place = 0").select("cells").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError("the workbooks have different headers")
    header = headers[0] if headers else []
    width = max((i + 1 for i, h in enumerate(header) if (h or "").strip()), default=0)
    names = unique_headers(header[:width]) if width else ["column_1"]
    return drop_blank_rows(cells.where("place > 0").select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)]))


def staged(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows with an ordinal, from 0 without gaps in the order they are read, and a record id: the key's value, else the ordinal.

    Rows are counted first, a number for each task, so none moves.
    """
    own = df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    counts = sorted((r["_part"], r["count"]) for r in own.groupBy("_part").count().collect())  # a row for each task
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    before = F.broadcast(df.sparkSession.createDataFrame(starts, "_part int, _before long"))
    ordinal = F.col("_at") + F.col("_before")
    ident = F.nullif(F.col(f"`{key}`").cast("string"), F.lit("")) if key else F.lit(None).cast("string")
    out = own.join(before, "_part").withColumn("_ordinal", ordinal).withColumn("_id", F.coalesce(ident, ordinal.cast("string")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "_ordinal", "_id")
