"""Tables: whole, incremental, by id and by field, and what a sink needs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_cell

LINEAGE = ("run_id", "table_name", "source_id", "target_id", "outcome", "match_method", "attempt", "created_at", "updated_at", "error_code", "error_message")
ROWS_A_FILE = 50_000


def scan_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, key: str | None = None) -> DataFrame:
    """The columns that exist, the key first; the scan reads no others."""
    df = spark.read.parquet(path)
    if columns is None:
        return df
    names = list(dict.fromkeys(([key] if key else []) + [c for c in columns if c in df.columns]))
    return df.select(*[F.col(f"`{n}`") for n in names])


def scan_incremental(df: DataFrame, column: str, since: datetime | int | float | str) -> DataFrame:
    """Rows strictly above a watermark; null ones are left out. The filter reaches the scan."""
    if column not in df.columns:
        raise ValueError(f"unknown column {column}")
    return df.where(F.col(f"`{column}`") > F.lit(since).cast(df.schema[column].dataType))


def observe_watermark(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(F.col(f"`{column}`")).alias("watermark"))


def count_records(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("records"))


#: Records that a validation looks at, by depth.
DEPTHS = {"QUICK": 500, "STANDARD": 5000, "FULL": None}


def prefix(df: DataFrame, key: str, depth: str = "QUICK") -> DataFrame:
    """The first records by their key, as many as the depth says: the same ones each time."""
    most = DEPTHS[depth]
    return df if most is None else df.orderBy(F.col(f"`{key}`")).limit(most)


def retrieve_by_ids(df: DataFrame, id_column: str, ids: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Rows with one of the ids (first column of ``ids``); with ``ignore_case``, ids without an exact hit are tried again in lower case."""
    want = ids.select(F.col(ids.columns[0]).cast("string").alias("_want")).distinct()
    own = F.col(f"`{id_column}`").cast("string")
    exact = df.join(want, own == F.col("_want"), "left_semi")
    if not ignore_case:
        return exact
    missed = want.join(df.select(own.alias("_own")), F.col("_want") == F.col("_own"), "left_anti").select(F.lower("_want").alias("_low"))
    # a row is found once, and repeated rows stay repeated
    return exact.unionByName(df.join(want, own == F.col("_want"), "left_anti").join(missed, F.lower(own) == F.col("_low"), "left_semi"))


def find_by_fields(df: DataFrame, criteria: dict[str, object], most: int = 100) -> DataFrame:
    """Rows that equal all criteria, null meaning IS NULL; no criteria, no rows."""
    if not criteria:
        return df.limit(0)
    for c, v in criteria.items():
        df = df.where(F.col(f"`{c}`").isNull() if v is None else F.col(f"`{c}`") == F.lit(v))
    return df.limit(max(1, min(100, most)))


def find_by_alternate_key(df: DataFrame, criteria: dict[str, object]) -> DataFrame:
    """The row with this key, if it is the only one."""
    hits = find_by_fields(df, criteria, 2)
    one = hits.agg(F.count("*").alias("_n"))
    return hits.join(F.broadcast(one)).where("_n = 1").drop("_n")  # at most two rows and one


def value_frequency(df: DataFrame, column: str, most: int = 200) -> DataFrame:
    counts = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "value").limit(most)


def sink_csv(df: DataFrame, path: str) -> None:
    """CSV with a byte-order mark, CRLF and guarded cells: one text line a row, a header in each file."""
    cells = F.concat_ws(",", *[csv_cell(F.col(f"`{c}`").cast("string")) for c in df.columns])
    header = "﻿" + ",".join(df.columns)
    df.select(cells.alias(header)).write.option("header", True).option("quote", "\u0000").option("escapeQuotes", False).option("lineSep", "\r\n").option("sep", "\u0001").csv(path)


def lineage(df: DataFrame) -> DataFrame:
    """The eleven lineage columns, those that are missing as null, ordered by table and source id."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in LINEAGE]).orderBy("table_name", "source_id")


def sink_lineage(df: DataFrame, path: str) -> None:
    lineage(df).write.option("maxRecordsPerFile", ROWS_A_FILE).option("header", True).csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name (its path in the folder), bytes, sha256 of each file under a folder, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/") + "/"
    return files.select(F.replace("path", F.lit(root), F.lit("")).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_evidence(spark: SparkSession, path: str, recorded: DataFrame) -> DataFrame:
    """name, verdict: VALID, MODIFIED, INCOMPLETE (a file is gone) or UNSUPPORTED (one that isn't recorded)."""
    now = manifest(spark, path).select("name", F.col("sha256").alias("_now"))
    both = recorded.select("name", "sha256").join(now, "name", "full")
    verdict = F.when(F.col("_now").isNull(), "INCOMPLETE").when(F.col("sha256").isNull(), "UNSUPPORTED").when(F.col("sha256") == F.col("_now"), "VALID").otherwise("MODIFIED")
    return both.select("name", verdict.alias("verdict"))
