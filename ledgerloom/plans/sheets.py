"""Schemas and mappings as rows: joined, and as they come back in a workbook."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import js_trim
from .metadata import Table, field_rows

#: Rows that a sheet of mappings has at most.
MOST_ROWS = 20_000
IGNORE = "IGNORE"


def import_mappings(sheet: DataFrame, mappings: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """table_name, field, was, wanted, action of each row of ``sheet`` (table_name, field, target).

    ``mappings`` (table_name, field, target, status) is the plan as it is. Names meet whatever
    their case. UNCHANGED, MAP, REMAP or IGNORE; rows that the plan knows nothing of are
    UNKNOWN_TABLE or UNKNOWN_COLUMN. A sheet of more than ``most`` rows is refused.
    """
    if sheet.limit(most + 1).count() > most:
        raise ValueError(f"the sheet has more than {most} rows")
    low = lambda c: F.lower(js_trim(F.col(c)))
    rows = sheet.select("table_name", "field", F.nullif(js_trim("target"), F.lit("")).alias("wanted"), low("table_name").alias("_t"), low("field").alias("_f"))
    plan = mappings.select(low("table_name").alias("_t"), low("field").alias("_f"), F.when(F.col("status") == "IGNORED", IGNORE).otherwise(F.col("target")).alias("was"), F.lit(True).alias("_known"))
    tables = plan.select("_t", F.lit(True).alias("_there")).distinct()
    both = rows.join(plan, ["_t", "_f"], "left").join(tables, "_t", "left")
    wants = F.when(F.upper("wanted") == IGNORE, IGNORE).otherwise(F.col("wanted"))
    action = (
        F.when(F.col("_there").isNull(), "UNKNOWN_TABLE").when(F.col("_known").isNull(), "UNKNOWN_COLUMN").when(F.col("was").eqNullSafe(wants), "UNCHANGED")
        .when(wants == IGNORE, "IGNORE").when(F.col("was").isNotNull() & wants.isNotNull(), "REMAP").otherwise("MAP")
    )
    return both.select("table_name", "field", "was", wants.alias("wanted"), action.alias("action"))


def join_schemas(spark: SparkSession, source: Iterable[Table], target: Iterable[Table]) -> DataFrame:
    """table_name, column_name, source_type, target_type, in_source, in_target of every column of either side, names in lower case."""
    rows = lambda side, tables: spark.createDataFrame(field_rows(tables), f"table_name string, column_name string, {side}_type string")
    both = rows("source", source).join(rows("target", target), ["table_name", "column_name"], "full")
    return both.withColumns({"in_source": F.col("source_type").isNotNull(), "in_target": F.col("target_type").isNotNull()})


def applied(mappings: DataFrame, changes: DataFrame) -> DataFrame:
    """``mappings`` (table_name, field, target, status) with the changes of import_mappings() made."""
    done = changes.where("action in ('MAP', 'REMAP', 'IGNORE')").select(F.lower("table_name").alias("_t"), F.lower("field").alias("_f"), "wanted", "action")
    both = mappings.join(done, (F.lower("table_name") == F.col("_t")) & (F.lower("field") == F.col("_f")), "left")
    status = F.when(F.col("action").isNull(), F.col("status")).when(F.col("action") == "IGNORE", "IGNORED").when(F.col("wanted").isNull(), "UNMAPPED").otherwise("MANUAL")
    target = F.when(F.col("action").isNull(), F.col("target")).when(F.col("action") != "IGNORE", F.col("wanted"))
    return both.select("table_name", "field", target.alias("target"), status.alias("status"))
