"""Column profiles: one pass of aggregates over a table, and one long-format count of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import BOOLEAN_WORDS, EMAIL_SHAPE, GUID, PROFILE_BOOLEANS, decimal_places, decimal_separator, is_blank, js_trim, percent, round_half_up, shape_of, to_instant, to_number
from ..session import spread

TOP_VALUES, EXAMPLES, MASK = 50, 5, "***"
SHAPES = ("NUMBER", "CURRENCY", "BOOLEAN", "DATE", "TEXT")


def kind_of(t: T.DataType) -> str:
    """text, number, datetime, boolean or other: how a column of this type is read."""
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "boolean" if isinstance(t, T.BooleanType) else "other"


#: Columns that a system keeps itself.
SYSTEM_COLUMNS = ("createdon", "modifiedon", "createdby", "modifiedby", "versionnumber", "importsequencenumber", "overriddencreatedon", "timezoneruleversionnumber", "utcconversiontimezonecode")


def profilable(df: DataFrame, columns: Sequence[str] | None = None, system: bool = True) -> list[str]:
    """Columns to profile: an explicit list wins; binary and nested ones are left out, and without ``system`` those that a system keeps."""
    if columns is not None:
        return [c for c in columns if c in df.columns]
    return [f.name for f in df.schema if kind_of(f.dataType) != "other" and (system or f.name.lower() not in SYSTEM_COLUMNS)]


def as_text(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def _columns(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in dict.fromkeys(names)]


#: Numbers are added up exactly in billionths; a mean is rounded once, at six places.
BILLION, EXACT = 10**9, "decimal(38,0)"
_CELL = "i int, there boolean, n double, at timestamp_ntz, text string"


def _cells(df: DataFrame, names: Sequence[str], kinds: Sequence[str], reads: Sequence[str]) -> DataFrame:
    """A row for each cell: its column's number, whether it is there, and its value as a number, a time, or the text that has to be read."""

    def cell(i: int, n: str, k: str, r: str) -> Column:
        v, plain = F.col(f"`{n}`"), k == r and k != "text"
        parts = {"n": v if plain and k == "number" else None, "at": v if plain and k == "datetime" else None, "text": None if plain else v}
        kinds_of = dict(x.split(" ", 1) for x in _CELL.split(", "))
        return F.struct(F.lit(i).alias("i"), v.isNotNull().alias("there"), *[(F.lit(None) if x is None else x).cast(kinds_of[c]).alias(c) for c, x in parts.items()])

    return df.select(F.explode(F.array(*[cell(i, *c) for i, c in enumerate(zip(names, kinds, reads, strict=True))])).alias("c")).select("c.*")


def _billionths(n: Column) -> Column:
    """A number in whole billionths; null if it is too great. Those that a long holds need no decimal arithmetic."""
    small = F.rint(n * float(BILLION)).cast("bigint").cast(EXACT)
    return F.when(F.abs(n) < 9e9, small).otherwise(F.try_multiply(n.try_cast("decimal(28,9)"), F.lit(BILLION).cast("decimal(10,0)")).cast(EXACT))


def _told(values: DataFrame) -> DataFrame:
    """Values of all columns (i, is_text, reads, text, ...) with what is told of each: texts are trimmed once, then shaped once, in projections of their own."""
    c = F.col
    is_a = lambda r: c("reads") == r
    own = values.withColumn("t", F.when(c("is_text"), js_trim(c("text"))).otherwise(c("text")))
    own = own.withColumn("shape", F.when(c("is_text"), shape_of(c("t"), True)))
    amount = c("shape").isin("NUMBER", "CURRENCY")
    own = own.withColumn("mark", F.when(amount, decimal_separator(c("t"))))
    number, instant = F.when(is_a("number") & c("is_text"), to_number(c("t"), True)), F.when(is_a("datetime") & c("is_text"), to_instant(c("t"), True))
    own = own.withColumns({"places": F.when(amount, decimal_places(c("t"), c("mark"))), "number": number, "instant": instant, "filled": c("t").isNotNull() & (~c("is_text") | (c("t") != ""))})
    t = c("t")
    bad = (
        F.when(is_a("number"), c("number").isNull()).when(is_a("datetime"), c("instant").isNull()).when(is_a("boolean"), ~F.lower(t).isin(PROFILE_BOOLEANS))
        .when(is_a("guid"), ~t.rlike(GUID)).when(is_a("email"), ~t.rlike(EMAIL_SHAPE)).otherwise(False)
    )
    spelling = F.when(c("shape") == "BOOLEAN", F.array_position(F.array(*map(F.lit, BOOLEAN_WORDS)), F.lower(t)).cast("int"))
    return own.withColumns({"bad": c("filled") & bad, "spelling": spelling, "length": F.when(c("is_text"), F.length("text")).cast("long")})


def column_stats(df: DataFrame, columns: Sequence[str] | None = None, reads_as: dict[str, str] | None = None) -> DataFrame:
    """A row of one-pass statistics for each column: counts, lengths, ranges, invalid values, shapes.

    ``reads_as`` overrides what a column's values should be: number, datetime, boolean,
    guid, email or text; by default what its type says. Only text can be blank or spell
    something wrongly. The whole table is read once, a cell a row. Numbers and times are added up by
    column, texts counted by value, in each task first; then each different text is read once,
    however often it occurs. So a plan is as long for one column as for hundreds. Means are those
    of exact sums, unless a number is too great for one.
    """
    names = profilable(df, columns)
    kinds = [kind_of(df.schema[n].dataType) for n in names]
    reads = [(reads_as or {}).get(n, k) for n, k in zip(names, kinds, strict=True)]
    c, spark = F.col, df.sparkSession
    every = spark.createDataFrame([(i, n, k == "text", r) for i, (n, k, r) in enumerate(zip(names, kinds, reads, strict=True))], "i int, field string, is_text boolean, reads string")
    cells = _cells(spread(df.select(*_columns(names))), names, kinds, reads) if names else spark.createDataFrame([], _CELL)
    cells = cells.withColumn("units", _billionths(c("n")))
    values = cells.groupBy("i", "there", "text").agg(F.count("*").alias("cells"), F.min("n").alias("low"), F.max("n").alias("high"), F.count("n").alias("numbers"), F.sum("n").alias("about"), F.count("units").alias("exacts"), F.try_sum("units").alias("units"), F.min("at").alias("first"), F.max("at").alias("last"))
    told = _told(values.join(F.broadcast(every), "i"))  # a row for each column
    n = c("cells")
    total = lambda cond: F.sum(F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0))
    one = c("number").isNotNull()  # a text that spells a number, as often as it occurs
    spelt = F.try_multiply(_billionths(c("number")).try_cast("decimal(27,0)"), n.cast("decimal(11,0)")).cast(EXACT)
    exact, numbers = F.try_sum(F.when(one, spelt).otherwise(c("units"))), F.sum(F.when(one, n).otherwise(c("numbers")))
    whole = F.sum(F.when(one, F.when(spelt.isNotNull(), n).otherwise(0)).otherwise(c("exacts"))) == numbers
    about = F.sum(F.when(one, c("number") * n).otherwise(c("about")))
    mean = F.when(whole & exact.isNotNull(), exact.cast("double") / float(BILLION)).otherwise(about) / F.nullif(numbers, F.lit(0))
    counts = {
        "examined": F.sum(n), "null_count": total(~c("there")), "blank_count": total(c("is_text") & (c("t") == "")), "whitespace_count": total(c("is_text") & c("filled") & (c("t") != c("text"))),
        "min_length": F.min("length").cast("int"), "max_length": F.max("length").cast("int"), "avg_length": round_half_up(F.sum(c("length") * n) / F.nullif(F.sum(F.when(c("length").isNotNull(), n)), F.lit(0)), 1),
        "min_number": F.min(F.coalesce("number", "low")), "max_number": F.max(F.coalesce("number", "high")), "avg_number": round_half_up(mean, 6),
        "max_scale": F.max(F.when(c("reads") == "number", c("places"))), "min_date": F.min(F.coalesce("instant", "first")), "max_date": F.max(F.coalesce("instant", "last")), "invalid_count": total(c("bad")), "invalid_date_count": total(c("bad") & (c("reads") == "datetime")),
        "max_decimals": F.max("places"), "over_two_decimals": total(c("places") > 2), "decimal_marks": F.max(F.when(c("mark") == ".", 1).otherwise(0)) + F.max(F.when(c("mark") == ",", 1).otherwise(0)),
        "boolean_spellings": F.bit_count(F.coalesce(F.bit_or(F.pow(F.lit(2), c("spelling")).cast("int")), F.lit(0))), **{f"{s.lower()}_shapes": total(c("shape") == s) for s in SHAPES},
    }
    out = every.join(F.broadcast(told.groupBy("i").agg(*[v.alias(k) for k, v in counts.items()])), "i", "left")  # a row for each column
    zeros = [k for k in counts if k == "examined" or k.endswith(("_count", "_shapes", "_marks", "_spellings")) or k == "over_two_decimals"]
    return out.fillna(0, zeros).orderBy("i").select("field", *counts, percent(c("null_count"), c("examined")).alias("null_percent"))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, row_id: str | None = None) -> DataFrame:
    """field, value, count (and up to EXAMPLES row ids): how often each value that isn't null occurs.

    Long format: one shuffle for all columns, reduced on the map side. Row ids are kept as
    the least few, in an array that never grows past them.
    """
    names = profilable(df, columns)
    df = spread(df.select(*_columns(names + [row_id] * bool(row_id))))
    entry = lambda n: F.struct(F.lit(n).alias("field"), as_text(df, n).alias("value"))
    cells = F.explode(F.array(*[entry(n) for n in names]))
    long = df.select(cells.alias("c"), *([F.col(f"`{row_id}`").cast("string").alias("row_id")] if row_id else [])).select("c.*", *(["row_id"] if row_id else []))
    counted = long.where("value is not null").groupBy("field", "value").agg(F.count("*").alias("count"))
    if not row_id:
        return counted
    repeated = counted.where("count > 1").select("field", "value")
    rank = F.row_number().over(Window.partitionBy("field", "value").orderBy("row_id"))
    few = long.join(repeated, ["field", "value"]).withColumn("rank", rank).where(F.col("rank") <= EXAMPLES)
    ids = few.groupBy("field", "value").agg(F.array_sort(F.collect_list("row_id")).alias("row_ids"))
    return counted.join(ids, ["field", "value"], "left")


def duplication(counts: DataFrame) -> DataFrame:
    """field, distinct_count (exact at any size; blank is a value), duplicate_count, and groups of equal values that aren't blank."""
    filled = ~is_blank(F.col("value"))
    groups = counts.groupBy("field").agg(
        F.count("*").alias("distinct_count"),
        F.sum("count").alias("filled"),
        F.count_if(filled).alias("distinct_values"),
        F.count_if(filled & (F.col("count") > 1)).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(filled & (F.col("count") > 1), F.col("count"))), F.lit(0)).alias("rows_in_collision"),
        F.coalesce(F.max(F.when(filled, F.col("count"))), F.lit(0)).alias("largest_group"),
    )
    return groups.select("field", "distinct_count", (F.col("filled") - F.col("distinct_count")).alias("duplicate_count"), "distinct_values", "duplicate_groups", "rows_in_collision", "largest_group")


def top_values(counts: DataFrame, most: int = TOP_VALUES, secured: Sequence[str] = ()) -> DataFrame:
    """field, rank, value, count: the most frequent values, ties by value; secured columns masked."""
    by = Window.partitionBy("field").orderBy(F.desc("count"), "value")
    ranked = counts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)  # Spark keeps only the first few of each partition before it shuffles
    return ranked.select("field", "rank", F.when(F.col("field").isin(list(secured)), MASK).otherwise(F.col("value")).alias("value"), "count")


def pk_integrity(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows, missing (a key part is blank), duplicates (rows beyond the first of a complete key)."""
    blank = F.lit(False)
    for k in key:
        blank = blank | is_blank(as_text(df, k))
    groups = df.select(blank.alias("blank"), *[as_text(df, k).alias(f"k{i}") for i, k in enumerate(key)]).groupBy("blank", *[f"k{i}" for i in range(len(key))]).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("blank"), F.col("n"))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.when(~F.col("blank"), F.col("n") - 1)), F.lit(0)).alias("duplicates"))


def profile(df: DataFrame, name: str, columns: Sequence[str] | None = None, reads_as: dict[str, str] | None = None, sample: int | None = None, order_by: str | None = None) -> DataFrame:
    """The full profile: a row for each column, with its basis.

    EXACT over all rows by default; with ``sample``, over the first rows by ``order_by``
    and SAMPLED if the table has more.
    """
    basis = F.lit("EXACT")
    if sample is not None:
        total = df.count()
        df = df.orderBy(order_by or df.columns[0]).limit(sample)
        basis = F.lit("EXACT" if total <= sample else "SAMPLED")
    stats = column_stats(df, columns, reads_as)
    groups = duplication(value_counts(df, columns))
    out = stats.join(groups, "field", "left").withColumn("table_name", F.lit(name)).withColumn("basis", basis)
    # only fields without any value have no counts
    return out.fillna(0, ["distinct_count"]).select("table_name", *[c for c in out.columns if c != "table_name"])


def analysis_totals(profiles: DataFrame) -> DataFrame:
    """tables, columns, examined, empty_tables, unused_columns over profile() rows of any tables; a column without a value is unused."""
    by_table = profiles.groupBy("table_name").agg(F.count("*").alias("columns"), F.max("examined").alias("examined"), F.count_if((F.col("examined") > 0) & (F.col("null_count") + F.col("blank_count") >= F.col("examined"))).alias("unused"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by_table.agg(F.count("*").alias("tables"), total("columns").alias("columns"), total("examined").alias("examined"), F.count_if(F.col("examined") == 0).alias("empty_tables"), total("unused").alias("unused_columns"))
