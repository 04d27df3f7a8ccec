"""Relationships between tables: candidates by name, proof by values."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import kind_of

LEAST_COVERAGE, INFERRED_COVERAGE, LEAST_UNIQUE = 0.5, 0.98, 0.99


def affinity(child: str, parent_table: str, parent: str) -> float:
    """1 for the same bare name, 0.8 where the child names the parent table, else 0."""
    bare = lambda n: re.sub(r"[^a-z0-9]", "", re.sub(r"^[a-z]{1,2}_", "", n.lower()))
    c, p, t = bare(child), bare(parent), bare(parent_table).rstrip("s")
    if c == p:
        return 1.0
    return 0.8 if t and c.startswith(t) and re.search(r"(id|key|code|no|number|ref)\Z", c) else 0.0


#: Up to so many candidates are broadcast (some 10 MB); beyond, values are shuffled to meet them.
MOST_BROADCAST = 50_000


def candidates(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, str, float]]:
    """(child table, child column, parent table, parent column, affinity) of like kinds, over schemas only."""
    out = []
    for ct, cdf in tables.items():
        for cf in cdf.schema:
            for pt, pdf in tables.items():
                for pf in pdf.schema:
                    a = affinity(cf.name, pt, pf.name)
                    if ct != pt and a and kind_of(cf.dataType) == kind_of(pf.dataType) != "other":
                        out.append((ct, cf.name, pt, pf.name, a))
    return out


def overlap(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """child_values, covered_values, child_records, orphan_records, coverage, parent_unique of one candidate.

    Values meet as distinct ones with their counts, so hot values cost one row each.
    """
    c = child.where(F.col(f"`{child_column}`").isNotNull()).groupBy(F.col(f"`{child_column}`").cast("string").alias("v")).agg(F.count("*").alias("n"))
    p = parent.where(F.col(f"`{parent_column}`").isNotNull()).groupBy(F.col(f"`{parent_column}`").cast("string").alias("v")).agg(F.count("*").alias("m"))
    both = c.join(p, "v", "full").agg(
        F.count("n").alias("child_values"), F.count_if(F.col("n").isNotNull() & F.col("m").isNotNull()).alias("covered_values"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("child_records"), F.coalesce(F.sum(F.when(F.col("m").isNull(), F.col("n"))), F.lit(0)).alias("orphan_records"),
        F.count("m").alias("parent_values"), F.coalesce(F.sum("m"), F.lit(0)).alias("parent_records"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6)).otherwise(0.0)
    return both.select("child_values", "covered_values", "child_records", "orphan_records", share("covered_values", "child_values").alias("coverage"), share("parent_values", "parent_records").alias("parent_unique"))


def _value_counts(tables: dict[str, DataFrame], columns: set[tuple[str, str]]) -> DataFrame:
    """t, c, v, n: how often each value of the columns occurs; each table is read once."""
    out = None
    for name in sorted({t for t, _ in columns}):
        cells = F.explode(F.array(*[F.struct(F.lit(name).alias("t"), F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for t, c in sorted(columns) if t == name]))
        own = tables[name].select(cells.alias("x")).select("x.*")
        out = own if out is None else out.unionAll(own)
    return out.groupBy("t", "c", "v").agg(F.count("*").alias("n"))


def discover(tables: dict[str, DataFrame], declared: Sequence[tuple[str, str, str, str]] = (), parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """child_table, child_column, parent_table, parent_column, verdict and the facts of each candidate that holds.

    References into a table that ``parents`` names are looked up in its rows there. A parent
    has two values or more, none blank and next to none repeated. The values of each column
    are counted once, whatever it is a candidate for.
    """
    spark, found = next(iter(tables.values())).sparkSession, candidates(tables)
    cand = spark.createDataFrame([(i, *x, x[:4] in declared) for i, x in enumerate(found)], "i int, child_table string, child_column string, parent_table string, parent_column string, affinity double, known boolean")
    if not found:
        return cand.select("child_table", "child_column", "parent_table", "parent_column", F.lit("").alias("verdict"), F.lit(0.0).alias("coverage"), F.lit(0).cast("long").alias("orphan_records"), F.lit(0).cast("long").alias("child_records"))
    few = F.broadcast(cand) if len(found) <= MOST_BROADCAST else cand  # a row for each pair of columns with like names
    of = lambda side, values: values.join(few, (F.col("t") == F.col(f"{side}_table")) & (F.col("c") == F.col(f"{side}_column")))
    child = of("child", _value_counts(tables, {x[:2] for x in found})).where("v is not null").select("i", "v", "n")
    parent = of("parent", _value_counts(tables | (parents or {}), {x[2:4] for x in found}))
    blank = F.coalesce(F.trim("v"), F.lit("")) == ""
    parent = parent.select("i", F.coalesce("v", F.lit("")).alias("v"), F.col("n").alias("m"), blank.alias("blank"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    facts = child.join(parent, ["i", "v"], "full").groupBy("i").agg(
        F.count("n").alias("child_values"), F.count_if(F.col("n").isNotNull() & F.col("m").isNotNull()).alias("covered"), total("n").alias("child_records"),
        total(F.when(F.col("m").isNull(), F.col("n"))).alias("orphan_records"), F.count("m").alias("parent_values"), total("m").alias("parent_records"), F.count_if("blank").alias("blanks"),
    )
    c = F.col
    out = facts.withColumn("coverage", F.when(c("child_values") > 0, F.round(c("covered") / F.greatest(c("child_values"), F.lit(1)), 6)).otherwise(0.0)).join(few, "i")
    fits = (c("parent_values") >= LEAST_UNIQUE * c("parent_records")) & (c("parent_values") >= 2) & (c("blanks") == 0) & (c("coverage") >= LEAST_COVERAGE)
    verdict = F.when(c("known"), "DECLARED").when((c("coverage") >= INFERRED_COVERAGE) & (c("affinity") >= 0.8), "INFERRED").otherwise("POSSIBLE")
    return out.where(fits | c("known")).select("child_table", "child_column", "parent_table", "parent_column", verdict.alias("verdict"), "coverage", "orphan_records", "child_records")


def broken_references(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """The rows of ``child`` whose reference isn't null and leads nowhere."""
    p = parent.select(F.col(f"`{parent_column}`").alias("_p"))
    return child.where(F.col(f"`{child_column}`").isNotNull()).join(p, F.col(f"`{child_column}`") == F.col("_p"), "left_anti")


def duplicate_keys(df: DataFrame, key: Sequence[str], row_id: str | None = None, most: int = 1000, samples: int = 20) -> DataFrame:
    """The key columns, count (and least row ids): groups of complete keys held more than once, largest first."""
    from pyspark.sql.window import Window

    complete = df
    for k in key:
        complete = complete.where(F.col(f"`{k}`").isNotNull())
    groups = complete.groupBy(*key).agg(F.count("*").alias("count")).where("count > 1").orderBy(F.desc("count"), *key).limit(most)
    if row_id is None:
        return groups
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(row_id))
    few = complete.join(F.broadcast(groups.select(*key)), list(key)).withColumn("_rank", rank).where(F.col("_rank") <= samples)  # ``most`` rows
    return groups.join(few.groupBy(*key).agg(F.array_sort(F.collect_list(F.col(row_id).cast("string"))).alias("row_ids")), list(key), "left")
