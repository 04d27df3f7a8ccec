"""Previews of a column that add up: sketches of parts, merged without the rows, with their error stated.

A profile's counts are exact and read all rows again. A part's sketches are a few kB a column, can be
kept beside it, and merge in any order; what they say is labelled APPROXIMATE.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import as_text, kind_of, profilable

#: log2 of the registers of a distinct count; the size parameter of quantiles; values that a top list tracks.
LG_K, KLL_K, TRACKED = 14, 400, 3000
#: Three standard errors of a distinct count; the rank error of a quantile (99 of 100); how far a count may be off, of all rows.
DISTINCT_ERROR = 3 * 1.04 / math.sqrt(1 << LG_K)
RANK_ERROR = 0.0075
COUNT_ERROR = 3.5 / (1 << math.ceil(math.log2(TRACKED / 0.75)))
TOP = 10


def partials(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """field, rows, filled and the sketches of each column: one pass, each task's added up before the shuffle."""
    names = profilable(df, columns)
    number = lambda n: F.col(f"`{n}`").cast("double") if kind_of(df.schema[n].dataType) == "number" else F.lit(None).cast("double")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), as_text(df, n).alias("value"), number(n).alias("n")) for n in names])).alias("c")).select("c.*")
    return cells.groupBy("field").agg(
        F.count("*").alias("rows"), F.count("value").alias("filled"), F.hll_sketch_agg("value", LG_K).alias("distinct_sketch"), F.kll_sketch_agg_double("n", KLL_K).alias("quantile_sketch"),
        F.expr(f"approx_top_k_accumulate(value, {TRACKED})").alias("top_sketch"),
    )


def merged(parts: DataFrame, by: Sequence[str] = ("field",)) -> DataFrame:
    """Sketches of parts, of any tables or days, as those of all their rows."""
    return parts.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
        F.expr("approx_top_k_combine(top_sketch)").alias("top_sketch"),
    )


def preview(sketches: DataFrame) -> DataFrame:
    """What the sketches say: distinct values, the 5th, 50th and 95th percentile of numbers, the most frequent values, each with its error, and the basis APPROXIMATE."""
    numbers = F.kll_sketch_get_n_double("quantile_sketch")
    at = lambda q: F.when(numbers > 0, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(q)))
    keep = [c for c in sketches.columns if not c.endswith("_sketch")]
    return sketches.select(
        *keep, F.hll_sketch_estimate("distinct_sketch").alias("distinct_about"), F.ceil(F.hll_sketch_estimate("distinct_sketch") * DISTINCT_ERROR).alias("distinct_error"), at(0.05).alias("p05"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.lit(RANK_ERROR).alias("rank_error"),
        F.slice(F.filter(F.expr(f"approx_top_k_estimate(top_sketch, {TOP + 1})"), lambda x: x["item"].isNotNull()), 1, TOP).alias("top_values"), F.ceil(F.col("filled") * COUNT_ERROR).alias("count_error"), F.lit("APPROXIMATE").alias("basis"),
    )
