"""Pages of a table by its key: numbered over all tasks, each read from the files that hold it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PAGE = 5000
PART, AT = "_part", "_at"


class Pages:
    """``df`` in the order of a key that no two rows share, in pages of ``size`` rows.

    The table is sorted by ranges and written once by ``save(df, name)``; each task numbers its own
    range, and the driver keeps one count a range. So no task sorts or numbers the whole table, and a
    page is read from the one or two files that hold it.
    """

    def __init__(self, df: DataFrame, key: Sequence[str], size: int, save: Callable[[DataFrame, str], DataFrame]) -> None:
        if not 1 <= size <= MOST_PAGE:
            raise ValueError(f"a page has 1 to {MOST_PAGE} rows")
        self.key, self.size, self.columns = list(key), size, df.columns
        at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        order = [F.asc_nulls_first(F.col(f"`{k}`")) for k in key]
        self.table = save(df.orderBy(*order).select("*", F.spark_partition_id().alias(PART), at.alias(AT)), "pages")
        self.starts: list[tuple[int, int, int]] = []  # a range, its first row's number, its rows
        self.total = 0
        for part, n in sorted((r[PART], r["count"]) for r in self.table.groupBy(PART).count().collect()):
            self.starts.append((part, self.total, n))
            self.total += n

    @property
    def count(self) -> int:
        return -(-self.total // self.size)

    def numbered(self) -> DataFrame:
        """All rows with ``place`` (from 0) and ``page`` (from 1)."""
        spark = self.table.sparkSession
        starts = spark.createDataFrame([s[:2] for s in self.starts], f"{PART} int, _before long")
        place = F.col(AT) + F.col("_before")
        out = self.table.join(F.broadcast(starts), PART)  # a row for each range
        return out.select(*[F.col(f"`{c}`") for c in self.columns], place.alias("place"), F.expr(f"cast(({AT} + _before) div {self.size} + 1 as bigint)").alias("page"))

    def page(self, number: int) -> DataFrame:
        """The rows of a page in order; none beyond the last."""
        low, high = (number - 1) * self.size, number * self.size
        held = [(p, max(0, low - s), min(n, high - s)) for p, s, n in self.starts if s < high and low < s + n]
        here = F.lit(False)
        for part, a, b in held:
            here = here | ((F.col(PART) == part) & (F.col(AT) >= a) & (F.col(AT) < b))
        return self.table.where(here).orderBy(PART, AT).select(*[F.col(f"`{c}`") for c in self.columns])


def after(df: DataFrame, key: Sequence[str], last: Sequence[object] | None, size: int) -> DataFrame:
    """The next ``size`` rows after the one whose key is ``last`` (from the first without one), in the key's order.

    Each task keeps its own first rows, so nothing is sorted whole; the bound on the key's first part
    reaches the scan. Rows whose key has a null part come before all others: the first page holds them.
    """
    if not 1 <= size <= MOST_PAGE:
        raise ValueError(f"a page has 1 to {MOST_PAGE} rows")
    columns = [F.col(f"`{k}`") for k in key]
    if last is not None:
        values = [F.lit(v).cast(df.schema[k].dataType) for k, v in zip(key, last, strict=True)]
        beyond = F.lit(False)
        for i in reversed(range(len(key))):  # greater in this part, or equal and beyond in the next
            beyond = (columns[i] > values[i]) | ((columns[i] == values[i]) & beyond) if i < len(key) - 1 else columns[i] > values[i]
        df = df.where(columns[0] >= values[0]).where(beyond)
    return df.orderBy(*[F.asc_nulls_first(c) for c in columns]).limit(size)
