"""Incremental loads as streams that end: each call takes what is new since the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def available_now(spark: SparkSession, folder: str, schema: T.StructType, checkpoint: str, take: Callable[[DataFrame, int], None], most_files: int = 1000) -> None:
    """Give all files that the checkpoint hasn't seen to ``take(batch, number)``, then end."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed(events: DataFrame, at: str, length: str, late: str, by: str, value: str) -> DataFrame:
    """window_start, key, n, total by event time, in tumbling windows; a stream drops rows later than ``late``."""
    own = events.withWatermark(at, late) if events.isStreaming else events
    out = own.groupBy(F.window(F.col(at), length).alias("w"), F.col(by)).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col(by).alias("key"), "n", "total")


class Watermark:
    """A high-water mark that only moves forward, and only for runs that ended well."""

    def __init__(self, value: object = None) -> None:
        self.value = value

    def advance(self, seen: object, status: str) -> bool:
        if seen is None or status not in ("COMPLETED", "COMPLETED_WITH_WARNINGS") or self.value is not None and not seen > self.value:
            return False
        self.value = seen
        return True
