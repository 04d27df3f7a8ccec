"""Streams that remember: sessions of events, and the newest mapping of each source row as it changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship_package


def sessions(events: DataFrame, at: str, gap: str, late: str, by: str) -> DataFrame:
    """key, session_start, session_end (the last event and the gap after it), n: events of a key that follow each other within ``gap``.

    On a table all sessions; on a stream those that the watermark, ``late`` behind the newest event, has closed.
    Events without a time or a key belong to none.
    """
    own = events.where(F.col(at).isNotNull() & F.col(by).isNotNull())
    own = own.withWatermark(at, late) if events.isStreaming else own
    out = own.groupBy(F.session_window(F.col(at), gap).alias("w"), F.col(by)).agg(F.count("*").alias("n"))
    return out.select(F.col(by).alias("key"), F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


#: What is told of a mapping, and what is remembered of it.
MAPPING = "source_id string, target_id string, updated_at timestamp, change string"
_STATE = "target_id string, updated_us long"


def newest_mappings(entries: DataFrame, late: str, keep_ms: int) -> DataFrame:
    """source_id, target_id, updated_at, change of a stream of map entries (source_id, target_id, updated_at), whenever a newer entry comes.

    State is one entry a source row. It is dropped once the watermark, ``late`` behind the newest entry,
    has passed it by ``keep_ms``; then nothing older can come that isn't dropped as late, so
    nothing is told twice. Of entries of one time the greatest target id counts. Entries without a
    time or a source id are left out.
    """

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        best = held and (held[1], held[0])
        for batch in batches:
            at = batch["updated_at"].to_numpy("datetime64[us]").astype("int64").tolist()
            best = max([*([best] if best else []), *zip(at, batch["target_id"].fillna("").tolist(), strict=True)])
        us, target = best
        state.update((target, us))
        state.setTimeoutTimestamp(max(us // 1000, state.getCurrentWatermarkMs()) + keep_ms)
        if held is None or (held[1], held[0]) != best:
            yield pd.DataFrame({"source_id": [key[0]], "target_id": [target or None], "updated_at": [pd.Timestamp(us, unit="us")], "change": ["NEW" if held is None else "CHANGED"]})

    ship_package(entries.sparkSession)
    own = entries.select(F.col("source_id").cast("string"), F.col("target_id").cast("string"), F.col("updated_at").cast("timestamp")).where("source_id is not null and updated_at is not null")
    return own.withWatermark("updated_at", late).groupBy("source_id").applyInPandasWithState(step, MAPPING, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def follow_map(spark: SparkSession, folder: str, schema: T.StructType, pick: dict[str, str], out: str, checkpoint: str, late: str = "1 day", keep_ms: int = 86_400_000, files: int = 1000, names: str = "*") -> DataFrame:
    """Take what is new in a folder of map entries (its files of these ``names``), write each change under ``out``, and give the newest mapping of every source row so far.

    ``pick`` says what source_id, target_id and updated_at are. A batch that is run again after a
    break writes over what it wrote before, so a restart neither loses nor repeats a change.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", names).parquet(folder).selectExpr(*[f"{v} AS {k}" for k, v in pick.items()])
    take = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    newest_mappings(stream, late, keep_ms).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema(f"{MAPPING}, batch long").parquet(out)
    newest = F.max(F.struct("updated_at", "target_id")).alias("newest")
    return told.groupBy("source_id").agg(newest).select("source_id", "newest.target_id", "newest.updated_at")
