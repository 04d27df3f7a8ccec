"""Helpers that several operators share: scratch tables, word hashes, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that are turned into Python strings at a time.
ROWS_AT_ONCE = 512


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one of our own only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: The paths of each scratch() around, outermost first.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def _place(spark: SparkSession, path: str):
    """A path and its file system, as the JVM knows them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    place, fs = _place(spark, path)
    fs.delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is saved inside is deleted at the end, however it comes; what is kept, at the end of the next scratch() outwards."""
    paths: list[str] = []
    before = _open.set((*_open.get(), paths))
    try:
        yield
    finally:
        _open.reset(before)
        for path in paths:
            delete(spark, path)


def scratch_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A new path in the shared folder, deleted with the innermost scratch() around, or with ``keep`` the one around that; without one, when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    around = _open.get()[: -1 if keep else None]
    if around:
        around[-1].append(path)
    else:
        place, fs = _place(spark, path)
        fs.deleteOnExit(place)
    return path


def save(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends here.

    The table outlives any executor, so a lost one costs only its running tasks. It is
    deleted as scratch_path() says.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = ROWS_AT_ONCE) -> DataFrame:
    """mapInArrow in slices of so many rows; ``make`` runs once a task and returns the function for a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield step(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Hashed(dict):
    """Word bytes to a 64-bit hash. Forgets everything at ``most`` entries, so memory is bounded."""

    def __init__(self, most: int = 1 << 18) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def free_prefix(df: DataFrame) -> str:
    """A prefix of names that no column of ``df`` begins with, for columns of one's own."""
    prefix = "_own_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


#: Up to so many rows of a few numbers are broadcast (some 32 MB); beyond, a join shuffles.
MOST_BROADCAST_ROWS = 1_000_000


def text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text, so that what was found in it can be joined to it again without a copy of it."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


#: Odd multiplier of the rolling word-sequence hash.
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, hashed: Hashed, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a whole text.

    A-Z are lower-cased; words are runs without space and U+0009 to U+000D, which is
    how bytes.split() splits. Fewer words than ``width`` make one shingle; none, none.
    """
    words = hashed.of((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not len(words):
        return words
    n = min(width, len(words))
    acc = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        acc = acc * STEP + words[i : len(words) - n + 1 + i]
    return np.unique(mix64(acc))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else.

    lower() does just that unless the text has other upper-case letters, which a
    scan finds faster than translate() rewrites the text.
    """
    other = c.rlike(r"[\p{Lu}\p{Lt}\p{IsUppercase}&&[^A-Z]]")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(other, F.translate(c, upper, upper.lower())).otherwise(F.lower(c))


def numbered(df: DataFrame, *order: Column | str, label: str) -> DataFrame:
    """``df`` sorted and saved, with each row's ``place`` from 0 and the ``part`` (a range of the order) that it lies in.

    Each task numbers its own range; the counts before it, a number for each range, are added.
    """
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    own = save(df.orderBy(*order).select("*", F.spark_partition_id().alias("part"), at.alias("place")), label)
    before, starts = 0, []
    for part, n in sorted((r["part"], r["count"]) for r in own.groupBy("part").count().collect()):  # a row for each task
        starts.append((part, before))
        before += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "part int, _before long"))
    return own.join(offsets, "part").withColumn("place", F.col("place") + F.col("_before")).drop("_before")
