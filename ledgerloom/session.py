"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, wherever they run; once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"{here.name}/{f.relative_to(here)}")
    sc.addPyFile(str(out))


def work_folder(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder of spark.checkpoint.dir, deleted when the driver's JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def work_table(spark: SparkSession, label: str):
    """A function that writes a DataFrame under the shared folder of spark.checkpoint.dir and reads it back."""

    def save(df, name: str):
        path = work_folder(spark, f"{label}-{name}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over a shuffle's tasks, for work whose memory grows with the different values in a task.

    What one task reads may be a whole large row group. Rows are dealt by what they hold, so a task
    that runs again deals as before, and by where they are read, so that equal rows go to several tasks.
    """
    wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of our own, as small texts are many values
    at = "_at"
    while at.lower() in {c.lower() for c in df.columns}:
        at += "_"
    own = [f.name for f in df.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]  # these can't be hashed
    return df.withColumn(at, F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in own])).repartition(wide, at).drop(at)
