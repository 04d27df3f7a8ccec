"""The corpus pipeline: STAGES over documents, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm import decontaminate, near_dedup, piece_codec, quality_rules, secret_scan
from ledgerloom.llm.common import MOST_BROADCAST_ROWS, delete, free_prefix, save, scratch, scratch_path, table, text_keys
from ledgerloom.session import ship_package

#: The vocabulary file of the last stage, as public_tokenizers.path() knows it.
MODEL = "piece_bpe_32k.model"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    own = free_prefix(docs)
    rules, kept, a, b, lang = (own + n for n in ("rules", "kept", "a", "b", "lang"))
    keys = dict(zip((a, b), text_keys(F.col("text")), strict=True))
    with scratch(spark):  # texts of one language are judged alike; the verdicts are written, not the texts
        measured = save(quality_rules.measure(docs.select("doc_id", "lang", "text"), into=rules).withColumns(keys).select("doc_id", "lang", rules, a, b), "measured")
        judged = quality_rules.judge(measured, table(spark, sf_dir, "labels"), rules, kept)
        out = save(judged.where(~F.col(kept)).select(F.col("lang").alias(lang), a, b).distinct(), "rejected", keep=True)
    few = out.count() <= MOST_BROADCAST_ROWS  # else the texts are shuffled to meet their verdicts
    same = (keys[a] == out[a]) & (keys[b] == out[b]) & docs["lang"].eqNullSafe(out[lang])
    return docs.join(F.broadcast(out) if few else out, same, "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity of 0.8 or more), the document of the least doc_id stays.

    Of rows that repeat a doc_id, one stays; rows without a doc_id all stay.
    """
    ship_package(spark)
    judged = near_dedup.near_duplicates(docs, percent=80)
    copies = judged.where("not kept").select("doc_id").distinct()
    few = copies.count() <= near_dedup.MOST_BROADCAST_IDS  # else the texts are shuffled to meet their ids
    left = docs.join(F.broadcast(copies) if few else copies, docs["doc_id"] == copies["doc_id"], "left_anti")
    with scratch(spark):
        again = save(judged.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated", keep=True)
    if again.isEmpty():
        return left
    place = free_prefix(docs) + "place"
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    first = left.join(again, "doc_id", "left_semi").withColumn(place, rank).where(F.col(place) == 1)  # Spark keeps one a doc_id before it shuffles
    return left.join(again, left["doc_id"] == again["doc_id"], "left_anti").unionByName(first.select(*[F.col(f"`{c}`") for c in docs.columns]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    with scratch(spark):
        met = save(decontaminate.hits(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")), "contaminated", keep=True)
    return docs.join(met, docs["doc_id"].eqNullSafe(met["_doc"]) & (F.xxhash64(docs["text"]) == met["_hash"]), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; every document stays."""
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's SentencePiece ids, counted and digested, and the digest of their text again."""
    ship_package(spark)
    return piece_codec.digests(docs, MODEL)


STAGES = [("quality_rules", keep_good), ("near_dedup", drop_near_copies), ("decontaminate", drop_contaminated), ("secrets", redact_secrets), ("pieces", encode)]

#: SQL can't express the stages; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and reread as the next one's input."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name, keep=True)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
