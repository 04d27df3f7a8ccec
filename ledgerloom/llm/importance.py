"""Importance resampling towards a target distribution, by hashed n-grams, in DataFrame functions only.

1. The n-grams of all documents and of all target texts are exploded and counted by bucket.
2. Each bucket's gain says how much likelier it is in the target. The table of gains has as many
   rows as there are buckets, which bounds its broadcast.
3. A document's weight is the floored mean of its n-grams' gains. With Gumbel noise of its own
   added, the highest scores are a sample without replacement, drawn in proportion to exp(weight).
4. Scores are sorted over all tasks; the rows of the ranges before give each row its rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, save, scratch
from .decontaminate import words_of

BUCKETS = 10_000
#: Documents of fewer words aren't drawn; of the others, so many of a hundred are.
LEAST_WORDS, PERCENT = 20, 25
SEED = 7


def bucketed(texts: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, n_words and the bucket of each feature, a row for each.

    Features are all words and all runs of two words, joined by a space, repeats included. Words are
    exploded with the one that follows, so no array travels with its elements; the last word has
    none, and a text without words has a row of nulls, so some buckets are null.
    """
    worded = texts.select(*keep, words_of(F.col("text")).alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("word"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("after"))
    each = worded.select(*keep, F.size("w").alias("n_words"), F.explode_outer(pairs).alias("at"))
    grams = F.array(F.col("at.word"), F.concat("at.word", F.lit(" "), "at.after"))
    each = each.select(*keep, "n_words", F.explode(grams).alias("feature"))
    return each.select(*keep, "n_words", (F.crc32(F.col("feature").cast("binary")) % BUCKETS).alias("bucket"))


def gains(docs: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, gain for each of the BUCKETS buckets: 1000 times the log ratio of its smoothed shares, floored."""
    count = lambda texts, name: bucketed(texts).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))
    every = docs.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket")
    counted = every.join(count(docs, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left").fillna(0)
    counted = save(counted, "bucket_counts")
    s_all, t_all = (float(n + BUCKETS) for n in counted.agg(F.sum("s"), F.sum("t")).first())
    ratio = (F.col("t") + 1).cast("double") * s_all / ((F.col("s") + 1).cast("double") * t_all)
    return counted.select("bucket", F.floor(1000.0 * F.log(ratio)).alias("gain"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (from 1, highest score first, null if not drawn) for each row of ``docs``.

    Null and wordless texts have no features, weight 0 and no rank. Equal scores go by doc_id, null
    ones last; rows that repeat a doc_id are documents of their own with the same noise, and of
    equal rows any may come first. A null doc_id draws its noise as an empty one. Empty tables give
    no rows, an empty target only smoothed shares. Other columns are ignored.
    """
    with scratch(docs.sparkSession):
        table = save(gains(docs, target), "gains")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
        met = bucketed(rows, "row", "doc_id").join(F.broadcast(table), "bucket", "left")  # BUCKETS rows
        summed = met.groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
        weight = F.expr("(total - pmod(total, greatest(n_features, 1L))) div greatest(n_features, 1L)")
        digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
        h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
        noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
        scored = save(summed.select("row", "doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise), "scored", keep=True)
        able = scored.where(F.col("n_words") >= least_words)
        drawn = able.count() * percent // 100
        ranked = save(numbered(able, F.desc("score"), F.asc_nulls_last("doc_id"), "row", label="ranked"), "drawn", keep=True)
    out = ("doc_id", "n_features", "weight", "score")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    rest = scored.where(F.col("n_words") < least_words)
    return ranked.select(*out, rank.alias("rank")).unionByName(rest.select(*out, F.lit(None).cast("long").alias("rank")))
