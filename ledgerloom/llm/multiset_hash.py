"""Document fingerprints that add up: a text is the multiset of its paragraphs (its lines).

Each paragraph is hashed to a wide vector, and a fingerprint is the sum of these vectors modulo
2 ** 32. So order doesn't matter, and a paragraph is put in or taken out by adding or subtracting
its vector, without the rest of the text. A vector has two parts:

- EXACT lanes filled by a hash of the whole paragraph. They tell multisets apart.
- LIKE lanes, to one of which each five-word shingle of the paragraph adds 1 or -1. Two sums of
  these have about the cosine of the texts' shingle counts, which says how alike they are.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, Hashed, map_rows, mix64, save, scratch

EXACT, LIKE = 32, 256
LANES, WIDTH = EXACT + LIKE, 5
#: Paragraphs hashed at a time, which bounds the matrix of their vectors.
AT_ONCE = 4096
#: Bytes of text a task gets at most, if there are more than so many times the shuffle partitions.
TASK_BYTES = 64 << 20


def vector_of(text: str | None, hashed: Hashed) -> np.ndarray:
    """The sum of the vectors of all lines of a text; null is an empty text, which is one empty line."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    out = np.zeros(LANES, np.uint32)
    for i in range(0, len(lines), AT_ONCE):
        digests = b"".join(hashlib.shake_128(line).digest(EXACT * 4) for line in lines[i : i + AT_ONCE])
        out[:EXACT] += np.frombuffer(digests, "<u4").reshape(-1, EXACT).sum(0, dtype=np.uint32)
    split = [line.lower().split() for line in lines]
    n = np.fromiter(map(len, split), np.int64, len(split))
    words = hashed.of([w for line in split for w in line])
    left = np.repeat(np.cumsum(n), n) - np.arange(len(words))  # words from here to the end of the line
    first = np.cumsum(n) - n
    for width in range(1, WIDTH + 1):  # a shorter line is one shingle
        at = np.flatnonzero(left >= WIDTH) if width == WIDTH else first[n == width]
        if not len(at):
            continue
        acc = np.full(len(at), width, np.uint64)
        for i in range(width):
            acc = acc * STEP + words[at + i]
        acc = mix64(acc)
        lane, up = (acc % np.uint64(LIKE)).astype(np.int64), acc >> np.uint64(63) == 1
        signed = np.bincount(lane[up], minlength=LIKE) - np.bincount(lane[~up], minlength=LIKE)
        out[EXACT:] += signed.astype(np.int64).astype(np.uint32)
    return out


def written(vector: np.ndarray) -> str:
    return base64.b64encode(vector.astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, else the cosine of their LIKE lanes, 0 where it is negative or one has no shingles."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[EXACT:].astype(np.int32).astype(np.float64) for v in (a, b))
    size = math.sqrt(float(x @ x) * float(y @ y))
    return min(1.0, max(0.0, float(x @ y) / size)) if size else 0.0


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint of each row of ``docs``."""

    def make():
        hashed = Hashed()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([written(vector_of(t, hashed)) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

        return step

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")), make, "doc_id long, fingerprint string")


def summed(signed: DataFrame, *by: str) -> DataFrame:
    """The ``by`` columns and the fingerprint of each group of rows (fingerprint, sign): added where the sign is 1, taken out where it is -1.

    Lanes are added up by Spark, each task's own first, so no group is too large. Without ``by``, one
    row for all; null keys are a group; an empty table has no rows.
    """
    own = list(by) or ["_all"]
    rows = signed if by else signed.withColumn("_all", F.lit(0))

    def lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [(read(f).astype(np.int64) * s).tolist() for f, s in zip(batch["fingerprint"].to_pylist(), batch["sign"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in own], pa.array(values, pa.list_(pa.int64()))], [*own, "lanes"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [written(np.array([n for _, n in sorted((x["lane"], x["n"]) for x in row)], np.int64).astype(np.uint32)) for row in batch["lanes"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in own], pa.array(texts, pa.string())], [*own, "fingerprint"])

    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in own)
    each = rows.select(*own, "fingerprint", F.col("sign").cast("long").alias("sign")).mapInArrow(lanes, f"{keys}, lanes array<bigint>")
    added = each.select(*own, F.posexplode("lanes").alias("lane", "n")).groupBy(*own, "lane").agg(F.pmod(F.sum("n"), F.lit(1 << 32)).alias("n"))
    whole = added.groupBy(*own).agg(F.collect_list(F.struct("lane", "n")).alias("lanes"))  # LANES entries each
    return whole.mapInArrow(back, f"{keys}, fingerprint string").select(*by, "fingerprint")


def edited(known: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, fingerprint after ``edits`` (doc_id, paragraph, sign): paragraphs put in (1) or taken out (-1) of what is ``known``.

    Texts aren't needed. A document that isn't known is begun from nothing, so its first line is put in
    like any other. Rows with a null doc_id are one document.
    """
    signed = edits.select(F.col("doc_id").cast("long").alias("doc_id"), "paragraph", "sign")

    def make():
        hashed = Hashed()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([written(vector_of(t, hashed)) for t in batch.column(1).to_pylist()], pa.string()), batch.column(2)], ["doc_id", "fingerprint", "sign"])

        return step

    moved = map_rows(signed.select("doc_id", F.col("paragraph").cast("string"), F.col("sign").cast("long")), make, "doc_id long, fingerprint string, sign long")
    return summed(known.select(F.col("doc_id").cast("long").alias("doc_id"), "fingerprint", F.lit(1).cast("long").alias("sign")).unionByName(moved), "doc_id")


# -- neighbours

def bounds(keys: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """The least (doc_id, h) of each of so many ranges of about as many rows, in order."""
    least = keys.repartitionByRange(ranges, "doc_id", "h").groupBy(F.spark_partition_id()).agg(F.min(F.struct("doc_id", "h")).alias("least"))
    return sorted((r["least"]["doc_id"], r["least"]["h"]) for r in least.select("least").collect())  # a row for each range


def range_of(starts: Sequence[tuple[int, int]]):
    """A UDF of (doc_id, h): twice the number of its range, and one more if it is the range's first key."""
    ids, hashes = np.array([i for i, _ in starts], np.int64), [h for _, h in starts]

    @F.pandas_udf("long")
    def find(doc_id: pd.Series, h: pd.Series) -> pd.Series:
        own, hs = doc_id.to_numpy(), h.to_numpy()
        low, high = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        at = high - 1
        out = at * 2
        for i in np.flatnonzero(low < high):  # rows with the doc_id of a range's first key
            k = bisect_right(hashes, hs[i], low[i], high[i]) - 1
            out[i] = 2 * k + (ids[k] == own[i] and hashes[k] == hs[i]) if k >= low[i] else 2 * (low[i] - 1)
        return pd.Series(out)

    return find


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, kind, doc_id, text) in order, each with the row after it; kind 1 is told, 0 has no row after it, 2 is only looked at."""
    hashed, out, before = Hashed(), [], None

    def told(own: tuple, after: tuple | None) -> tuple:
        _, doc_id, text, vector = own
        cut = len(text) // 2
        new = text[: len(text) - cut] + (after[2][:cut] if after else "")
        changed = vector_of(new, hashed)
        return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), written(vector), written(changed), likeness(vector, changed), likeness(vector, after[3]) if after else None

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], list(names))

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for r in batch.slice(at, 256).to_pylist():
                if r["kind"] == 2 and (before is None or before[0] != r["range"]):
                    continue  # a repeat of the row that has been looked at
                own = (r["range"], r["doc_id"], r["text"], vector_of(r["text"], hashed))
                if r["kind"] == 0:
                    out.append(told(own, None))
                    continue
                if before is not None:
                    out.append(told(before, own))
                before = own if r["kind"] == 1 else None
            if out:
                yield flush()
                out.clear()


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of ``docs``.

    The edited text is the document's own with the last half replaced by as much of the beginning of
    the next document, or all of it. Null texts are empty. The next document is the next row by doc_id,
    rows of one doc_id by a hash of the text, and after the last comes the first. Rows without a doc_id
    have no place and so no next document: they lose their last half, and near_next is null. Other
    columns are ignored; an empty table has no rows.

    Texts are shuffled once. Ranges of doc_id, found from keys alone, are dealt one to a task; each
    range's first row goes to the range before as well, so each task has all the neighbours it needs.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    spark = docs.sparkSession
    with scratch(spark):
        keys = save(own.select("doc_id", "h", F.octet_length("text").alias("bytes")), "keys")
        size = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        starts = bounds(keys.where("doc_id is not null"), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES)))
    n = max(1, len(starts))
    found = F.when(F.col("doc_id").isNotNull(), range_of(starts)(F.coalesce("doc_id", F.lit(0)), "h"))
    placed = own.withColumn("found", found)
    at = F.expr("found div 2")
    place = lambda r, kind: F.struct(r.cast("int").alias("range"), F.lit(kind).alias("kind"))
    both = F.array(place(at, 1), place(F.pmod(at - 1, F.lit(n)), 2))
    places = F.when(F.col("doc_id").isNull(), F.array(place(F.pmod("h", F.lit(n)), 0))).when(F.col("found") % 2 == 1, both).otherwise(F.array(place(at, 1)))
    dealt = placed.select("doc_id", "text", "h", F.explode(places).alias("p")).select("p.range", "p.kind", "doc_id", "text", "h").repartitionById(n, F.col("range"))
    ordered = dealt.sortWithinPartitions("range", "kind", "doc_id", "h", "text").select("range", "kind", "doc_id", "text")
    return ordered.mapInArrow(_beside, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
