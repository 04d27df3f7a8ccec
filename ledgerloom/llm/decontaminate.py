"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window of an item (its 10 consecutive words, or all words of a shorter item) lies in
a document only if each of its word shingles does. So a window is looked for by one
necessary shingle, the rarest by its count over all documents: the prefix of length one
that full containment leaves, in an order by rarity.

1. A pass over all documents counts the benchmark's shingles. It moves 8-byte hashes, and
   notes which documents hold which.
2. Each window's rarest shingle is its prefix; documents without any prefix are out.
3. The others are read again. Their prefix shingles meet the windows, within the bounds that
   position and length set, and each window is verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, save, scratch

#: Words of a window.
WINDOW = 10
#: Words of a shingle; windows of fewer words are their own shingle.
SHINGLE = 5
#: Words of a block, in which positions are looked at.
BLOCK = 64
#: Up to so many rows are broadcast if their words have no more than so many characters; beyond, joins shuffle.
MOST_BROADCAST_SHINGLES, MOST_BROADCAST_CHARS = 500_000, 32 << 20

#: What parts words, after A-Z are lower-cased: ASCII that is neither letter nor digit.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), _GAP), "")


def n_words_of(text: Column) -> Column:
    """The number of words; case doesn't move their ends, so nothing is lower-cased."""
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _GAP_ANY_CASE), "")).cast("long")


def _shingle(words: str, at: str, width: int) -> str:
    return f"xxhash64({width}, {', '.join(f'get({words}, {at} + {i})' for i in range(width))})"


def _is_small(df: DataFrame, *texts: str) -> bool:
    """Whether ``df`` may be broadcast, by a count of its rows and of the characters of ``texts``."""
    chars = sum((F.length(c).cast("long") for c in texts), F.lit(0).cast("long"))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(chars), F.lit(0))).first()
    return rows <= MOST_BROADCAST_SHINGLES and size <= MOST_BROADCAST_CHARS


def _few(df: DataFrame, *texts: str) -> DataFrame:
    """``df``, marked for broadcast if it is small enough."""
    return F.broadcast(df) if _is_small(df, *texts) else df


def _starts(words: Column, first: Column, most: Column, widths: list[int]) -> Column:
    """An array with an entry for each of ``most`` words from the ``first`` (1 is the first): it and those after it, as many as a shingle has; null beyond the end."""
    n = F.greatest(most, F.lit(1))
    return F.arrays_zip(*[F.slice(words, first + i, n).alias(f"w{i}") for i in range(widths[-1])])


def _with_keys(at: DataFrame, widths: list[int]) -> DataFrame:
    """``at`` with ``key``, the hash of each shingle that begins at the entry ``p``, a row for each width."""
    own = [F.expr(f"if(p.w{q - 1} is null, null, xxhash64({q}, {', '.join(f'p.w{i}' for i in range(q))}))") for q in widths]
    return at.withColumn("key", own[0] if len(own) == 1 else F.explode(F.array(*own))).drop("p")


def _keys_of(docs: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, text_hash, key: the hash of each shingle of each document. No row carries more than a shingle's words."""
    spread = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w"))
    # the outer form: for the other, Spark would filter by size(w) first and split each text twice
    at = spread.select("doc_id", "text_hash", F.explode_outer(_starts(F.col("w"), F.lit(1), F.size("w"), widths)).alias("p"))
    return _with_keys(at, widths)


def _positions(docs: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, text_hash, n (words), at, low, block, key: each shingle with the words around it.

    Texts are cut into blocks of BLOCK words first, with as many more at either end as a window may
    reach. So a position carries the words of a block (from number ``low``), however long the text.
    """
    reach = WINDOW - 1
    spread = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w"))
    low = lambda b: F.greatest(b - reach, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(BLOCK)), lambda b: F.struct(b.alias("from"), low(b).alias("low"), F.slice("w", low(b) + 1, BLOCK + 2 * reach).alias("block")))
    each = spread.select("doc_id", "text_hash", F.size("w").alias("n"), F.explode_outer(F.when(F.size("w") > 0, blocks)).alias("b")).select("doc_id", "text_hash", "n", "b.*")
    entries = _starts(F.col("block"), F.col("from") - F.col("low") + 1, F.least(F.lit(BLOCK), F.col("n") - F.col("from")), widths)
    at = each.select("doc_id", "text_hash", "n", "low", "block", "from", F.posexplode(entries).alias("j", "p"))
    return _with_keys(at.withColumn("at", F.col("from") + F.col("j")).drop("from", "j"), widths)


def windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(win: window, size, words), (item_id, win) of the distinct windows of all items."""
    worded = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where("size(w) > 0")
    worded = worded.withColumn("size", F.least(F.size("w"), F.lit(WINDOW)))
    each = worded.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size")))).withColumn("words", F.expr("slice(w, at + 1, size)"))
    each = save(each.select("item_id", "size", "words", F.array_join("words", " ").alias("win")).distinct(), "item_windows")
    return each.select("win", "size", "words").dropDuplicates(["win"]), each.select("item_id", "win").distinct()


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, spans (array of start, size), items (array of item ids): documents with an occurring window.

    Window starts count words from 0. Documents without any have no row.
    """
    wins, item_of = windows(items)
    widths = sorted(r[0] for r in wins.select(F.least("size", F.lit(SHINGLE))).distinct().collect())  # SHINGLE values at most
    if not widths:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, spans array<struct<start:int,size:int>>, items array<string>")
    width = F.least("size", F.lit(SHINGLE))
    key_by_width = "case least(size, %d) %s end" % (SHINGLE, " ".join(f"when {q} then {_shingle('words', 'offset', q)}" for q in widths))
    parts = wins.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("size") - width))).withColumn("key", F.expr(key_by_width))
    parts = save(parts.select("win", "size", "words", "offset", "key"), "item_shingles")
    keys = save(parts.select("key").distinct(), "item_keys")

    # 1: no words travel, only the hash of each position, and only those of the benchmark's shingles go on
    held = save(_keys_of(docs, widths).join(_few(keys), "key", "left_semi"), "held")
    rarity = save(held.groupBy("key").agg(F.count("*").alias("count")), "rarity")

    # 2
    prefix = parts.join(rarity, "key").groupBy("win").agg(F.min(F.struct("count", "key", "offset")).alias("rarest"), F.count("*").alias("found"), F.first("size").alias("size"), F.first("words").alias("words"))
    whole = F.col("found") == F.col("size") - F.least("size", F.lit(SHINGLE)) + 1  # a shingle that no document holds rules the window out
    anchors = save(prefix.where(whole).select("win", "size", "words", F.col("rarest.key").alias("key"), F.col("rarest.offset").alias("offset")), "anchors")
    holders = held.join(_few(anchors.select("key").distinct()), "key", "left_semi").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    holders = save(holders, "holders")

    # 3: if positions are shuffled, what verification needs of a text is cut out before
    few = _few(holders)
    again = docs.join(few, docs["doc_id"].eqNullSafe(few["_d"]) & (F.xxhash64(docs["text"]) == few["_h"]), "left_semi")
    reach = WINDOW - 1
    near = F.expr(f"slice(block, greatest(at - {reach}, 0) - low + 1, least(at, {reach}) + {WINDOW})").alias("near")
    cut = lambda at: at.select("doc_id", "text_hash", "key", "at", "n", near, F.expr(f"least(at, {reach})").alias("before"))
    met, prefixes = _positions(again, widths), anchors.select("key").distinct()
    met = save(cut(met.join(F.broadcast(prefixes), "key", "left_semi")) if _is_small(prefixes) else cut(met).join(prefixes, "key", "left_semi"), "matches")
    bounded = met.join(_few(anchors, "win", "win"), "key").where("at - offset >= 0 and at - offset + size <= n")
    verified = bounded.where("slice(near, before - offset + 1, size) = words")
    # a window's places in a document become one row before its items are named, however many either are
    placed = save(verified.select("doc_id", "text_hash", F.expr("at - offset").alias("start"), "size", "win").groupBy("doc_id", "text_hash", "win", "size").agg(F.collect_set("start").alias("starts")), "placed")
    spans = placed.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list(F.transform("starts", lambda s: F.struct(s.alias("start"), F.col("size").alias("size"))))).alias("spans"))
    named = placed.select("doc_id", "text_hash", "win").join(_few(item_of, "item_id", "win"), "win").groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.collect_set("item_id").alias("items"))
    return spans.join(named, spans["doc_id"].eqNullSafe(named["_d"]) & (spans["text_hash"] == named["_h"])).drop("_d", "_h")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``.

    A word in any occurrence of a window is hit. Null and wordless texts have no words;
    items without words or without an id have no windows; repeated rows get equal results;
    other columns are ignored.
    """
    with scratch(docs.sparkSession):
        met = save(hits(docs, items), "hits", keep=True)
    covered = "aggregate(array_sort(spans), named_struct('e', 0, 'c', 0L), (a, s) -> named_struct('e', greatest(a.e, s.start + s.size), 'c', a.c + greatest(0, s.start + s.size - greatest(a.e, s.start))), a -> a.c)"
    met = met.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.expr(covered).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join(F.array_sort("items"), ",").alias("_i"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), n_words_of(F.col("text")).alias("n_words"))
    out = rows.join(met, rows["doc_id"].eqNullSafe(met["_d"]) & (rows["text_hash"] == met["_h"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("_i", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
