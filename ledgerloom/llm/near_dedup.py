"""Near-duplicate documents: one-permutation MinHash, banded buckets, star edges.

The plan, all on Spark:

1. One pass over the texts gives each document a one-permutation MinHash
   signature (empty bins filled by optimal densification), its band hashes and a
   digest of its full shingle set. Documents of equal sets form one class and go
   on as one node, so a group of exact copies costs nothing further.
2. Nodes meet in band buckets. Each bucket names one hub, the node that meets most
   others, and each node is linked to the best hub of its buckets: edges grow with the
   nodes, not with the square of a group.
3. Edges are confirmed on full shingle sets, and connected components follow.
4. A star can miss a link between two members that are both unlike the hub. So
   buckets that still hold several components are searched once more in blocks, only
   between components: first by signatures alone, then the members that have a possible
   partner meet again with their full sets, and these confirm. Nothing is capped, so no
   link of a shared bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, Hashed, map_rows, mix64, save, scratch, shingles

BINS = 256
#: Bins of a band at most, and the share of pairs just at the threshold that may share no band.
#: At 0.85 that makes 32 bands of 8, where one pair in 26,000 shares none and at 0.5 one in nine does.
MOST_ROWS, MISSED = 8, 1 / 26_000
#: A pair of signatures is ruled out in step 4 from this many standard errors under the threshold.
MARGIN = 4.5
#: Members of one side of a block in step 4, and their shingle hashes (12 MB): about so many at most.
BLOCK_ROWS, BLOCK_HASHES = 2048, 1_500_000
#: Different words whose hashes a task keeps, at most.
MOST_HASHED = 1 << 16
#: Up to so many ids are broadcast to pick texts (24 MB); beyond, the texts are joined by a shuffle.
MOST_BROADCAST_IDS = 1_000_000

#: For each attempt and bin, the bin to borrow from: shared by all documents.
_ATTEMPTS = 4096


def _borrow_table() -> np.ndarray:
    at = np.arange(_ATTEMPTS, dtype=np.uint64)[:, None] * np.uint64(BINS) + np.arange(BINS, dtype=np.uint64)[None, :]
    return (mix64((at + np.uint64(1)) * STEP) >> np.uint64(64 - 8)).astype(np.int64)


def signature(hashes: np.ndarray, borrow: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of sorted hashes: the least value in each of BINS ranges.

    An empty bin j takes the value of the first non-empty bin in its own fixed random
    sequence borrow[:, j] (optimal densification), so collisions stay unbiased.
    """
    edges = np.searchsorted(hashes, np.arange(BINS, dtype=np.uint64) << np.uint64(56))
    filled = edges < np.append(edges[1:], len(hashes))
    out = hashes[np.minimum(edges, len(hashes) - 1)]
    empty = np.flatnonzero(~filled)
    source = out.copy()
    for at in range(0, _ATTEMPTS, 128):
        if not len(empty):
            return out
        tries = filled[borrow[at : at + 128, empty]]
        first = tries.argmax(axis=0)
        found = tries[first, np.arange(len(empty))]
        out[empty[found]] = source[borrow[at + first[found], empty[found]]]
        empty = empty[~found]
    out[empty] = hashes[0]
    return out


def band_rows(percent: int) -> int:
    """Bins of a band, as many as leave MISSED pairs of ``percent`` without a shared band."""
    fits = [r for r in range(1, MOST_ROWS + 1) if (1 - (percent / 100) ** r) ** (BINS // r) <= MISSED]
    return max(fits, default=1)


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = BINS // rows
    acc = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        acc = acc * STEP + mix64(sig[i : bands * rows : rows])
    return mix64(acc).view(np.int64)


def sketches(docs: DataFrame, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key (null for no words), bands, sig, in one pass over whole texts."""

    def make():
        hashed, borrow = Hashed(MOST_HASHED), _borrow_table()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, keys, bands, sigs = [], [], [], []
            for text in batch.column(1).to_pylist():
                hs = shingles(text, hashed)
                n.append(len(hs))
                if len(hs):
                    sig = signature(hs, borrow)
                    keys.append(xxhash.xxh128_digest(hs.tobytes()))
                    bands.append(band_hashes(sig, rows))
                    sigs.append((mix64(sig) & np.uint64(255)).astype(np.uint8).tobytes())
                else:
                    keys.append(None), bands.append(None), sigs.append(None)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_key", "bands", "sig"])

        return step

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, n_shingles long, set_key binary, bands array<long>, sig binary")


def full_sets(docs: DataFrame, ids: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """node, set_key, hashes: the full shingle sets of the documents that ``ids`` (node) names.

    With ``wanted`` (node, set_key), where rows may repeat a doc_id: one row of each wanted set.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    few = ids.count() <= MOST_BROADCAST_IDS
    texts = texts.join(F.broadcast(ids) if few else ids, "node", "left_semi")

    def make():
        hashed = Hashed(MOST_HASHED)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [shingles(text, hashed) for text in batch.column(1).to_pylist()]
            keys = [xxhash.xxh128_digest(hs.tobytes()) for hs in raw]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array([np.sort(hs.view(np.int64)) for hs in raw], pa.list_(pa.int64()))], ["node", "set_key", "hashes"])

        return step

    sets = map_rows(texts, make, "node long, set_key binary, hashes array<long>").where("size(hashes) > 0")  # a row without words may repeat the id
    if wanted is None:
        return sets
    return sets.join(wanted, ["node", "set_key"], "left_semi").dropDuplicates(["node", "set_key"])


def confirmed(docs: DataFrame, pairs: DataFrame, percent: int, wanted: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Each text is shingled once; a set travels once for each pair it is in.
    """
    with scratch(docs.sparkSession):
        pairs = save(pairs, "pairs")
        ids = save(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ids")
        sets = save(full_sets(docs, ids, wanted), "sets")
        left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
        right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
        both = pairs.join(left, "a").join(right, "b")
        inter = F.size(F.array_intersect("ha", "hb"))
        union = F.size("ha") + F.size("hb") - inter
        return save(both.where(100 * inter.cast("long") >= percent * union.cast("long")).select("a", "b"), "links", keep=True)


def components(links: DataFrame) -> DataFrame:
    """node, component (least node reachable), for all nodes of the links (a, b).

    Alternates large-star and small-star steps until nothing changes; each is one
    aggregation and one join, whose hot keys adaptive execution splits.
    """
    edges = save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            ways = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = save(ways.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a")), "least")
            out = ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            least = save(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
            out = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    def mark(edges: DataFrame) -> tuple:
        x = F.xxhash64("a", "b").cast("decimal(20,0)")
        return tuple(edges.agg(F.count("*"), F.sum(x)).first())

    before = mark(edges)
    while True:
        edges = save(star(edges, True), "edges")
        edges = save(star(edges, False), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _possible(key: tuple, rows: pd.DataFrame, comp: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For one block pair of one bucket, in order of block and size: a member, and those further on that may be linked with it.

    They are of other components (``comp``, which may change between steps), and neither sizes nor signatures rule them out.
    """
    s = percent / 100
    least = int(np.ceil(BINS * (s - MARGIN * np.sqrt(s * (1 - s) / BINS))))
    bucket, i, j = key
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), BINS)
    bands, n, side = np.stack(rows["bands"].to_numpy()), rows["n_shingles"].to_numpy(), rows["block"].to_numpy()
    second = 0 if i == j else int(np.searchsorted(side, i, "right"))
    for x in range(len(rows) if i == j else second):
        start = x + 1 if i == j else second
        lo, hi = start + np.searchsorted(n[start:], [int(np.ceil(n[x] * s)), int(n[x] / s) + 1])  # sets of like size only
        other = np.arange(lo, hi)
        other = other[comp[lo:hi] != comp[x]]
        if len(other):
            other = other[(sig[other] == sig[x]).sum(axis=1) >= least]
        if len(other):
            met = (bands[other] == bands[x]).argmax(axis=1)
            other = other[bands[x][met] == bucket]  # only in the first bucket that the two share
        if len(other):
            yield x, other


#: What a member of a block is known by, and the order of members in a block.
_MEMBER = "bucket long, i int, j int, block int, node long, component long, set_key binary, n_shingles long, sig binary, bands array<long>"
_ORDER = ["block", "n_shingles", "node"]


def _block_members(percent: int):
    """For one block pair of one bucket: the members that have a possible link at all."""

    def members(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(_ORDER, kind="stable")
        kept = np.zeros(len(rows), bool)
        for x, other in _possible(key, rows, rows["component"].to_numpy(), percent):
            kept[x] = kept[other] = True
        return rows[kept]

    return members


def _block_links(percent: int):
    """For one block pair of one bucket: confirmed links between components, each pair of which needs one.

    What leaves the block is at most one link for each two components that it joins.
    """

    def links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(_ORDER, kind="stable")
        sets, node, comp, n = (rows[c].to_numpy().copy() for c in ("hashes", "node", "component", "n_shingles"))
        out = []
        for x, other in _possible(key, rows, comp, percent):
            for y in other:
                if comp[y] == comp[x]:
                    continue
                at = np.searchsorted(sets[x], sets[y])
                inter = int((sets[x][np.minimum(at, n[x] - 1)] == sets[y]).sum())
                if 100 * inter >= percent * (int(n[x]) + int(n[y]) - inter):
                    out.append((min(node[x], node[y]), max(node[x], node[y])))
                    comp[comp == comp[y]] = comp[x]
        return pd.DataFrame(out, columns=["a", "b"]).astype(np.int64)

    return links


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text, any others).

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of
    5-word shingles; component_id is the least doc_id reachable. Null, empty and blank
    texts have no shingles and are linked with nothing. Rows that repeat a doc_id count
    as one document with links of them all, so they have one component_id, unless their
    text has no words. A null doc_id gets a null component_id and
    is kept. An empty table gives an empty result; other columns are ignored.
    """
    with scratch(docs.sparkSession):
        return save(_near_duplicates(docs, percent), "near_duplicates", keep=True)


def _nodes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents without their signatures; the classes of equal sets; a node with its signature for each class."""
    with scratch(docs.sparkSession):
        base = save(sketches(docs, band_rows(percent)), "sketches")
        brief = save(base.select("doc_id", "n_shingles", "set_key"), "brief", keep=True)
        classes = save(_worded(brief).groupBy("set_key").agg(F.min("doc_id").alias("node")), "classes", keep=True)
        first = _worded(base).join(classes.select(F.col("node").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi")
        nodes = save(first.dropDuplicates(["doc_id", "set_key"]).withColumnRenamed("doc_id", "node"), "nodes", keep=True)
    return brief, classes, nodes


def _worded(sketched: DataFrame) -> DataFrame:
    return sketched.where("n_shingles > 0 and doc_id is not null")


def _near_duplicates(docs: DataFrame, percent: int) -> DataFrame:
    base, classes, nodes = _nodes(docs, percent)
    worded = _worded(base)
    # a doc_id with several texts links their classes
    repeated = save(worded.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated")
    wanted, same = None, None
    if not repeated.isEmpty():
        wanted = nodes.select("node", "set_key")
        same = worded.select("doc_id", "set_key").join(repeated, "doc_id", "left_semi").distinct().join(classes, "set_key")
        same = save(same.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct(), "same")
    met = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = save(met.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    members = save(met.join(shared, "bucket"), "members")
    central = save(members.groupBy("node").agg(F.sum("size").alias("meets")), "central")
    members = save(members.join(central, "node"), "members")
    hubs = save(members.groupBy("bucket").agg(F.min(F.struct((-F.col("meets")).alias("m"), "node")).alias("hub")), "hubs")
    # of the hubs it meets, a node is linked to the one that meets most: an edge a node at most
    own = members.join(hubs, "bucket").where("node <> hub.node").groupBy("node").agg(F.min("hub").alias("hub"))
    stars = own.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    links = confirmed(docs, stars, percent, wanted)
    comp = save(components(links if same is None else links.union(same)), "components")

    # Links that the stars can't see run between components that still share a bucket.
    labelled = members.select("bucket", "node", "n_shingles").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = save(labelled, "labelled")
    split = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("rows"), F.sum("n_shingles").alias("hashes")).where("lo <> hi")
    split = save(split.select("bucket", F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("hashes") / BLOCK_HASHES)).cast("int").alias("blocks")), "split")
    left = labelled.drop("n_shingles").join(split, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    left = save(left.select("bucket", "i", "j", "block", "node", "component"), "left")
    left = left.join(nodes, "node")
    if wanted is not None:
        left = left.where(F.array_contains("bands", F.col("bucket")))  # the sets of a node that are in the bucket
    wide = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of our own, as these tasks are short of bytes but not of work
    block = ["bucket", "i", "j"]
    left = save(left.repartition(wide, *block).groupBy(*block).applyInPandas(_block_members(percent), _MEMBER), "possible")
    ids = save(left.select("node").distinct(), "ids")
    left = left.join(save(full_sets(docs, ids, wanted), "sets"), ["node", "set_key"])
    found = left.repartition(wide, *block).groupBy(*block).applyInPandas(_block_links(percent), "a long, b long")
    comp = save(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found)), "components")

    of_class = save(classes.join(comp, "node", "left").select("set_key", F.coalesce("component", "node").alias("component")), "class_components")
    out = base.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
