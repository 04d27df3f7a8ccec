"""A Merkle tree over a dataset: a leaf for each row, a subtree for each source, and a proof for each leaf.

Leaves are put in order over all tasks and cut into aligned blocks of FANOUT ** DEPTH. In a block
the digests are one contiguous matrix of 64-byte hex rows: reshaped by FANOUT, its rows are hashed
level by level, and every sibling is found by index arithmetic. A block's root is a node of the
next pass, so a source of any size needs a few passes, and no task holds more than one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered, save, scratch

FANOUT, DEPTH = 3, 8
#: Nodes of a block (6,561): a group of some 0.4 MB of digests.
BLOCK = FANOUT**DEPTH
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<l:string,r:string>>"


def leaf_of(values: Sequence[Column]) -> Column:
    """The digest of a row: of each value its bytes in UTF-8, counted, or ``-`` for null."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[part(v.cast("string")) for v in values]), 256)


def tree_of(source: Column) -> Column:
    """The key of a source's tree, which sorts as sources do: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


# -- one block

def parents(nodes: np.ndarray) -> np.ndarray:
    """The digests of each FANOUT consecutive rows of a matrix of 64-byte hex digests; the last run may be shorter."""
    whole = len(nodes) // FANOUT
    out = [hashlib.sha256(run).hexdigest() for run in nodes[: whole * FANOUT].reshape(whole, FANOUT * 64)]
    if whole * FANOUT < len(nodes):
        out.append(hashlib.sha256(nodes[whole * FANOUT :].tobytes()).hexdigest())
    return np.frombuffer("".join(out).encode(), np.uint8).reshape(-1, 64)


def levels(digests: list[str], block: int) -> list[np.ndarray]:
    """The nodes of each level of a block, its own digests first.

    A full block, or one after others, climbs all DEPTH levels, as its tree goes on; a lone one stops at one node.
    """
    out = [np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, 64)]
    goes_on = block > 0 or len(digests) == BLOCK
    while len(out) <= DEPTH and (goes_on or len(out[-1]) > 1):
        out.append(parents(out[-1]))
    return out


def siblings(tree: list[np.ndarray]) -> list[list[tuple[bytes, bytes]]]:
    """For each node of the lowest level, the digests left and right of its ancestor's place in each run on the way up."""
    n, out = len(tree[0]), []
    for level, nodes in enumerate(tree[:-1]):
        at = np.arange(n) // FANOUT**level
        low = at // FANOUT * FANOUT
        high = np.minimum(low + FANOUT, len(nodes))
        flat = nodes.tobytes()
        out.append([(flat[a:b], flat[b + 64 : c]) for a, b, c in zip((low * 64).tolist(), (at * 64).tolist(), (high * 64).tolist(), strict=True)])
    return [list(steps) for steps in zip(*out, strict=True)] if out else [[] for _ in range(n)]


def fold(leaf: str, steps: Sequence[tuple[bytes, bytes]]) -> str:
    """The root that a leaf and its siblings lead to."""
    own = leaf.encode()
    for left, right in steps:
        own = hashlib.sha256(left + own + right).hexdigest().encode()
    return own.decode()


# -- passes over blocks

def _block_roots(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    tree, block = (k.as_py() for k in key)
    t = t.sort_by("pos")
    root = levels(t["digest"].to_pylist(), block)[-1].tobytes().decode()
    return pa.table({"tree": [tree], "pos": pa.array([block], pa.int64()), "digest": [root]})


def _climbed(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    t = t.sort_by("pos")
    nodes = levels(t["digest"].to_pylist(), key[1].as_py())
    steps = [[{"l": a.decode(), "r": b.decode()} for a, b in s] for s in siblings(nodes)]
    kind = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
    return pa.table({"tree": t["tree"], "pos": t["pos"], "block": t["block"], "steps": pa.array(steps, kind), "top": [nodes[-1].tobytes().decode()] * len(t)})


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))


def paths(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (tree, pos, digest): (tree, pos, steps) up to each tree's top, and (tree, digest) of the tops."""
    passes = []
    while True:
        climbed = save(_blocked(nodes).groupBy("tree", "block").applyInArrow(_climbed, f"tree string, pos long, block long, steps {_STEPS}, top string"), "climbed")
        passes.append(climbed)
        nodes = climbed.where(f"pos = block * {BLOCK}").select("tree", F.col("block").alias("pos"), F.col("top").alias("digest"))
        if nodes.where("pos > 0").isEmpty():
            break
    up = passes[-1].select("tree", "pos", "steps")
    for climbed in reversed(passes[:-1]):
        above = up.select("tree", F.col("pos").alias("block"), F.col("steps").alias("more"))
        up = climbed.join(above, ["tree", "block"]).select("tree", "pos", F.concat("steps", "more").alias("steps"))
    return up, nodes.select("tree", "digest")


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, doc_id, leaf, ...) with pos, each leaf's place in its tree, and its block: by doc_id, null first, then by leaf."""
    own = numbered(leaves, "tree", F.asc_nulls_first("doc_id"), "leaf", label="leaves")
    firsts = own.groupBy("tree", "part").agg(F.min("place").alias("first"))  # a row for each source in each range
    start = firsts.select("tree", "part", F.min("first").over(Window.partitionBy("tree")).alias("start"))
    return _blocked(own.join(start, ["tree", "part"]).withColumn("pos", F.col("place") - F.col("start")).drop("part", "place", "start"))


def tops(leaves: DataFrame) -> DataFrame:
    """tree, pos (a block of its leaves), steps from there to the root, subroot, root."""
    roots = leaves.select("tree", "pos", "block", F.col("leaf").alias("digest")).groupBy("tree", "block").applyInArrow(_block_roots, "tree string, pos long, digest string")
    up, subroots = paths(save(roots, "block_roots"))
    places = save(numbered(subroots, "tree", label="subroots"), "trees")
    over, root = paths(places.select(F.lit("").alias("tree"), F.col("place").alias("pos"), "digest"))
    joint = places.select("tree", F.col("digest").alias("subroot"), F.col("place").alias("at")).join(over.select(F.col("pos").alias("at"), F.col("steps").alias("over")), "at")
    top = root.first()
    return up.join(joint, "tree").select("tree", "pos", F.concat("steps", "over").alias("steps"), "subroot", F.lit(top["digest"] if top else None).cast("string").alias("root"))


def _proved(leaves: pa.Table, top: pa.Table) -> pa.Table:
    leaves = leaves.sort_by("pos")
    digests, now = leaves["leaf"].to_pylist(), leaves["now"].to_pylist()
    above = [(s["l"].encode(), s["r"].encode()) for s in top["steps"][0].as_py()]
    rest = b"".join(a + b for a, b in above)
    subroot, root = top["subroot"][0].as_py(), top["root"][0].as_py()
    proofs, folded = [], []
    for leaf, other, steps in zip(digests, now, siblings(levels(digests, leaves["block"][0].as_py())), strict=True):
        proofs.append(hashlib.sha256(b"".join(a + b for a, b in steps) + rest).hexdigest())
        folded.append(fold(other or leaf, steps + above))
    n = len(digests)
    return pa.table({"doc_id": leaves["doc_id"], "leaf": leaves["leaf"], "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})


def verified(docs: DataFrame, now: Column | None = None, where: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``docs``.

    The tree is that of ``docs``. Each row is then checked against it by its proof: with ``now`` for
    its text where ``where`` holds, else as it is. Null values are told from empty ones; a null source
    is a source of its own, the first. Repeated rows are leaves of their own, next to each other, and
    rows of one doc_id go by their leaves. An empty table has no rows. Other columns are ignored.
    """
    with scratch(docs.sparkSession):
        values = [F.col(c) for c in COLUMNS]
        changed = F.when(where, leaf_of([*values[:-1], now])) if now is not None else F.lit(None).cast("string")
        leaves = docs.select(tree_of(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(values).alias("leaf"), changed.alias("now"))
        leaves = save(placed(leaves), "placed", keep=True)
        top = save(tops(leaves), "tops", keep=True)
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return leaves.groupBy("tree", "block").cogroup(top.groupBy("tree", "pos")).applyInArrow(_proved, schema)


def without_line_breaks() -> tuple[Column, Column]:
    """A text that has lost its line breaks, and which rows that befalls: those with an even crc32 of the doc_id, if there is a break."""
    text = F.col("text").cast("string")
    return F.replace(text, F.lit("\n"), F.lit("")), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & text.contains("\n")
