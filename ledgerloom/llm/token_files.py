"""Token ids in Huffman-coded files.

Ids come from the tokenizers library. Counts over all documents give one canonical
code with limited lengths, so a file needs only the lengths and decoding needs only a
table. Files hold blocks of whole documents in ascending doc_id order; each block can
be read alone, and a bit offset for every STEP ids lets all its stretches be decoded
side by side.

The code is a table of id and length; the blocks are rows whose ``block`` column is

    b"LLH1", n_docs uint32, n_ids uint64, 8 zero bytes
    doc_id int64[n_docs], doc_id is null uint8[n_docs], ids of each uint32[n_docs]
    bit offset uint64[ceil(n_ids / STEP)], then the bits, most significant first

(little-endian). Both are written and read by Spark, so a lost executor leaves nothing
half done and any store that Spark reaches will do.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_rows, save, scratch, scratch_path

#: Longest code in bits: a decoding table has two to this many entries.
LONGEST = 18
#: Ids between two bit offsets, and ids from which a block is closed.
STEP, BLOCK_IDS = 64, 1 << 18
#: Words whose ids a task keeps, at most, and that the library gets at once.
MOST_WORDS, WORDS_AT_ONCE = 1_400_000, 2048
#: Texts are parted into words in slices of about so many bytes, or one text.
BYTES_AT_ONCE = 8 << 20


# -- ids

# What a tokenizer file says if it never looks across white space.
_WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}
#: ASCII that is neither letter, digit, white space nor an apostrophe: after letters, a run of it is parted from them.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def by_words(rules: dict) -> bool:
    """Whether the file's rules are those by which words can be encoded one by one: its specials begin with ``<|``."""
    model = rules["model"]
    return all(rules.get(k) == v for k, v in _WORD_RULES.items()) and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["ignore_merges"] and all(t["content"].startswith("<|") for t in rules["added_tokens"])


def _bytes(texts: pa.Array) -> list[bytes]:
    """A list of the values; much faster than to_pylist()."""
    return texts.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Ids of whole texts, word by word where the tokenizer never looks across white space.

    Arrow parts texts at ASCII white space and finds the different words of a slice; each is
    looked up once, and numpy lays their ids out in the order of the text. What else counts as
    white space is left to the library. It gets only words not seen lately: those of letters
    alone are one token run each, which ends with a token that ends words, so they go through
    it as one text and are told apart again; should the number differ, each goes alone. A
    tokenizer with other rules gets each text whole.
    """

    def __init__(self, file: str, kind: str = "<u4") -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(file), kind
        with open(file, encoding="utf-8") as f:
            self.by_words = by_words(json.load(f))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or (len(ids) and stops[-1] != len(ids)):
            return self._alone(words)
        blob, at = ids.tobytes(), (stops * ids.itemsize).tolist()
        return [blob[i:j] for i, j in zip([0, *at], at)]

    def learn(self, words: pa.Array) -> None:
        """Add words (string) that aren't known, each given once."""
        known = self.known
        stems = pc.ascii_rtrim(words, _TAIL)
        # before the tail is a letter, in lower case too (not U+0130), so the marks are parted from it; no special token is cut
        has_tail = pc.and_(pc.not_equal(stems, words), pc.and_(pc.match_substring_regex(stems, r"[A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{012F}\x{0131}-\x{024F}]$"), pc.invert(pc.match_substring(words, "<|"))))
        whole, stems = _bytes(words.filter(has_tail)), stems.filter(has_tail)
        stem_of = _bytes(stems)
        tails = [w[len(s) :] for w, s in zip(whole, stem_of)]
        parts = pa.concat_arrays([words.filter(pc.invert(has_tail)), stems, pa.array([t.decode() for t in set(tails)], pa.string())]).unique()
        parts = parts.filter(pa.array([w not in known for w in _bytes(parts)], pa.bool_()))
        plain = pc.utf8_is_alpha(parts)
        for encode, own in ((self._together, parts.filter(plain)), (self._alone, parts.filter(pc.invert(plain)))):
            for at in range(0, len(own), WORDS_AT_ONCE):
                part = own.slice(at, WORDS_AT_ONCE)
                known.update(zip(_bytes(part), encode(part.to_numpy(zero_copy_only=False).tolist()), strict=True))
        known.update(zip(whole, (known[s] + known[t] for s, t in zip(stem_of, tails))))

    def _blobs(self, words: pa.Array) -> list[bytes]:
        """The ids of each word; all words are forgotten first if the table would get too large."""
        known, own = self.known, _bytes(words)
        new = [w not in known for w in own]
        if known and len(known) + sum(new) > MOST_WORDS:
            known.clear()
            new = [True] * len(own)
        self.learn(words.filter(pa.array(new, pa.bool_())))
        return [known[w] for w in own]

    def _slice(self, texts: pa.Array, end: int) -> pa.Array:
        # It composes characters before it lower-cases them, and takes special tokens out before
        # that: texts with combining marks or with what may be a special token keep their case.
        as_is = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, "[\u0300-\u036f]"))
        parted = pc.ascii_split_whitespace(pc.if_else(as_is, texts, pc.ascii_lower(texts)))
        coded = parted.flatten().dictionary_encode()
        blobs = pa.array([*self._blobs(coded.dictionary), np.array([end], self.kind).tobytes()], pa.binary())
        offsets = parted.offsets.to_numpy() - parted.offsets[0].as_py()
        words = np.insert(coded.indices.to_numpy(), offsets[1:], len(blobs) - 1)  # the end id follows each text
        ids = blobs.take(pa.array(words))  # all words' ids one after the other
        places = np.frombuffer(ids.buffers()[1], np.int32)[offsets + np.arange(len(offsets))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(places), ids.buffers()[2]])

    def encode(self, texts: pa.Array, end: int) -> pa.Array:
        """The ids of each text (string) as ``kind``, then ``end``; null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            last = np.array([end], self.kind).tobytes()
            return pa.array([b + last for t in texts.to_pylist() for b in self._alone([t])], pa.binary())
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(sizes // BYTES_AT_ONCE)) + 1).tolist(), len(texts)]
        parts = [self._slice(texts.slice(i, j - i), end) for i, j in zip(cuts, cuts[1:]) if j > i]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


_encoders: dict[tuple[str, str], WordEncoder] = {}


def kind_of(tokenizer: str, end_id: int) -> str:
    """The least of uint16 and uint32 that holds all ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_file(public_tokenizers.path(tokenizer)).get_vocab(with_added_tokens=True).values(), default=0)
    return "<u2" if max(most, end_id) < 1 << 16 else "<u4"


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "<u4") -> DataFrame:
    """doc_id, ids (little-endian, as ``kind``, with ``end_id`` last) of each whole text; null counts as empty."""

    def make():
        import public_tokenizers

        if (tokenizer, kind) not in _encoders:
            _encoders[tokenizer, kind] = WordEncoder(public_tokenizers.path(tokenizer), kind)
        own = _encoders[tokenizer, kind]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), own.encode(batch.column(1), end_id)], ["doc_id", "ids"])

        return step

    return map_rows(docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text"), make, "doc_id long, ids binary", rows=1 << 14)


# -- the code

def id_counts(ids: DataFrame, kind: str = "<u4") -> DataFrame:
    """id, count over all documents; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                got = np.bincount(np.frombuffer(b"".join(batch.column(0).slice(at, 512).to_pylist()), kind))
                if len(got) > len(total):
                    got[: len(total)] += total
                    total = got
                else:
                    total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "count"])

    return ids.select("ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code none of whose codes is longer than ``longest`` (package-merge)."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << longest:
        raise ValueError("more symbols than codes of this length")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)
    level, leaf = weights, [np.ones(n, bool)]
    for _ in range(longest - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        leaf.append(rank < n)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(leaf):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical codes from lengths: shorter before longer, then by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        spans = np.int64(1) << (LONGEST - lengths)
        codes = (np.cumsum(spans) - spans) >> (LONGEST - lengths)
        size = int(ids.max()) + 1 if len(ids) else 0
        self.codes, self.lengths = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.codes[ids], self.lengths[ids] = codes.astype(np.uint64), lengths
        #: For each LONGEST bits that may follow: id and length of the code they begin with.
        self.table = np.zeros(1 << LONGEST, np.int64)
        self.table[: int(spans.sum())] = np.repeat(ids << 8 | lengths, spans)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offsets of every STEP-th id, and the bits."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = ends - n
        lanes = int(ends[-1] + 31) // 32 + 1 if len(ids) else 0
        shifted = self.codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
        # codes don't overlap, so sums of their parts in a 32-bit lane are exact in a double
        bits = np.bincount(at >> 5, (shifted >> np.uint64(32)).astype(np.float64), lanes) + np.bincount((at >> 5) + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), lanes)
        return at[::STEP].astype(np.uint64), bits.astype(">u4").tobytes()

    def decode(self, offsets: np.ndarray, bits: bytes, count: int) -> np.ndarray:
        """The ids again, one from each stretch at a time."""
        data = np.frombuffer(bits + bytes(8), np.uint8).astype(np.int64)
        ahead = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        at, last = offsets.astype(np.int64), len(ahead) - 1
        out = np.empty((STEP, len(at)), np.int64)
        for k in range(STEP):
            window = ahead[np.minimum(at >> 3, last)]
            entry = self.table[window >> (32 - LONGEST - (at & 7)) & ((1 << LONGEST) - 1)]
            out[k] = entry
            at += entry & 255
        return (out >> 8).T.reshape(-1)[:count].astype(np.uint32)


def pack(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, code: Code) -> bytes:
    offsets, bits = code.encode(ids)
    head = struct.pack("<4sIQ8x", b"LLH1", len(doc_ids), len(ids))
    return b"".join([head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.array(sizes, "<u4").tobytes(), offsets.astype("<u8").tobytes(), bits])


def unpack(block: bytes, code: Code) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids of each, all ids."""
    magic, docs, count = struct.unpack_from("<4sIQ8x", block)
    if magic != b"LLH1":
        raise ValueError("not a block")
    at = 24
    parts = []
    for kind, n in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u8", -(-count // STEP))):
        parts.append(np.frombuffer(block, kind, n, at))
        at += parts[-1].nbytes
    own, null, sizes, offsets = parts
    return [None if x else d for d, x in zip(own.tolist(), null.tolist(), strict=True)], sizes, code.decode(offsets, block[at:], count)


# -- files

def write(ids: DataFrame, path: str, kind: str = "<u4") -> None:
    """Write (doc_id, ids as ``kind``) as ``path``/code and ``path``/blocks, in ascending doc_id order (nulls first)."""
    counted = id_counts(ids, kind).orderBy("id").collect()  # a row for each id of the vocabulary at most
    symbols, counts = (np.array([r[k] for r in counted], np.int64) for k in ("id", "count"))
    lengths = code_lengths(counts) if len(counts) else counts
    spark = ids.sparkSession
    spark.createDataFrame([(int(i), int(n)) for i, n in zip(symbols, lengths, strict=True)], "id long, length long").coalesce(1).write.parquet(f"{path}/code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(symbols, lengths)
        part = TaskContext.get().partitionId()
        docs, blobs, held, number, start, size = [], [], 0, 0, 0, np.dtype(kind).itemsize

        def close() -> pa.RecordBatch:
            nonlocal docs, blobs, held, number, start
            block = pack(docs, [len(b) // size for b in blobs], np.frombuffer(b"".join(blobs), kind).astype(np.int64), code)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([start], pa.int64()), pa.array([held], pa.int64()), pa.array([block], pa.binary())], ["part", "number", "start", "n_ids", "block"])
            start, number, docs, blobs, held = start + held, number + 1, [], [], 0
            return out

        for batch in batches:
            for doc, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc)
                blobs.append(blob.as_py())
                held += len(blobs[-1]) // size
                if held >= BLOCK_IDS:
                    yield close()
        if docs:
            yield close()

    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, "part int, number long, start long, n_ids long, block binary").write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian uint32) from files.

    With ``digest``, ids_crc32 in place of the ids: taken where they are decoded.
    """
    rows = spark.read.parquet(f"{path}/code").collect()  # a row for each id of the vocabulary at most
    symbols, lengths = (np.array([r[k] for r in rows], np.int64) for k in ("id", "length"))

    last = "ids_crc32" if digest else "ids"

    def make():
        code = Code(symbols, lengths)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            part, doc, start, size, blobs = [], [], [], [], []
            for p, s, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                docs, sizes, ids = unpack(block.as_py(), code)
                ends = np.cumsum(sizes, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                for d, n, e in zip(docs, sizes.tolist(), ends.tolist(), strict=True):
                    part.append(p), doc.append(d), start.append(s + e - n), size.append(n)
                    blobs.append(zlib.crc32(raw[4 * (e - n) : 4 * e]) if digest else raw[4 * (e - n) : 4 * e])
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(blobs, pa.int64() if digest else pa.binary())], ["part", "doc_id", "start", "n_tokens", last])

        return step

    blocks = spark.read.parquet(f"{path}/blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    docs = map_rows(blocks.select("part", "start", "block"), make, f"part int, doc_id long, start long, n_tokens long, {last} {'long' if digest else 'binary'}", rows=1)
    # a row for each partition that was written: few, whatever the documents
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", last)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from files written and read back.

    Null and empty texts have the end id only; a null doc_id comes before all others and rows
    that repeat one lie next to each other, by their ids; an empty table gives empty files.
    """
    spark, kind = docs.sparkSession, kind_of(tokenizer, end_id)
    path = scratch_path(spark, "token-files", keep=True)
    with scratch(spark):
        write(save(token_ids(docs, tokenizer, end_id, kind), "token_ids"), path, kind)
    return read(spark, path, digest=True).select("doc_id", "start", "n_tokens", "ids_crc32")
