"""SentencePiece BPE encoding and decoding, exact, by backtracking over longest matches.

A sequence of pieces is what merging gives if and only if each two neighbours are what
merging their joined text gives. So the encoder takes the longest piece at each place
(Aho-Corasick), checks it against its left neighbour by merging the two again, tries the
next shorter piece if they don't fit, steps back if none does, and keeps a bitfield of
places from which it has failed.

A merge can't cross a place that no piece crosses. No piece of such a model goes on past
a word into the next word mark, so texts are cut there into words, which repeat, and
their encodings are kept in a bounded table. The property is read from the vocabulary;
a model without it has its texts encoded whole.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import map_rows

MARK = "▁"
#: Encodings of words that a task keeps, at most, and of words up to so many characters.
MOST_WORDS, MOST_CHARS = 150_000, 64
#: Pairs of pieces whose fit a task keeps, at most.
MOST_PAIRS = 150_000


def normalizer_is_plain(model: bytes) -> bool:
    """Whether the model's normaliser only writes word marks for spaces, and one before the text.

    Reads the model's normaliser settings (message field 3; its fields 2 to 5 are the
    character map and three switches, all on unless they say otherwise). The library's
    normalize() gives the same for such models, some ten times slower.
    """

    def fields(data: bytes):
        at = 0

        def number() -> int:
            nonlocal at
            out = shift = 0
            while True:
                b = data[at]
                at += 1
                out |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return out

        while at < len(data):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            else:
                size = {1: 8, 5: 4}.get(tag & 7) or number()
                yield tag >> 3, data[at : at + size]
                at += size

    settings = dict(fields(next((v for k, v in fields(model) if k == 3), b"")))
    return not settings.get(2) and bool(settings.get(3, 1)) and not settings.get(4, 1) and bool(settings.get(5, 1))


class PieceCodec:
    """Encoder and decoder of one sentencepiece BPE model with byte fallback."""

    def __init__(self, model_file: str) -> None:
        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.plain = normalizer_is_plain(sp.serialized_model_proto())
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(sp.is_byte, self.byte_ids)):
            raise ValueError("the model has no byte fallback")
        self.end_id = sp.eos_id()
        self.find = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.find.add_word(piece, (len(piece), i))
        self.find.make_automaton()
        self.pieces = {i: piece for piece, i in self.ids.items()}
        self.fits: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        whole = any(MARK in piece.lstrip(MARK) for piece in self.ids)
        self.cut = re.compile(r"[\s\S]+" if whole else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.text = [b""] * n
        for i in range(n):
            if i in self.byte_ids:
                continue
            if sp.is_unknown(i):
                self.text[i] = b" \xe2\x81\x87 "
            elif not sp.is_control(i):
                self.text[i] = sp.id_to_piece(i).replace(MARK, " ").encode()
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}

    # -- merging, as the library orders it: best score first, leftmost among equals

    def merged(self, text: str) -> list[str]:
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fit(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two pieces gives them again; left is -1 at an edge."""
        l, r = self.pieces.get(left, ""), self.pieces[right]
        if len(self.fits) >= MOST_PAIRS:
            self.fits.clear()
        out = self.fits[left << 32 | right] = self.merged(l + r) == ([l, r] if l else [r])
        return out

    # -- backtracking

    def word(self, text: str) -> list[int]:
        """The ids of a text, as merging all of it gives them."""
        n, fits = len(text), self.fits
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # pieces at each place, longer ones last
        for end, found in self.find.iter(text):
            starts[end - found[0] + 1].append(found)
        failed = bytearray(n + 1)  # places from which no fitting sequence leads on
        out: list[int] = []  # ids; -1 for a character that is in no piece
        tried: list[int] = []  # how many shorter pieces are left to try at each of them
        at, left, k = 0, -1, len(starts[0]) if n else 0
        while at < n:
            here = starts[at]
            if not here:
                # Alone: no merge takes in a character that is in no piece.
                out.append(-1)
                tried.append(0)
                at, left = at + 1, -1
                k = len(starts[at]) if at < n else 0
                continue
            while k:
                k -= 1
                length, piece = here[k]
                if not failed[at + length]:
                    fit = fits.get(left << 32 | piece)
                    if fit or fit is None and self.fit(left, piece):
                        out.append(piece)
                        tried.append(k)
                        at, left = at + length, piece
                        k = len(starts[at]) if at < n else 0
                        break
            else:
                failed[at] = 1
                if not out or out[-1] < 0:  # what merging gives always fits; should a model be otherwise, all of it is merged
                    out = [self.ids.get(p, -1) for p in self.merged(text)]
                    break
                at -= len(self.pieces[out.pop()])
                k = tried.pop()
                left = out[-1] if out else -1
        if -1 not in out:
            return out
        ids: list[int] = []
        at = 0
        for i in out:
            if i >= 0:
                ids.append(i)
                at += len(self.pieces[i])
            else:
                ids += [self.byte_ids[b] for b in text[at].encode("utf-8", "replace")]
                at += 1
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        words = self.words
        if not self.plain:
            text = self.model.normalize(text)
        elif text:
            text = MARK + text.replace(" ", MARK)
        for w in self.cut.findall(text):
            ids = words.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= MOST_CHARS:
                    if len(words) >= MOST_WORDS:
                        words.clear()
                    words[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control pieces are silent, one leading space is the encoder's own, runs
        of byte pieces are UTF-8 with U+FFFD for each byte that fits nowhere."""
        text, byte_of = self.text, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            out = b"".join(map(text.__getitem__, ids)).decode()
        else:
            parts: list[str] = []
            run = bytearray()
            for i in ids:
                b = byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(utf8(bytes(run)))
                    run.clear()
                parts.append(text[i].decode())
            parts.append(utf8(bytes(run)))
            out = "".join(parts)
        first = next((i for i in ids if not self.model.is_control(i)), None)
        own = first is not None and first not in byte_of and not self.model.is_unknown(first)
        return out[1:] if own and out.startswith(" ") else out


def utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec for each model and Python worker: building it takes longer than many texts."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, decoded for each row of ``docs``: the ids with an end id, and their text again.

    ``model`` is the name that public_tokenizers.path() finds on every worker. Null texts
    count as empty and have the end id only; other columns are ignored.
    """

    def make():
        import public_tokenizers

        own = codec(public_tokenizers.path(model))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [own.encode(t or "") + [own.end_id] for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

        return step

    return map_rows(docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text"), make, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode_documents() with digests taken where the ids are."""

    def make():
        import public_tokenizers

        own = codec(public_tokenizers.path(model))
        names = [str(i) for i in range(len(own.text))]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, a, b = [], [], []
            for t in batch.column(1).to_pylist():
                ids = own.encode(t or "")
                ids.append(own.end_id)
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return map_rows(docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
