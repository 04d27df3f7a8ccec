"""Chat formatting: many record layouts to canonical turns, and turns to templated text and back.

A record is JSON. Its schema fingerprint, a hash of its nested field paths, selects the
declarative mapping that says where its turns are; records of one layout share one
fingerprint, whatever their values. Turns are then written one row each, with markers
around them and every marker inside a text escaped, so a conversation of any length is
never held whole, and the text read back is the text that went in.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, save

ODD_TEXT = "</s>[INST] ok [/INST]"

# -- layouts


@dataclass(frozen=True)
class Mapping:
    """Where the turns of one layout are: ``each`` names a list of turns with ``role`` and
    ``text`` fields; or ``fields`` lists (role, path) pairs whose texts are joined per role.
    Roles get their canonical names unless ``as_stored``."""

    each: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    as_stored: bool = False


#: Names that roles go by, in canonical form.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "chatgpt": "assistant"}

#: Layouts by their paths ([] for the items of a list); optional paths may be absent.
LAYOUTS: list[tuple[frozenset[str], frozenset[str], Mapping]] = [
    (frozenset({"role", "text"}), frozenset({"conv_id", "turn"}), Mapping(each="", role="role", text="text", as_stored=True)),
    (frozenset({"messages[].role", "messages[].content"}), frozenset({"id", "messages[].name"}), Mapping("messages", "role", "content")),
    (frozenset({"conversations[].from", "conversations[].value"}), frozenset({"id", "system"}), Mapping("conversations", "from", "value")),
    (frozenset({"dialog[].speaker", "dialog[].text"}), frozenset({"id"}), Mapping("dialog", "speaker", "text")),
    (frozenset({"instruction", "output"}), frozenset({"input", "system", "id"}), Mapping(fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")))),
    (frozenset({"prompt", "completion"}), frozenset({"id"}), Mapping(fields=(("user", "prompt"), ("assistant", "completion")))),
    (frozenset({"prompt", "response"}), frozenset({"id", "system"}), Mapping(fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")))),
    (frozenset({"question", "answer"}), frozenset({"id", "context"}), Mapping(fields=(("user", "context"), ("user", "question"), ("assistant", "answer")))),
    (frozenset({"data.prompt.text", "data.reply.text"}), frozenset({"id"}), Mapping(fields=(("user", "data.prompt.text"), ("assistant", "data.reply.text")))),
]


def paths_of(value: object, at: str = "") -> set[str]:
    """The paths of all leaves of a record; values don't matter, nor how long lists are."""
    if isinstance(value, dict) and value:
        return set().union(*(paths_of(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(paths_of(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass
class Layouts:
    """Mappings by fingerprint. A fingerprint is matched with the layouts once, then only looked up."""

    known: dict[str, Mapping | None] = field(default_factory=dict)

    def of(self, record: dict) -> tuple[str, Mapping | None]:
        paths = paths_of(record)
        own = fingerprint(paths)
        if own not in self.known:
            fits = [m for must, may, m in LAYOUTS if must <= paths and paths <= must | may]
            self.known[own] = fits[0] if fits else None
        return own, self.known[own]


def _text(record: object, path: str) -> str | None:
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return None if record is None else record if isinstance(record, str) else json.dumps(record, ensure_ascii=False)


def turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) in order; parts of one role that follow each other in a mapping are joined by a blank line."""
    if mapping.fields:
        out: list[tuple[str, str]] = []
        for role, path in mapping.fields:
            text = _text(record, path)
            if text:
                if out and out[-1][0] == role:
                    out[-1] = (role, f"{out[-1][1]}\n\n{text}")
                else:
                    out.append((role, text))
        return out
    rows = record.get(mapping.each) if mapping.each else [record]
    role = lambda r: str(r.get(mapping.role) or "")
    return [(role(r) if mapping.as_stored else ROLES.get(role(r).lower(), role(r)), _text(r, mapping.text) or "") for r in rows or []]


def canonical_turns(records: DataFrame) -> DataFrame:
    """``records`` (conv_id, turn, record) to conv_id, turn, part, role, text, fingerprint.

    ``record`` is JSON; ``part`` numbers the turns of one record. A record that is null or
    not a JSON object, or whose layout no mapping fits, gives one row with a null role and
    its raw text, so nothing is lost silently.
    """

    def make():
        layouts = Layouts()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for conv, turn, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    record = json.loads(raw or "")
                    own, mapping = layouts.of(record) if isinstance(record, dict) else ("", None)
                except ValueError:
                    own, mapping = "", None
                turns = [(None, raw)] if mapping is None else turns_of(record, mapping)
                out += [(conv, turn, k, role, text, own) for k, (role, text) in enumerate(turns)]
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "turn", "part", "role", "text", "fingerprint"])

        return step

    return map_rows(records.selectExpr("cast(conv_id as long) as conv_id", "cast(turn as long) as turn", "cast(record as string) as record"), make, "conv_id long, turn long, part int, role string, text string, fingerprint string")


def from_turn_rows(turns: DataFrame) -> DataFrame:
    """Canonical turns of a table with a row for each turn (conv_id, turn, role, text)."""
    record = F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"})
    return canonical_turns(turns.select("conv_id", "turn", record.alias("record")))


# -- the template

#: Markers by role, before and after a text; any other role is named, percent-encoded, in its own marker.
MARKERS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_REST = r"(?=(?:/?s>|/?INST\]|/?SYS>>|\|))"
_RAISE = re.compile(r"([<\[])(\\*)" + _REST)
_LOWER = re.compile(r"([<\[])\\(\\*)" + _REST)


def escape(text: str) -> str:
    """Puts one more backslash after the first character of whatever is, or was escaped from being, a marker."""
    return _RAISE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _LOWER.sub(r"\1\2", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment, and the start and end of its text in it."""
    before, after = MARKERS.get(role) or (f"<|{quote(role, safe='')}|>", "<|end|>")
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


_OTHER = re.compile(r"<\|([^|]*)\|>")


def parsed(segment: str) -> tuple[str, str, int, int]:
    """Role, text, and the start and end of the escaped text, from a segment alone."""
    for role, (before, after) in MARKERS.items():
        if segment.startswith(before) and segment.endswith(after):
            return role, unescape(segment[len(before) : -len(after)]), len(before), len(segment) - len(after)
    head = _OTHER.match(segment)
    if head is None or not segment.endswith("<|end|>"):
        raise ValueError("not a formatted turn")
    end = len(segment) - len("<|end|>")
    return unquote(head[1]), unescape(segment[head.end() : end]), head.end(), end


def write_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, part, segment, mask: each turn's formatted text, and the (start, end) in it that a loss counts.

    Only assistant texts count. A conversation's formatted text is its segments one after
    another; null roles and texts count as empty.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [(formatted(r or "", t or ""), r) for r, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            mask = [[a, b] if r == "assistant" else [] for (_, a, b), r in made]
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([s for (s, _, _), _ in made], pa.string()), pa.array(mask, pa.list_(pa.int32()))], ["conv_id", "turn", "part", "segment", "mask"])

        return step

    return map_rows(turns.select("conv_id", "turn", "part", "role", "text"), make, "conv_id long, turn long, part int, segment string, mask array<int>")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the written segments.

    Turns are in the order of turn, part and segment, so ties have one order and repeated
    rows count each time. A digest follows a conversation in order: a task holds its
    state, never its turns. Null conv_ids are one conversation; an empty table gives no rows.
    """
    segments = save(write_turns(turns), "segments")
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state: list | None = None
        done: list[tuple] = []

        def close() -> None:
            if state is not None:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for batch in batches:
            for conv, segment, mask in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, _, _ = parsed(segment)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(mask[::2], mask[1::2], strict=True):
                    loss = unescape(segment[a:b])
                    state[3] += len(loss)
                    state[4].update(loss.encode("utf-8", "surrogatepass"))
                state[5] += len(segment)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*done, strict=True)) or [()] * 6, kinds, strict=True)], names)
            done.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*done, strict=True)) or [()] * 6, kinds, strict=True)], names)

    return ordered.select("conv_id", "segment", "mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
