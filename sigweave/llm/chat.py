"""Chat formatting: records of any known layout, by a fingerprint of their fields, to one template.

A record is a JSON object. Its fingerprint is the hash of its sorted field paths (array
indices as `[]`); a table of declarative mappings says for each fingerprint which paths hold
which turns: fields that are a turn each, or a list with a role and a text field. Optional
fields give more fingerprints for one mapping. A record of no known fingerprint is
kept with its fingerprint and no turns.

The template is, for each turn, `### Role:` and a line feed, the text with its control
strings escaped, `</turn>` and a line feed. Escaping puts a backslash before each
backslash, `###` and `</turn>` of a text, so that it is undone by taking the character
after each backslash as it is, and no text can open or close a turn. The loss mask is a list of (start, length) spans in
code points of the formatted string, one for each assistant turn and over its escaped text.

Null text is empty text; a null role is `unknown`. A conversation's rows are taken by
turn, then role, then text, nulls first; repeated rows are turns of their own. A null id is a conversation of its own.
An empty table gives no conversations. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, COLON, CLOSE = "### ", ":\n", "</turn>\n"
_ESCAPED = re.compile(r"\\|###|</turn>")
_TURN = re.compile(r"### ((?:\\.|[^\\:\n])*):\n((?:\\.|(?!</turn>)[^\\])*)</turn>\n", re.S)


@dataclass(frozen=True)
class Mapping:
    """How the turns of a layout are found: `parts` are (path, role) of fields that are a turn each,
    several paths of a role in a row being joined by an empty line; `turns` is (list, role field, text field)."""

    parts: tuple[tuple[str, str], ...] = ()
    turns: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        out = [p for p, _ in self.parts]
        if self.turns:
            at, role, text = self.turns
            out += [f"{at}[].{role}", f"{at}[].{text}"]
        return out


MAPPINGS = (
    Mapping(turns=("messages", "role", "content")),
    Mapping(turns=("conversations", "from", "value")),
    Mapping(parts=(("system", "system"),), turns=("conversations", "from", "value"), optional=("system",)),
    Mapping(parts=(("system", "system"),), turns=("messages", "role", "content"), optional=("system",)),
    Mapping(parts=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Mapping(parts=(("prompt", "user"), ("completion", "assistant"))),
    Mapping(parts=(("question", "user"), ("answer", "assistant"))),
    Mapping(parts=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=("system", "input")),
    Mapping(parts=(("data.prompt.text", "user"), ("data.response.text", "assistant"))),
)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def paths(value: object, at: str = "") -> set[str]:
    """Paths of the leaves of a JSON value. A null leaf counts as absent."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value))
    return set() if value is None else {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def _known() -> dict[str, Mapping]:
    out: dict[str, Mapping] = {}
    for m in MAPPINGS:
        for n in range(len(m.optional) + 1):
            for left_out in combinations(m.optional, n):
                out.setdefault(fingerprint(set(m.paths()) - set(left_out)), m)
    return out


KNOWN = _known()


def _get(value: object, path: str) -> object:
    for k in path.split("."):
        value = value.get(k) if isinstance(value, dict) else None
    return value


def turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """Canonical (role, text) turns of a record."""
    out: list[tuple[str, str]] = []
    for path, role in mapping.parts:
        if (v := _get(record, path)) is None:
            continue
        if out and out[-1][0] == role:
            out[-1] = role, f"{out[-1][1]}\n\n{v}" if v else out[-1][1]
        else:
            out.append((role, str(v)))
    if mapping.turns:
        at, role, text = mapping.turns
        named = ROLES if role == "from" else {}  # other layouts say what they mean
        out += [(named.get(r := str(t.get(role) or "unknown"), r), str(t[text] if t.get(text) is not None else "")) for t in _get(record, at) or []]
    return out


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the spans under the loss mask."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body = OPEN + escape(role).replace(":", "\\:").replace("\n", "\\\n") + COLON, escape(text)
        if role == "assistant":
            mask.append((at + len(head), len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def records(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, record) of each conversation of (id, turn, role, text) rows, in the `messages` layout.

    A conversation's rows come together in the task that builds its record, which holds them all in any case.
    """
    turn = F.struct("turn", "role", "text")
    listed = F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("content")))
    return rows.groupBy(id_col).agg(listed.alias("messages")).select(id_col, F.to_json(F.struct("messages")).alias("record"))


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def format_records(frame: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """(id, fingerprint, formatted, loss_mask); the last two are null for a layout that no mapping has, or text that is no JSON object."""
    kind = frame.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                out = []
                for text in part.column(1).to_pylist():
                    try:
                        record = json.loads(text or "")
                    except ValueError:
                        record = None
                    if not isinstance(record, dict):
                        out.append((None, None, None))
                        continue
                    key = fingerprint(paths(record))
                    if (mapping := KNOWN.get(key)) is None:
                        out.append((key, None, None))
                        continue
                    said, mask = render(turns_of(record, mapping))
                    out.append((key, said, [{"start": s, "length": n} for s, n in mask]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], _SPANS)], names=[id_col, "fingerprint", "formatted", "loss_mask"])

    return frame.select(frame[id_col], frame[record_col]).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string, formatted string, loss_mask array<struct<start: bigint, length: bigint>>")


def read_back(frame: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, formatted, turns, loss_text) of formatted conversations: what the template and the mask say, unescaped."""
    kind = frame.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                turns, loss = [], []
                for said, mask in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    turns.append(None if said is None else [{"role": r, "content": t} for r, t in parse(said)])
                    loss.append(None if said is None else "".join(unescape(said[x["start"] : x["start"] + x["length"]]) for x in mask))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(turns, _TURNS), pa.array(loss, pa.string())], names=[id_col, "formatted", "turns", "loss_text"])

    return frame.select(frame[id_col], "formatted", "loss_mask").mapInArrow(run, f"`{id_col}` {kind}, formatted string, turns array<struct<role: string, content: string>>, loss_text string")
