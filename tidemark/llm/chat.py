"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "<s>" header body "</s>\\n"
    header       := "[INST]" (user) | "[OUT]" (assistant) | "[SYS]" (system) | "[ROLE:" hex "]"
    body         := text without control strings

The parser is deterministic and rejects a body that holds a control string. A conversation is
first rendered with its texts as they are, parsed again and compared with the source; turns
that conflict are escaped, until what is recovered is identical. Escaping puts one more
backslash after the bracket that opens a control string, so it is reversible at any depth.

Rows of a conversation meet in one task, sorted, and are streamed: memory holds one
conversation, which is one row of the result.

Defined cases: null text or role is the empty string; rows go by turn (null first), ties by role
and text; repeated rows are turns of their own; a null conv_id is a conversation like others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADERS = {"user": "[INST]", "assistant": "[OUT]", "system": "[SYS]"}
_TAIL = r"/?s>|/?INST\]|/?OUT\]|/?SYS\]|ROLE:"
_CONTROL = re.compile(rf"[<\[](?:{_TAIL})")
_ESCAPE = re.compile(rf"([<\[]\\*)(?={_TAIL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_TAIL})")
_HEADER = re.compile(r"<s>\[(?:(INST|OUT|SYS)|ROLE:([0-9a-f]*))\]")
_ROLES = {"INST": "user", "OUT": "assistant", "SYS": "system"}


class FormatError(ValueError):
    """The text is no sentence of the grammar."""


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1" + "\\\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]], escaped: list[bool]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the assistant's bodies in it, the loss mask."""
    parts, spans, at = [], [], 0
    for (role, text), guard in zip(turns, escaped, strict=True):
        head = "<s>" + (HEADERS.get(role) or f"[ROLE:{role.encode('utf-8', 'surrogatepass').hex()}]")
        body = escape(text) if guard else text
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</s>\n"]
        at += len(head) + len(body) + 5
    return "".join(parts), spans


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    turns, at = [], 0
    while at < len(text):
        head = _HEADER.match(text, at)
        end = text.find("</s>\n", head.end()) if head else -1
        if end < 0:
            raise FormatError(f"no turn at {at}")
        body = text[head.end() : end]
        if _CONTROL.search(body):
            raise FormatError(f"control string in the turn at {at}")
        turns.append((_ROLES[head[1]] if head[1] else bytes.fromhex(head[2]).decode("utf-8", "surrogatepass"), unescape(body)))
        at = end + 5
    return turns


def _survives(turns: list[tuple[str, str]], escaped: list[bool]) -> bool:
    try:
        return parse(render(turns, escaped)[0]) == turns
    except FormatError:
        return False


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Render, reparse, compare; escape what conflicts until the source comes back."""
    escaped = [False] * len(turns)
    if not _survives(turns, escaped):
        escaped = [not _survives([t], [False]) for t in turns]
        if not _survives(turns, escaped):
            escaped = [True] * len(turns)
    formatted, spans = render(turns, escaped)
    if parse(formatted) != turns:
        raise FormatError("the conversation cannot be recovered")
    return formatted, spans


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "formatted", "loss_spans"]
    kinds = None
    done: list[tuple] = []
    conv, turns, size = None, None, 0
    for batch in batches:
        kinds = [batch.schema.field("conv_id").type, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        ids, roles, texts = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("conv_id", "role", "text"))
        for i, role, text in zip(ids, roles, texts, strict=True):
            if turns is None or i != conv:
                if turns is not None:
                    done.append((conv, *format_turns(turns)))
                    size += len(done[-1][1])
                conv, turns = i, []
            turns.append((role, text))
            if size > 4_000_000:
                yield _batch(done, names, kinds)
                done, size = [], 0
    if turns is not None:
        done.append((conv, *format_turns(turns)))
        yield _batch(done, names, kinds)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    spans = [[{"start": a, "end": b} for a, b in r[2]] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kinds[0]), pa.array([r[1] for r in rows], kinds[1]), pa.array(spans, kinds[2])], names)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (in code points of formatted) for each conversation."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_assemble, f"conv_id {kind}, formatted string, loss_spans array<struct<start: bigint, end: bigint>>")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digests, chars, losses, sizes = [], [], [], [], []
        for formatted, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns = parse(formatted)
            loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
            n.append(len(turns))
            digests.append(hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode("utf-8", "surrogatepass")).hexdigest())
            chars.append(len(loss))
            losses.append(hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest())
            sizes.append(len(formatted))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(chars, pa.int64()), pa.array(losses, pa.string()), pa.array(sizes, pa.int64())],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the loss text, both read back from the formatted output."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_read_back, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
