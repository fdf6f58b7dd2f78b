"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside a text every
``<``, run of backslashes, ``|`` gets one more backslash, so a text never holds
a control string and the change can be undone; other text stays as it is. In a
role backslashes are doubled and line breaks written ``\\n`` before that.

Segment lengths, running offsets and scatter indices are arrays; headers and
contents are copied into one preallocated buffer that becomes the Arrow column.

Defined cases: a null role or text is empty; turns are ordered by turn, role
and text with nulls first; repeated rows are turns of their own; a null conv_id
is a conversation; an empty table gives no rows; other columns are ignored. A
conversation is one output row, so it must fit a Spark cell (2 GB).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidelake.llm.arrays import utf8

START, END = b"<|im_start|>", b"<|im_end|>\n"
_CONTROL = re.compile(rb"<\\*\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE_ESCAPED = re.compile(r"\\(.)")
#: Bytes of text assembled at a time; one longer conversation goes alone.
ASSEMBLE_BYTES = 8 << 20
SCHEMA = "conv_id bigint, n_turns bigint, formatted string, loss array<struct<start:bigint,end:bigint>>, formatted_chars bigint"


def escape_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Escape control strings in all rows of a buffer at once."""
    found = [(m.start(), m.end()) for m in _CONTROL.finditer(data.tobytes())]
    if not found:
        return data, offsets
    at = np.array(found, np.int64)
    row = np.searchsorted(offsets, at[:, 0], "right") - 1
    places = at[at[:, 1] <= offsets[row + 1], 0] + 1
    return np.insert(data, places, ord("\\")), offsets + np.searchsorted(places, offsets)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str | None) -> bytes:
    raw = (role or "").replace("\\", "\\\\").replace("\n", "\\n").encode()
    return _CONTROL.sub(lambda m: b"<\\" + m[0][1:], raw)


def unescape_role(text: str) -> str:
    return _ROLE_ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: (role, text)."""
    out = []
    for part in formatted.split(START.decode())[1:]:
        role, _, text = part[: -len(END)].partition("\n")
        out.append((unescape_role(role), unescape(text)))
    return out


def _assemble(conv: pa.Array, role: pa.Array, text: pa.Array, firsts: np.ndarray) -> pa.RecordBatch:
    """One output row for each conversation; ``firsts`` holds the first turn of each and the number of turns."""
    n = len(text)
    text_bytes, text_at = escape_bytes(*utf8(text))
    names = role.dictionary_encode()
    heads = [START + escape_role(x) + b"\n" for x in names.dictionary.to_pylist()] + [START + b"\n"]
    codes = np.asarray(pc.fill_null(names.indices, len(heads) - 1)).astype(np.int64)
    head_at = np.concatenate([[0], np.cumsum([len(h) for h in heads])])
    source = np.concatenate([np.frombuffer(b"".join(heads) + END, np.uint8), text_bytes])
    begin = np.empty((n, 3), np.int64)
    length = np.empty((n, 3), np.int64)
    begin[:, 0], length[:, 0] = head_at[codes], np.diff(head_at)[codes]
    begin[:, 1], length[:, 1] = head_at[-1] + len(END) + text_at[:-1], np.diff(text_at)
    begin[:, 2], length[:, 2] = head_at[-1], len(END)
    lengths = length.ravel()
    ends = np.cumsum(lengths)
    starts = ends - lengths
    index = np.arange(ends[-1] if n else 0)
    index += np.repeat(begin.ravel() - starts, lengths)
    out = np.empty(len(index), np.uint8)
    np.take(source, index, out=out)
    chars = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    conv_at = np.concatenate([starts[::3], ends[-1:]])[firsts]
    conv_chars = chars[conv_at]
    is_loss = np.array([x == "assistant" for x in names.dictionary.to_pylist()] + [False])[codes]
    picked = np.flatnonzero(is_loss)
    conv_of = np.searchsorted(firsts, picked, "right") - 1
    base = conv_chars[conv_of]
    spans = pa.StructArray.from_arrays(
        [pa.array(chars[starts[3 * picked + 1]] - base), pa.array(chars[ends[3 * picked + 1]] - base)], ["start", "end"]
    )
    formatted = pa.StringArray.from_buffers(len(firsts) - 1, pa.py_buffer(conv_at.astype(np.int32)), pa.py_buffer(out))
    loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(picked, firsts).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(firsts[:-1])), pa.array(np.diff(firsts)), formatted, loss, pa.array(np.diff(conv_chars))],
        ["conv_id", "n_turns", "formatted", "loss", "formatted_chars"],
    )


def _blocks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Assemble whole conversations, about ``ASSEMBLE_BYTES`` at a time."""
    rows = rows.combine_chunks()
    conv, role, text = (rows.column(c).combine_chunks() for c in ("conv_id", "role", "text"))
    conv = conv if isinstance(conv, pa.Array) else conv.chunk(0)
    ids, null = np.asarray(pc.fill_null(conv, 0)), np.asarray(conv.is_null())
    firsts = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]) | (null[1:] != null[:-1])) + 1, [len(ids)]])
    size = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0)).astype(np.int64) + 64)])
    i = 0
    while i < len(firsts) - 1:
        j = max(i + 1, int(np.searchsorted(size[firsts], size[firsts[i]] + ASSEMBLE_BYTES, "right")) - 1)
        a, b = int(firsts[i]), int(firsts[j])
        yield _assemble(conv.slice(a, b - a), role.slice(a, b - a), text.slice(a, b - a), firsts[i : j + 1] - a)
        i = j


def _format_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation; one that crosses batches is kept until it ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        conv = batch.column("conv_id")
        last = conv[len(conv) - 1].as_py()
        same = pc.is_null(conv) if last is None else pc.fill_null(pc.equal(conv, last), False)
        tail = len(conv) - 1 - int(np.flatnonzero(~np.append(np.asarray(same)[::-1], False))[0]) + 1
        if tail == 0 and (not held or held[-1].column("conv_id")[0].as_py() == last):
            held.append(batch)
            continue
        done = [*held, batch.slice(0, tail)] if tail else held
        held = [batch.slice(tail)]
        yield from _blocks(pa.Table.from_batches(done))
    if held:
        yield from _blocks(pa.Table.from_batches(held))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: formatted text, its length, and the loss spans in code points.

    The loss mask covers each assistant text once, without header and end mark.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    keyed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return keyed.select("conv_id", "role", "text").mapInArrow(_format_partition, SCHEMA)
