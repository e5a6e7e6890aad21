"""Deeply nested semi-structured messages into related flat tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.jsonflat import flatten, heads

#: Bytes of text that one pass of the kernels takes; a longer text is a pass of its own.
PASS_BYTES = 4 << 20


def _passes(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and length of runs of rows that hold about PASS_BYTES."""
    size = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    part = (size[1:].astype(np.int64) - size[0]) // PASS_BYTES
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    yield from ((a, b - a) for a, b in zip(cut, cut[1:]) if b > a)


def _map(lines: DataFrame, key: str, message: str, kernel: Callable[[pa.Array], dict], cols: dict[str, str], keep: str | None = None) -> DataFrame:
    """The rows that a kernel makes of the texts, with the key of each."""
    src = lines.select(F.col(key).cast("bigint").alias(key), F.col(message).cast("string").alias("m")).where("m is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            if texts.type != pa.string():
                texts = texts.cast(pa.string())
            for at, n in _passes(texts) if len(texts) else ():
                r = kernel(texts.slice(at, n))
                if len(r["row"]):
                    out = pa.RecordBatch.from_arrays([ids.slice(at, n).take(pa.array(r["row"])), *(pa.array(r[c]) if isinstance(r[c], np.ndarray) else r[c] for c in cols)], names=[key, *cols])
                    yield out.filter(pa.array(r[keep])) if keep else out

    return src.mapInArrow(run, ", ".join([f"`{key}` bigint", *(f"`{c}` {t}" for c, t in cols.items())]))


def nested_objects(lines: DataFrame, key: str = "line_id", message: str = "message", text: bool = True) -> DataFrame:
    """One row per object that is a list element at any depth of a message that is valid JSON.

    Columns: ``key``; path (keys joined by '.', list positions in brackets); parent_path of
    the nearest such object around it, '' if there is none; block, whether its list is a
    ``content`` list; and with ``text`` the object's own JSON.  A ``content`` that is a
    string or an object counts as a list of one, an ``input`` of a content element that is
    a string as the object it encodes.

    Flattening works on the Arrow buffers of a batch: list offsets and parent indexes come
    from running sums over all bytes at once and keys go down by vectorised take.

    Defined results: null, empty and torn messages, other elements than objects, nulls and
    empty lists give no row; rows that repeat are flattened each; an ``input`` string that
    encodes no object gives no row; a null key stays null; no message is too long, a long
    one is a pass of its own; other columns are not read.

    Scale: a map over the scan without any shuffle.
    """
    cols = {"path": "string", "parent_path": "string", "block": "boolean"} | ({"json": "string"} if text else {})
    return _map(lines, key, message, lambda t: flatten(t, True, text), cols)


_HEAD = ("id", "role", "model", "stop_reason")
_COUNTERS = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
_FIELDS = ("type", "id", "name", "tool_use_id", "text")


def nested_messages(lines: DataFrame, key: str = "line_id", message: str = "message") -> DataFrame:
    """The parent table: one row per message that is a valid object or list, with its scalar fields.

    Counters that are quoted are read as numbers; missing ones are null.  Fields come out of
    the same buffers as the objects; of a key that repeats the last counts.
    """
    m = _map(lines, key, message, lambda t: heads(t, _HEAD, "usage", _COUNTERS), dict.fromkeys((*_HEAD, *_COUNTERS), "string"))
    return m.select(key, *_HEAD, *(F.col(c).try_cast("bigint").alias(c) for c in _COUNTERS))


def nested_blocks(lines: DataFrame, key: str = "line_id", message: str = "message") -> DataFrame:
    """The child table of content blocks, each with the path of its parent row ('' the message)."""
    cols = dict.fromkeys(("path", "parent_path", *_FIELDS), "string")
    return _map(lines, key, message, lambda t: flatten(t, True, False, _FIELDS), cols, "block")
