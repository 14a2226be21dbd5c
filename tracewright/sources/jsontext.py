"""JSON texts of any depth and length, walked token by token.

The stack holds one entry for each open container, so neither depth nor length is limited; what is
emitted are slices of the text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("[^"\\\x00-\x1f]*(?:\\.[^"\\\x00-\x1f]*)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))', re.DOTALL)
FLUSH_ROWS, FLUSH_CHARS = 4096, 8 << 20


class Node:
    """An open container: its name in its parent, where it starts, and the place or key inside it."""
    __slots__ = ("is_object", "segment", "leaf", "start", "place", "key", "seen", "members")

    def __init__(self, is_object: bool, segment: str, leaf: str | None, start: int):
        self.is_object, self.segment, self.leaf, self.start = is_object, segment, leaf, start
        self.place, self.key, self.seen, self.members = 0, None, set() if is_object else None, {}


def walk(text: str) -> Iterator[tuple[Node | None, list[Node], str, str, int, int]]:
    """(node, open containers, segment, leaf, start, end) of every scalar (node None) and, when it closes, container.

    ``segment`` names the value in its parent and ``leaf`` the nearest key above it.  What follows the first
    value is not looked at.  Malformed texts and objects that repeat a key raise ValueError.
    """
    at, stack = 0, []
    expect = "value"  # value, first (value or end), key, first key, colon, more
    while True:
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(at)
        mark, quoted, literal = found.groups()
        start, at = found.start(found.lastindex), found.end()
        top = stack[-1] if stack else None
        if expect in ("key", "first key"):
            if quoted:
                key = json.loads(quoted)
                if key in top.seen:
                    raise ValueError(at)
                top.seen.add(key)
                top.key, expect = key, "colon"
                continue
            if mark != "}" or expect == "key":
                raise ValueError(at)
        elif expect == "colon":
            if mark != ":":
                raise ValueError(at)
            expect = "value"
            continue
        elif expect == "more":
            if mark == ",":
                expect = "key" if top.is_object else "value"
                continue
            if mark != ("}" if top.is_object else "]"):
                raise ValueError(at)
        elif mark not in (None, "{", "[") and not (expect == "first" and mark == "]"):
            raise ValueError(at)
        if mark in ("}", "]"):
            stack.pop()
            yield top, stack, top.segment, top.leaf, top.start, at
        else:
            segment, leaf = ("", None) if top is None else (top.key, top.key) if top.is_object else (f"[{top.place}]", top.leaf)
            if top is not None:
                top.place += 1
            if mark:
                stack.append(Node(mark == "{", segment, leaf, start))
                expect = "first key" if mark == "{" else "first"
                continue
            yield None, stack, segment, leaf, start, at
        if not stack:
            return
        expect = "more"


def joined(base: str, stack: list[Node], segment: str) -> str:
    """The path of a value below ``base``: keys parted by points, places in brackets."""
    out, empty = [base], base == ""
    for parent, name in zip(stack, [n.segment for n in stack[1:]] + [segment]):
        out.append(f".{name}" if parent.is_object and not empty else name)
        empty = empty and not name
    return "".join(out)


def scalars(text: str, base: str, leaf: str) -> Iterator[tuple]:
    """(path, leaf, literal, whether it is a container) of every scalar."""
    for node, stack, segment, own, start, end in walk(text):
        if node is None:
            yield joined(base, stack, segment), leaf if own is None else own, text[start:end], False


def named(keys: frozenset[str], lower: bool) -> Callable:
    """Every value, containers too, whose nearest key is among ``keys``."""
    def find(text: str, base: str, leaf: str) -> Iterator[tuple]:
        for node, stack, segment, own, start, end in walk(text):
            name = leaf if own is None else own
            if (name.lower() if lower else name) in keys:
                yield joined(base, stack, segment), name, text[start:end], node is not None
    return find


def records(fields: frozenset[str]) -> Callable:
    """Every object, as an object of those members that are among ``fields``; containers as texts."""
    def find(text: str, base: str, leaf: str) -> Iterator[tuple]:
        for node, stack, segment, own, start, end in walk(text):
            if stack and stack[-1].is_object and segment in fields:
                stack[-1].members[segment] = text[start:end] if node is None else json.dumps(text[start:end])
            if node is not None and node.members:
                yield joined(base, stack, segment), leaf if own is None else own, "{" + ",".join(f"{json.dumps(k)}:{v}" for k, v in node.members.items()) + "}", False
    return find


def each(find: Callable, keep: int, schema: pa.Schema):
    """An Arrow map of rows (keep..., path, leaf, text, inner) to rows (keep..., path, leaf, literal, container).

    Malformed texts give none; of an ``inner`` text the outermost value is left out.
    """
    def batch_of(source, rows):
        at, path, leaf, literal, container = zip(*rows)
        take = pa.array(np.array(at, np.int64))
        return pa.RecordBatch.from_arrays([*(c.take(take) for c in source.columns[:keep]), pa.array(path, pa.string()), pa.array(leaf, pa.string()),
                                           pa.array(literal, pa.string()), pa.array(container, pa.bool_())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i, (path, leaf, text, inner) in enumerate(zip(*(c.to_pylist() for c in batch.columns[keep:]))):
                if not well_formed(text):
                    continue
                for found in find(text, path, leaf):
                    if inner and found[0] == path:
                        continue
                    rows.append((i, *found))
                    size += len(found[0]) + len(found[2])
                    if len(rows) >= FLUSH_ROWS or size >= FLUSH_CHARS:
                        yield batch_of(batch, rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(batch, rows)
    return run


def well_formed(text: str | None) -> bool:
    try:
        return text is not None and sum(1 for _ in walk(text)) > 0
    except ValueError:
        return False
