"""Deeply nested JSON records to related flat tables.

Each record is stream-parsed by an iterative scanner (no recursion, so depth is no limit; what is held is the way down to
the place of reading) into triples ``(path, value, ordinal)``. Paths are grouped by their nearest repeated ancestor: every array of objects is a table of
its own, ``structure`` and all ``nodes`` below it are one recursive table ``node``, and what is not repeated belongs to
the table above it under a dotted path. :func:`pivot` turns the triples of one group into a flat table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pseudo path: one triple per row of a table, whose value is the row number of the parent (-1 at the top).
PARENT = "@parent"

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|(")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity))')
_SPACE = re.compile(r"[ \t\n\r]*\Z")
_FENCE = re.compile(r"\A```[a-zA-Z]*\s*\n(.*)\n\s*```\Z", re.S)

Triple = tuple[str, int, str, int, str, int, str | None]


class Damaged(ValueError):
    """The text is not one whole JSON document."""


def events(text: str) -> Iterator[tuple[str, object]]:
    """("{" | "}" | "[" | "]" | "key" | "value", payload) of one whole JSON document; raises :class:`Damaged`."""
    at, stack, state = 0, [], "value"  # state: value | first (value or ]) | key | firstkey (key or }) | colon | next
    match, end = _TOKEN.match, len(text)
    while True:
        m = match(text, at)
        if m is None:
            raise Damaged(f"no token at {at}")
        at = m.end()
        mark, quote, scalar = m.groups()
        value: object = None
        if quote:
            try:
                value, at = scanstring(text, at, True)
            except ValueError as e:
                raise Damaged(str(e)) from None
        if state in ("value", "first"):
            if mark == "{":
                stack.append("{")
                state = "firstkey"
                yield "{", None
                continue
            if mark == "[":
                stack.append("[")
                state = "first"
                yield "[", None
                continue
            if mark == "]" and state == "first":
                stack.pop()
                yield "]", None
            elif quote:
                yield "value", value
            elif scalar:
                yield "value", None if scalar == "null" else _Bare(scalar)
            else:
                raise Damaged(f"unexpected {mark} at {at}")
            state = "next"
        elif state in ("key", "firstkey"):
            if quote:
                yield "key", value
                state = "colon"
                continue
            if mark == "}" and state == "firstkey":
                stack.pop()
                yield "}", None
                state = "next"
            else:
                raise Damaged(f"no key at {at}")
        elif state == "colon":
            if mark != ":":
                raise Damaged(f"no colon at {at}")
            state = "value"
            continue
        elif mark == ",":
            state = "key" if stack[-1] == "{" else "value"
            continue
        elif mark == "}" and stack[-1] == "{" or mark == "]" and stack[-1] == "[":
            stack.pop()
            yield mark, None
        else:
            raise Damaged(f"unexpected token at {at}")
        if not stack:
            if not _SPACE.match(text, at, end):
                raise Damaged(f"more text at {at}")
            return


class _Bare(str):
    """A number, true or false, as written."""


def unwrap(text: str) -> str:
    """The text of the record itself: without byte order mark, code fence and levels of string quoting."""
    while True:
        text = text.strip("\ufeff \t\n\r")
        if fence := _FENCE.match(text):
            text = fence[1]
        elif text[:1] == '"':
            ((_, text),) = events(text)
        else:
            return text


def triples(text: str | None, root: str = "structure", children: str = "nodes", table_name: str = "node", *, bare: bool = False) -> Iterator[Triple]:
    """(table, row, parent table, parent row, path, ordinal, value) of one record, or nothing if it is damaged.

    Rows of a table are numbered from 0 in document order, a node before its children. Path :data:`PARENT` stands once
    per row. Objects under ``root`` of the record and under ``children`` of a node are rows of ``table_name``; one
    object in place of a list counts as a list of one; nulls and other values there are none. The record is the
    outermost object that has ``root``, under whatever keys and lists it is wrapped (of several equally far in, the first;
    all elements of a list count). With ``bare`` a document without ``root`` may also be a list of nodes, or have
    ``children`` in its place. Triples come as they are read: what is held is the way down to the place of reading.
    """
    if text is None:
        return
    try:
        text = unwrap(text)
        for _ in events(text):  # a damaged record gives no triple, also before the place of the damage
            pass
    except Damaged:
        return
    spot = _locate(text, root)
    if spot is None and bare:
        if text[:1] != "[" and _locate(text, children) == ():
            root, spot = children, ()
        elif text[:1] == "[":
            yield from _triples(text, (), root, children, table_name, "list")
            return
    yield from _triples(text, spot or (), root, children, table_name, "top")


def _locate(text: str, key: str) -> tuple[str | None, ...] | None:
    """Keys (None: any element of a list) that lead to the outermost object with ``key``, whatever stands under it."""
    best: tuple[str | None, ...] | None = None
    way: list[str | None] = []  # the key, or None in a list, that each open bracket but the first stands under
    opened: list[str] = []
    last = None
    for kind, value in events(text):
        if kind == "key":
            last = value
            if value == key and (best is None or len(way) < len(best)):
                best = tuple(way)
                if not way:
                    return best
        elif kind in ("{", "["):
            if opened:
                way.append(last if opened[-1] == "{" else None)
            opened.append(kind)
        elif kind in ("}", "]"):
            opened.pop()
            if way:
                way.pop()
    return best


def _triples(text: str, spot: tuple[str | None, ...], root: str, children: str, table_name: str, outer: str) -> Iterator[Triple]:
    yield ("record", 0, "", -1, PARENT, 0, "-1")
    count: dict[str, int] = {}
    # A frame: [bracket, table, row, path within the row, role, elements so far]
    # Roles: top (on the way to the record, or the record), list (of nodes), node, field, other (no nodes and no fields).
    frames: list[list] = []
    key = ""

    def next_row(table: str) -> int:
        count[table] = count.get(table, -1) + 1
        return count[table]

    for kind, value in events(text):
        if kind == "key":
            key = value
            continue
        if kind in ("}", "]"):
            frames.pop()
            continue
        if not frames:
            if kind != "value":
                frames.append([kind, "record", 0, "", outer, 0])
            continue
        bracket, table, row, path, role, ordinal = top = frames[-1]
        in_list = bracket == "["
        name = path if in_list else f"{path}.{key}" if path else key
        top[5] += in_list
        here = role == "top" and len(frames) == len(spot) + 1
        nodes = not in_list and (here and key == root or role == "node" and key == children)
        if kind == "value":
            if not nodes and role not in ("list", "other"):
                yield (table, row, "", -1, name, ordinal, None if value is None else str(value))
        elif nodes and kind == "[":
            frames.append(["[", table, row, "", "list", 0])
        elif nodes or role == "list" and kind == "{":
            parent = row if table == table_name else -1
            own = next_row(table_name)
            yield (table_name, own, table, parent, PARENT, 0, str(parent))
            frames.append(["{", table_name, own, "", "node", 0])
        elif role in ("list", "other"):
            frames.append([kind, table, row, "", "other", 0])
        elif role == "top" and not here and spot[len(frames) - 1] == (None if in_list else key):
            frames.append([kind, table, row, "", "top", 0])
        elif kind == "{" and in_list and path:
            inner = path if table == "record" else f"{table}.{path}"
            own = next_row(inner)
            yield (inner, own, table, row, PARENT, 0, str(row))
            frames.append(["{", inner, own, "", "field", 0])
        else:
            frames.append([kind, table, row, name, "field", 0])


def shred(df: DataFrame, key: str, payload: str, *, tables: Sequence[str] | None = None, paths: Sequence[str] | None = None, bare: bool = False) -> DataFrame:
    """Triples of each row's JSON text: ``key, table, row, parent_table, parent_row, path, ordinal, value``.

    Only ``key`` and ``payload`` of ``df`` are read, so other columns may have any name. ``tables`` and ``paths`` keep
    only those, inside the scan; ``bare`` is that of :func:`triples`. Null, empty and damaged texts give no rows; a row that is repeated gives its triples
    each time. No shuffle: a record is read by the task that scans it.
    """
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", key_type), T.StructField("table", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("parent_table", T.StringType()), T.StructField("parent_row", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("ordinal", T.IntegerType()), T.StructField("value", T.StringType())])
    want_t, want_p = set(tables) if tables else None, set(paths) if paths else None
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for k, text in zip(pdf["key"], pdf["payload"]):
                for t in triples(text, bare=bare):
                    if (want_t is None or t[0] in want_t) and (want_p is None or t[4] in want_p):
                        rows.append((k, *t))
                        if len(rows) >= 50_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
            yield pd.DataFrame(rows, columns=names)

    return df.select(F.col(key).alias("key"), F.col(payload).alias("payload")).filter("key is not null and payload is not null").mapInPandas(run, schema)


def pivot(shredded: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """One flat table: ``key, row, parent_row`` and the value under each path of ``columns`` (dots become underscores).

    A path that is absent gives null; of a path that holds several values the first.
    """
    t = shredded.filter(F.col("table") == table)
    cells = [F.min_by("value", F.when(F.col("path") == c, F.col("ordinal"))).alias(c.replace(".", "_")) for c in columns]
    parent = F.max(F.when(F.col("path") == PARENT, F.col("value").cast("int"))).alias("parent_row")
    return t.filter(F.col("path").isin(PARENT, *columns)).groupBy("key", "row").agg(parent, *cells)
