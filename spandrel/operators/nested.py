"""Deeply nested records of differing shape to related flat tables.

``merged_schema`` infers one schema over all records; ``shred`` explodes every array level of it
into a child table.  Both read JSON held as text.

* Each object key that holds an array anywhere is an array level everywhere: a single value in its
  place counts as an array of one, null as an array of none, and text that is itself a JSON array or
  object counts as what it says.
* A level's table is named after its key, at whatever depth the key stands, so that producers which
  wrap their payload differently feed the same tables.
* A row carries its record's id, the key of its parent row, its own key, its ordinal in its own array
  (from 0) and its position among all rows of its table in the record (from 0), in document order.
* Null elements keep their ordinal and position but give no row.

Row keys are paths such as ``segments/3/phoneme_ts/17``: unique in their record, the same in every
run, made without any coordination between tasks.

Defined results: halves of surrogate pairs become question marks.  Null, empty and incomplete payloads, payloads with
trailing text and such of more than DEEPEST levels give no rows;
invisible characters and a byte order mark in front are skipped.  Repeated record ids give repeated
rows.  Keys beyond the schema are ignored by ``shred`` and found by ``merged_schema``.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions.arrow import batch, map_arrow, parts

#: Characters that may stand in front of a payload: white space and what shows nothing.
IN_FRONT = "﻿​‌‍⁠­ ᠎‎‏ \t\r\n\x00"
#: First characters of a text that may be JSON.
JSON_HEADS = frozenset('[{"') | frozenset(IN_FRONT) - {" "}
#: The table that a record's outermost values belong to.
ROOT = ""
#: Levels of nesting that are read; payloads with more count as incomplete.
DEEPEST = 10_000
#: Rows of a batch that a task returns.
ROWS_AT_ONCE = 65_536


_BLANK = re.compile(r"[ \t\n\r]*").match
_SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity").match


def deep(text: str):
    """What json.loads gives, for text nested deeper than that can go: a stack in place of recursion."""

    def fail(at: int):
        raise ValueError(f"no JSON at {at}")

    stack: list[tuple[list | dict, str | None]] = []  # open containers, and the key that the next value of an object gets
    at, value, size = _BLANK(text).end(), None, len(text)
    while True:
        c = text[at : at + 1]
        opened = False
        if c in ("[", "{") and c:
            if len(stack) >= DEEPEST:
                fail(at)
            stack.append(([] if c == "[" else {}, None))
            at = _BLANK(text, at + 1).end()
            if text[at : at + 1] == ("]" if c == "[" else "}"):
                value, at = stack.pop()[0], at + 1
            else:
                opened = True
        elif c == '"':
            value, at = json.decoder.scanstring(text, at + 1, True)
        elif m := _SCALAR(text, at):
            value, at = json.loads(m[0]), m.end()
        else:
            fail(at)
        while True:  # the value goes into what is open
            if not opened:
                at = _BLANK(text, at).end()
                if not stack:
                    return value if at == size else fail(at)
                inside, key = stack[-1]
                if isinstance(inside, list):
                    inside.append(value)
                else:
                    inside[key] = value
                c = text[at : at + 1]
                at = _BLANK(text, at + 1).end()
                if c == ("]" if isinstance(inside, list) else "}"):
                    value, at = stack.pop()[0], at
                    continue
                if c != ",":
                    fail(at)
            inside = stack[-1][0]
            if isinstance(inside, dict):
                if text[at : at + 1] != '"':
                    fail(at)
                key, at = json.decoder.scanstring(text, at + 1, True)
                at = _BLANK(text, at).end()
                if text[at : at + 1] != ":":
                    fail(at)
                at = _BLANK(text, at + 1).end()
                stack[-1] = inside, key
            break


def loaded(text: str):
    try:
        return json.loads(text)
    except RecursionError:
        return deep(text)


def parsed(payload: str | None):
    """The payload's value, or None if it is no complete JSON array or object."""
    if not payload:
        return None
    try:
        value = loaded(payload.lstrip(IN_FRONT))
    except ValueError:
        return None
    value = embedded(value) if isinstance(value, str) else value
    return value if isinstance(value, (dict, list)) else None


def embedded(text: str):
    """What a text says, if it is a JSON array, object or string; else the text."""
    head = text.lstrip(IN_FRONT)[:1]
    if head in ("[", "{") or (head == '"' and len(text) > 1):
        try:
            value = loaded(text.lstrip(IN_FRONT))
        except ValueError:
            return text
        return embedded(value) if isinstance(value, str) else value
    return text


def _whole(value):
    """The value with a question mark for each half of a character, as JSON can name such and UTF-8 can't."""
    if isinstance(value, str):
        return value.encode("utf-8", "replace").decode("utf-8")
    return type(value)(map(_whole, value)) if isinstance(value, (list, tuple)) else value


def _encoded(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    try:
        return batch(columns, schema)
    except UnicodeEncodeError:
        return batch([c if isinstance(c, pa.Array) else _whole(c) for c in columns], schema)


class _Node:
    """What was found under one path; last is the last record it was found in, so that no set of records is kept."""

    __slots__ = ("kinds", "under", "records", "last")

    def __init__(self):
        self.kinds, self.under, self.records, self.last = set(), {}, 0, -1

    def child(self, key: str) -> _Node:
        node = self.under.get(key)
        if node is None:
            node = self.under[key] = _Node()
        return node


def _note(value, node: _Node, record: int) -> None:
    """Merges the shape of value into the tree."""
    if node.last != record:
        node.last = record
        node.records += 1
    if isinstance(value, str):
        value = embedded(value)
    if isinstance(value, dict):
        node.kinds.add(dict)
        child = node.child
        for k, v in value.items():
            kind = type(v)
            n = child(k)
            if kind is dict or kind is list or kind is str and v[:1] in JSON_HEADS:
                _note(v, n, record)
            else:
                n.kinds.add(kind)
                if n.last != record:
                    n.last = record
                    n.records += 1
    elif isinstance(value, list):
        node.kinds.add(list)
        if value:
            inner = node.child("[]")
            for v in value:
                kind = type(v)
                if kind is dict or kind is list or kind is str and v[:1] in JSON_HEADS:
                    _note(v, inner, record)
                else:
                    inner.kinds.add(kind)
            if inner.last != record:
                inner.last = record
                inner.records += 1
    else:
        node.kinds.add(type(value))


#: The names of the kinds in a merged schema; null adds none.
KINDS = {dict: "object", list: "array", bool: "boolean", int: "bigint", float: "double", str: "string"}


def merged_schema(df: DataFrame, payload: str) -> DataFrame:
    """path STRING, steps ARRAY<STRING>, kinds ARRAY<STRING>, records BIGINT: the merged schema of all payloads, one row for each path.

    steps are the path's keys, path the same for reading.  An array's elements stand under its path followed by ``[]``.  A path of several kinds is a
    conflict that ``shred`` resolves (array over object over scalar).  Tasks merge their own records
    first; what is shuffled has one row for each path and task.
    """

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(5 * DEEPEST)
        root, record = _Node(), 0
        for b in parts(batches):
            for text in b.column(0).to_pylist():
                value = parsed(text)
                if value is not None:
                    _note(value, root, record)
                    record += 1
        rows, stack = [], [(["$"], root)] if record else []
        while stack:
            steps, node = stack.pop()
            rows.append((steps, sorted(KINDS[k] for k in node.kinds if k in KINDS), node.records))
            stack.extend(([*steps, k], n) for k, n in node.under.items())
        yield _encoded([list(c) for c in zip(*rows)] or [[], [], []], schema)

    found = map_arrow(df.select(payload), run, "steps ARRAY<STRING>, kinds ARRAY<STRING>, records BIGINT")
    merged = found.groupBy("steps").agg(F.flatten(F.collect_set("kinds")).alias("kinds"), F.sum("records").alias("records"))
    return merged.select(F.array_join("steps", ".").alias("path"), "steps", F.array_sort(F.array_distinct("kinds")).alias("kinds"), "records")


class _Walk:
    """The rows of one record's levels, in document order."""

    def __init__(self, levels: dict[str, bool], wanted: frozenset[str], columns: dict[str, frozenset[str]] | None, item_fields: dict[str, str], out: list[list], row_keys: bool):
        self.levels, self.wanted, self.columns, self.item_fields, self.out, self.row_keys = levels, wanted, columns, item_fields, out, row_keys

    def record(self, rid, value) -> None:
        self.rid, self.seen = rid, {}
        for i, v in enumerate(value if isinstance(value, list) else [value]):
            self.inside(v, ROOT, str(i), -1, None, "")

    def inside(self, value, table: str, key: str, pos: int, scalars: dict | None, prefix: str) -> None:
        """Collects scalars of an object under dotted names and goes on into its levels, in the order they stand."""
        if isinstance(value, str) and table == ROOT:
            value = embedded(value)
        if isinstance(value, list):
            for i, v in enumerate(value):
                self.inside(v, table, f"{key}.{i}", pos, scalars, f"{prefix}{i}.")
            return
        if not isinstance(value, dict):
            return
        for k, v in value.items():
            if k in self.levels:
                self.level(v, k, key, pos, table)
            elif isinstance(v, (dict, list)):
                self.inside(v, table, f"{key}/{k}", pos, scalars, f"{prefix}{k}.")
            elif isinstance(v, str) and v[:1] in JSON_HEADS and isinstance(e := embedded(v), (dict, list)):
                self.inside(e, table, f"{key}/{k}", pos, scalars, f"{prefix}{k}.")
            elif scalars is not None and v is not None:
                name = prefix + k
                if self.columns is None or name in self.columns.get(table, ()):
                    scalars[name] = as_text(v)

    def level(self, value, table: str, parent: str, parent_pos: int, parent_table: str) -> None:
        if isinstance(value, str):
            value = None if value.strip() == "null" else embedded(value)
        if value is None:
            return
        values = value if isinstance(value, list) else [value]
        base, wanted, leaf = self.seen.get(table, 0), table in self.wanted, self.levels[table]
        self.seen[table] = base + len(values)
        if leaf and not wanted:
            return
        ids, tbl, parent_tbls, parents, keys, parent_poss, ords, poss, fields, items = self.out
        field = self.item_fields.get(table)
        for i, v in enumerate(values):
            if v is None:
                continue
            if isinstance(v, str) and v[:1] in JSON_HEADS and isinstance(e := embedded(v), dict):
                v = e
            inner = isinstance(v, (dict, list))
            key = f"{parent}/{table}/{i}" if self.row_keys or not leaf else ""
            scalars: dict | None = None
            if wanted:
                ids.append(self.rid)
                tbl.append(table)
                parent_tbls.append(parent_table)
                parents.append(parent if self.row_keys else None)
                keys.append(key if self.row_keys else None)
                parent_poss.append(parent_pos)
                ords.append(i)
                poss.append(base + i)
                if inner and field is not None:
                    items.append(as_text(v.get(field)) if isinstance(v, dict) else None)
                elif inner:
                    scalars = {}
                    items.append(None)
                else:
                    items.append(as_text(v))
                fields.append(scalars)
            if inner and (scalars is not None or not leaf):
                self.inside(v, table, key, base + i, scalars, "")


def as_text(v) -> str | None:
    """A scalar as it stands in JSON, a string without its quotes."""
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def shred(
    df: DataFrame,
    record_id: str,
    payload: str,
    levels: dict[str, bool],
    tables: Iterable[str] | None = None,
    columns: dict[str, Iterable[str]] | None = None,
    item_fields: dict[str, str] | None = None,
    row_keys: bool = True,
) -> DataFrame:
    """All rows of all tables, in long form:

    record_id, tbl, parent_tbl, parent_key, row_key, parent_pos, ord, pos, fields MAP<STRING,STRING>, item STRING.

    levels: from ``array_levels``.  tables, columns: those that are wanted, all if None; what isn't
    wanted is walked but not returned.  item is the value of an element that is no object; fields has
    an object's scalars under dotted names.  item_fields: for a table, the one scalar of its objects
    that is wanted as item, in place of fields.
    """
    levels = dict(levels)
    wanted = frozenset(levels if tables is None else tables)
    pruned = None if columns is None else {t: frozenset(c) for t, c in columns.items()}
    id_type = df.schema[record_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(5 * DEEPEST)
        out: list[list] = [[] for _ in range(10)]
        walk = _Walk(levels, wanted, pruned, item_fields or {}, out, row_keys)

        def flush() -> pa.RecordBatch:
            fields = out[8]
            maps = [None if f is None else list(f.items()) for f in fields] if any(f is not None for f in fields) else pa.nulls(len(fields), schema.field(8).type)
            done = _encoded([*out[:8], maps, out[9]], schema)
            for c in out:
                c.clear()
            return done

        for b in parts(batches):
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                value = parsed(text)
                if value is not None:
                    walk.record(rid, value)
                    if len(out[0]) >= ROWS_AT_ONCE:
                        yield flush()
        if out[0]:
            yield flush()

    ddl = f"record_id {id_type}, tbl STRING, parent_tbl STRING, parent_key STRING, row_key STRING, parent_pos INT, ord INT, pos INT, fields MAP<STRING,STRING>, item STRING"
    return map_arrow(df.select(record_id, payload), run, ddl)


def array_levels(schema: DataFrame) -> dict[str, bool]:
    """The keys of the array levels in a merged schema, and whether no other level is below them.

    The driver gets the paths of arrays, not records; producers' array paths are few, and a schema of
    more than 10,000 of them is refused rather than cut.
    """
    paths = [r.steps for r in schema.where(F.array_contains("kinds", "array")).select("steps").limit(10_001).collect()]
    if len(paths) > 10_000:
        raise ValueError("more than 10,000 array paths: the payload's keys are data, not a schema")
    steps = [[k for k in p[1:] if k != "[]"] for p in paths]
    names = {s[-1] for s in steps if s}
    above = {k for s in steps for k in s[:-1]}
    return {n: n not in above for n in sorted(names)}


def flat_table(long: DataFrame, name: str, fields: dict[str, str]) -> DataFrame:
    """One table of ``shred``'s rows; fields: column -> type, read from the field of that dotted name (``item`` from the element itself)."""

    def column(field: str, kind: str) -> Column:
        value = F.col("item") if field == "item" else F.col("fields")[field]
        return value.try_cast(kind).alias(field.replace(".", "_"))

    return long.where(F.col("tbl") == name).select("record_id", "parent_tbl", "parent_key", "row_key", "parent_pos", "ord", "pos", *(column(f, k) for f, k in fields.items()))
