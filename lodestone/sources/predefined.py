"""Predefined-data files: a value table with nested rows, and tables inside its cells.

A table is a schema (columns with an id, a name and a type) and rows whose values stand at
positions that a permutation maps to columns. Columns are told by type: the first
reference is the item's uuid, the texts are name, code and display (name and display where
there are two), the column without a type holds a nested table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lodestone.errors import DataError
from lodestone.operators.code import expand
from lodestone.sources import brace
from lodestone.sources.metadata import nodes


@dataclass(frozen=True)
class Column:
    id: str
    name: str | None
    kind: str | None  # '#', 'S', 'B', 'N' ...; None: a nested table
    at: int


@dataclass
class Row:
    values: list
    children: list["Row"] = field(default_factory=list)

    def get(self, column: Column | None):
        return self.values[column.at] if column is not None and column.at < len(self.values) else None


@dataclass
class ValueTable:
    columns: list[Column]  # in the order of positions
    rows: list[Row]

    def of(self, kind: str | None) -> list[Column]:
        return [c for c in self.columns if c.kind == kind]


def _count(x) -> int:
    if not isinstance(x, str) or not x.lstrip("-").isdigit():
        raise DataError(f"a number was expected, not {str(x)[:20]}")
    return int(x)


def _row(node) -> Row | None:
    """['2', id, n, <n values>, <blocks of children ['1', n, rows...]>]."""
    if not isinstance(node, list) or len(node) < 4 or node[0] != "2":
        return None
    n = _count(node[2])
    out = Row(node[3 : 3 + n])
    for block in node[3 + n :]:
        if isinstance(block, list) and len(block) > 1 and block[0] == "1":
            out.children += filter(None, map(_row, block[2 : 2 + _count(block[1])]))
    return out


def value_table(schema, table) -> ValueTable:
    """A table from ['n', descriptors...] and ['2', columns, pairs..., ['1', rows, ...], ...]."""
    if not isinstance(schema, list) or not isinstance(table, list) or len(table) < 3:
        raise DataError("no value table")
    n = _count(table[1])
    position = {str(table[3 + 2 * i]): _count(table[2 + 2 * i]) for i in range(n)}
    columns = []
    for d in schema[1:]:
        if isinstance(d, list) and len(d) > 2 and str(d[0]) in position:
            pattern = d[2] if isinstance(d[2], list) else []
            kind = brace.unquote(pattern[1][0]) if len(pattern) > 1 and isinstance(pattern[1], list) and pattern[1] else None
            columns.append(Column(str(d[0]), brace.unquote(d[1]), kind, position[str(d[0])]))
    block = table[2 + 2 * n] if len(table) > 2 + 2 * n else []
    rows = [r for r in map(_row, block[2 : 2 + _count(block[1])] if len(block) > 1 else []) if r]
    return ValueTable(sorted(columns, key=lambda c: c.at), rows)


def _text(cell) -> str:
    return brace.unquote(cell[1]) if isinstance(cell, list) and len(cell) > 1 and isinstance(cell[1], str) else ""


def _uuid(cell) -> str | None:
    if isinstance(cell, list) and len(cell) > 2 and brace.unquote(cell[0]) == "#" and isinstance(cell[2], list) and len(cell[2]) > 1:
        return brace.unquote(cell[2][1])
    return None


def property_names(header) -> dict[str, str]:
    """uuid -> name of the properties that a header declares."""
    out: dict[str, str] = {}
    for n, _ in nodes(header):
        if len(n) > 2 and str(n[0]) == "3" and isinstance(n[1], list) and len(n[1]) > 2 and isinstance(n[2], str) and isinstance(n[1][2], str) and brace.UUID.fullmatch(n[1][2]):
            out.setdefault(n[1][2], brace.unquote(n[2]))
    return out


@dataclass(frozen=True)
class Item:
    ord: int
    parent: int | None  # None: the root, which is no item itself
    uuid: str | None
    name: str
    code: str
    display: str
    kinds: tuple[tuple[str | None, str | None], ...] = ()  # (uuid, flags) of a nested table's rows


def _walk(rows: list[Row], parent: int | None, number) -> Iterator[tuple[int, int | None, Row]]:
    for r in rows:
        own = next(number)
        yield own, parent, r
        yield from _walk(r.children, own, number)


def items(text: str, header=None) -> list[Item]:
    """All rows of a predefined-data file, numbered depth first."""
    from itertools import count

    top = brace.parse(text)
    wrapper = top[0][1] if top and isinstance(top[0], list) and len(top[0]) > 1 else None
    if not isinstance(wrapper, list) or len(wrapper) < 3:
        raise DataError("no predefined data")
    t = value_table(wrapper[1], wrapper[2])
    texts = t.of("S")
    if not texts:
        return []
    name, code, display = texts[:3] if len(texts) > 2 else (texts[0], None, texts[1] if len(texts) > 1 else None)
    ident = next(iter(t.of("#")), None)
    nested = next(iter(t.of(None)), None)
    flags = property_names(header) if header is not None else {}

    def kinds(cell):
        if not (isinstance(cell, list) and len(cell) > 2 and isinstance(cell[2], list) and len(cell[2]) > 2):
            return ()
        inner = value_table(cell[2][1], cell[2][2])
        own, marks = next(iter(inner.of("#")), None), [c for c in inner.of("B") if c.name in flags]
        return tuple((_uuid(r.get(own)), ";".join(flags[c.name] for c in marks if _text(r.get(c)) == "1") or None) for r in inner.rows)

    return [Item(n, parent, _uuid(r.get(ident)), _text(r.get(name)), _text(r.get(code)), _text(r.get(display)), kinds(r.get(nested)) if nested else ())
            for n, parent, r in _walk(t.rows, None, count())]


def unreadable(files: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and error of the files that are no predefined data."""
    def rows(t):
        try:
            items(t)
            return []
        except (DataError, IndexError, TypeError) as e:
            return [(str(e) or type(e).__name__,)]

    return expand(files, keys, text, "error string", rows)


def read_items(files: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The items of each file's text: keys, ord, parent_ord, uuid, name, code, display; files that
    are no predefined data give nothing here, but a row of `unreadable`."""
    def rows(t):
        try:
            return [(i.ord, i.parent, i.uuid, i.name, i.code, i.display) for i in items(t)]
        except (DataError, IndexError, TypeError):
            return []

    return expand(files, keys, text, "ord int, parent_ord int, uuid string, name string, code string, display string", rows)
