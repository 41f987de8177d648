"""Semantic check of queries against a base's metadata."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from lodestone.ql import parser as P
from lodestone.ql.words import PREFIXES, STANDARD, VIRTUAL


@dataclass
class Context:
    """What a base knows: tables by query name, fields, references.

    The catalog's dimension tables have tens of thousands of rows, so the context is
    small enough to be sent to tasks; it comes from `from_rows` or `from_catalog`."""

    tables: dict[str, str] = field(default_factory=dict)  # "Справочник.Имя" -> path
    fields: dict[str, set] = field(default_factory=lambda: defaultdict(set))
    sections: dict[str, dict] = field(default_factory=lambda: defaultdict(dict))
    common: dict[str, set | None] = field(default_factory=dict)  # None: applies to all
    refs: dict[tuple, list] = field(default_factory=lambda: defaultdict(list))
    closed: set = field(default_factory=set)  # paths whose fields are known

    @classmethod
    def from_rows(cls, objects, attributes, names=(), common=(), refs=()) -> "Context":
        """objects (path, type, name), attributes (path, name, section), names (path, name) of
        enum values and predefined items, common (name, target path or None), refs (path, name, target)."""
        c = cls()
        by_type = defaultdict(list)
        for ru, kind in PREFIXES.items():
            by_type[kind].append(ru)
        for path, kind, name in objects:
            if path.count("/") == 1:
                for ru in by_type[kind]:
                    c.tables[f"{ru}.{name}".lower()] = path
        for path, name, section in attributes:
            c.closed.add(path)
            c.fields[path].add(name.lower())
            if section:
                c.sections[path].setdefault(section.lower(), set()).add(name.lower())
                c.fields[path].add(section.lower())
        for path, name in names:
            c.fields[path].add(name.lower())
        for name, target in common:
            known = c.common.setdefault(name.lower(), set())
            if target is None or known is None:
                c.common[name.lower()] = None
            else:
                known.add(target)
        for path, name, target in refs:
            c.refs[path, name.lower()].append(target)
        return c

    @classmethod
    def from_catalog(cls, catalog, db=None) -> "Context":
        """From the tables of one base."""
        t = lambda name: catalog.table(name, db)
        objects = t("meta_object").select("id", "path", "type", "name")
        path = objects.select(objects["id"].alias("object_id"), "path")
        rows = lambda df: [tuple(r) for r in df.collect()]
        names = t("enum_value").join(path, "object_id").select("path", "name").union(t("predefined").join(path, "object_id").select("path", "name"))
        scope = objects.where("type = 'CommonAttribute'").join(t("common_target").select("common_id", "target_id"), objects["id"] == F_col("common_id"), "left")
        scope = scope.join(path.withColumnRenamed("object_id", "target_id").withColumnRenamed("path", "target"), "target_id", "left").select("name", "target")
        attrs = t("meta_attribute").select("id", "object_id", "name", "tabular")
        refs = t("attribute_ref").select("attribute_id", F_col("object_id").alias("target_id")).join(attrs, F_col("attribute_id") == attrs["id"]).join(path, "object_id").join(
            path.select(F_col("object_id").alias("target_id"), F_col("path").alias("target")), "target_id").select("path", "name", "target")
        return cls.from_rows(rows(objects.select("path", "type", "name")), rows(attrs.join(path, "object_id").select("path", "name", "tabular")), rows(names), rows(scope), rows(refs))

    def path_of(self, parts: list[str]) -> str | None:
        return self.tables.get(".".join(parts[:2]).lower()) if len(parts) > 1 else None

    def has(self, path: str, name: str) -> bool:
        low = name.lower()
        if low in STANDARD or low in self.fields.get(path, ()):
            return True
        return low in self.common and (self.common[low] is None or path in self.common[low])


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


@dataclass
class Result:
    errors: list[str] = field(default_factory=list)
    unverified: list[str] = field(default_factory=list)

    def error(self, text: str) -> None:
        if text not in self.errors:
            self.errors.append(text)


OPEN = object()  # a source whose fields cannot be checked


def _own_names(q: P.Select) -> set[str]:
    """The columns of a query as its readers see them."""
    out = set()
    for item in q.items:
        if item.alias:
            out.add(item.alias.lower())
        elif isinstance(item.value, P.Field):
            out.add(item.value.parts[-1].lower())
        elif isinstance(item.value, P.Star):
            return {"*"}
    return out


class _Scope:
    def __init__(self, context: Context, temp: dict[str, set], result: Result):
        self.context, self.temp, self.result = context, temp, result

    def source(self, node, into: dict) -> None:
        if isinstance(node, P.Join):
            self.source(node.left, into)
            self.source(node.right, into)
        elif isinstance(node, P.Derived):
            _Scope(self.context, self.temp, self.result).select(node.query)
            into[(node.alias or "").lower()] = ("query", _own_names(node.query))
        elif isinstance(node, P.ParamTable):
            self.result.unverified.append(f"таблица-параметр &{node.name}")
            into[(node.alias or node.name).lower()] = OPEN
        elif isinstance(node, P.Table):
            into[(node.alias or node.parts[-1]).lower()] = self.table(node)
            for a in node.args or ():
                if a is not None and not isinstance(a, list):
                    self.expression(a, {}, soft=True)

    def table(self, node: P.Table):
        if len(node.parts) == 1:
            known = self.temp.get(node.parts[0].lower())
            return ("query", known) if known else OPEN
        path = self.context.path_of(node.parts)
        if path is None:
            self.result.error(f"неизвестная таблица {'.'.join(node.parts)}")
            return OPEN
        if any(p in VIRTUAL for p in node.parts[2:]):
            return OPEN
        if len(node.parts) > 2:
            section = self.context.sections.get(path, {}).get(node.parts[2].lower())
            if section is None:
                if path in self.context.closed:
                    self.result.error(f"неизвестная таблица {'.'.join(node.parts)}")
                return OPEN
            return ("section", path, section)
        return ("object", path)

    def select(self, q: P.Select) -> None:
        scope: dict = {}
        self.source(q.source, scope)
        aliases = {i.alias.lower() for i in q.items if i.alias}
        for item in q.items:
            self.expression(item.value, scope)
        for node in [*walk_joins(q.source), q.where, q.having, *q.flat_group, *q.index]:
            if node is not None:
                self.expression(node, scope)
        for o in [*q.order, *(p for _, points in q.totals for p in points), *(a for aggregates, _ in q.totals for a in aggregates)]:
            if o.value is not None:
                self.expression(o.value, scope, aliases)
        if q.union is not None:
            self.select(q.union)

    def expression(self, node, scope, aliases=frozenset(), soft: bool = False) -> None:
        if isinstance(node, (list, tuple)):
            for x in node:
                self.expression(x, scope, aliases, soft)
        elif isinstance(node, P.Select):  # a query in IN or scalar position sees no temporary tables
            _Scope(self.context, {}, self.result).select(node)
        elif isinstance(node, P.Field):
            if not soft:
                self.chain(node, scope, aliases)
        elif isinstance(node, P.Call) and node.name.upper() in ("ЗНАЧЕНИЕ", "ТИП", "VALUE", "TYPE"):
            return
        elif isinstance(node, P.Node):
            for name, value in vars(node).items():
                if name not in ("pos", "type", "path", "of"):
                    self.expression(value, scope, aliases, soft)

    def chain(self, node: P.Field, scope, aliases) -> None:
        parts = node.parts
        first = parts[0].lower()
        if first in scope:
            source, rest = scope[first], parts[1:]
        elif len(parts) == 1 and first in aliases or not scope:
            return
        elif len(scope) == 1:
            source, rest = next(iter(scope.values())), parts
        else:
            return
        if not rest or source is OPEN:
            return
        if source[0] == "query":
            if source[1] and "*" not in source[1] and rest[0].lower() not in source[1]:
                self.result.error(f"неизвестное поле {'.'.join(parts)}")
            return
        path = source[1]
        if source[0] == "section":
            if rest[0].lower() not in source[2] and rest[0].lower() not in STANDARD:
                self.result.error(f"неизвестное поле {'.'.join(parts)}")
                return
        elif path in self.context.closed and not self.context.has(path, rest[0]):
            self.result.error(f"неизвестное поле {'.'.join(parts)}")
            return
        self.deeper(path, rest, parts)

    def deeper(self, path: str, rest: list[str], parts: list[str]) -> None:
        """Later hops: a section's field, or the object a reference leads to, if it is one only."""
        at = 0
        while at + 1 < len(rest):
            section = self.context.sections.get(path, {}).get(rest[at].lower())
            if section is not None:
                if rest[at + 1].lower() not in section and rest[at + 1].lower() not in STANDARD:
                    self.result.error(f"неизвестное поле {'.'.join(parts)}")
                    return
                at += 1
                continue
            targets = self.context.refs.get((path, rest[at].lower()), [])
            if len(set(targets)) != 1:
                return
            path = targets[0]
            if path in self.context.closed and not self.context.has(path, rest[at + 1]):
                self.result.unverified.append(f"поле {'.'.join(parts)}")
                return
            at += 1


def walk_joins(source):
    if isinstance(source, P.Join):
        yield from walk_joins(source.left)
        yield from walk_joins(source.right)
        yield source.on


def check(text: str, context: Context) -> Result:
    """Errors (empty if the query is sound) and what could not be verified."""
    result = Result()
    try:
        statements = P.parse(text)
    except P.SyntaxProblem as e:
        result.error(f"синтаксис: {e}")
        return result
    temp: dict[str, set] = {}
    for s in statements:
        if isinstance(s, P.Select):
            if s.into:
                temp[s.into.lower()] = _own_names(s)
    for s in statements:
        if isinstance(s, P.Select):
            _Scope(context, temp, result).select(s)
    return result
