"""From query trees to Spark SQL, so that checked queries also run.

Tables and references are named by the caller; a dotted chain becomes one left join per
hop. ``IN HIERARCHY`` reads a closure view (ancestor, node). Totals become grouping sets
behind the detail rows, with the level in ``totals_level`` (0 for details).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lodestone.errors import BadRequest
from lodestone.ql import parser as P
from lodestone.ql.words import FUNCTIONS, SQL_UNITS


@dataclass
class Mapping:
    """tables: query name -> view; refs: (view, field) -> (view, key); closures: view -> closure view."""

    tables: dict[str, str]
    refs: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)
    closures: dict[str, str] = field(default_factory=dict)


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Writer:
    def __init__(self, mapping: Mapping, params: dict):
        self.mapping, self.params = mapping, params
        self.views: dict[str, str | None] = {}
        self.hops: dict[tuple, str] = {}

    # queries

    def select(self, q: P.Select, outer: bool = True) -> str:
        inner = Writer(self.mapping, self.params)
        body = inner._one(q)
        if q.union is not None:
            body = f"({body}) UNION {'ALL ' if q.union_all else ''}({self.select(q.union, False)})"
        return body

    def _one(self, q: P.Select) -> str:
        source = self.source(q.source) if q.source is not None else None
        items = [self.item(i) for i in q.items]
        where = self.e(q.where) if q.where is not None else None
        if q.grouping_sets is not None:
            group = "GROUPING SETS (" + ", ".join("(" + ", ".join(map(self.e, s)) + ")" for s in q.grouping_sets) + ")"
        else:
            group = ", ".join(map(self.e, q.group)) if q.group else None
        having = self.e(q.having) if q.having is not None else None
        order = ", ".join(self.order(o) for o in q.order)
        joins = "".join(f" LEFT JOIN {_quote(view)} {_quote(alias)} ON {on} = {_quote(alias)}.{_quote(key)}" for (on, view, key), alias in self.hops.items())
        sql = f"SELECT {'DISTINCT ' if q.distinct else ''}{', '.join(items)}"
        sql += f" FROM {source}{joins}" if source else ""
        sql += f" WHERE {where}" if where else ""
        sql += f" GROUP BY {group}" if group else ""
        sql += f" HAVING {having}" if having else ""
        if q.totals:
            sql = self.totals(q, sql)
        sql += f" ORDER BY {order}" if order else ""
        return sql + (f" LIMIT {q.top}" if q.top is not None else "")

    def totals(self, q: P.Select, sql: str) -> str:
        names = [i.alias or (i.value.parts[-1] if isinstance(i.value, P.Field) else None) for i in q.items]
        if None in names:
            raise BadRequest("totals need named columns")
        low = {n.lower(): n for n in names}
        aggregates, points = q.totals[0]
        value = {}
        for a in aggregates:
            if not isinstance(a.value, P.Call) or not isinstance(a.value.args[0], P.Field):
                raise BadRequest("totals are aggregates of columns")
            column = low[a.value.args[0].parts[-1].lower()]
            value[column] = f"{FUNCTIONS[a.value.name.upper()]}({_quote(column)})"
        parts, reached = [f"SELECT *, 0 AS totals_level FROM ({sql})"], []
        for n, point in enumerate(points, 1):
            if point.value is not None:
                if not isinstance(point.value, P.Field):
                    raise BadRequest("total points are columns")
                reached.append(low[point.value.parts[-1].lower()])
            by = list(reached)
            columns = [_quote(c) if c in by else f"{value.get(c, 'NULL')} AS {_quote(c)}" for c in names]
            group = f" GROUP BY {', '.join(map(_quote, by))}" if by else ""
            parts.append(f"SELECT {', '.join(columns)}, {n} AS totals_level FROM ({sql}){group}")
        return "SELECT * FROM (" + " UNION ALL ".join(parts) + ")"

    def item(self, i: P.Item) -> str:
        if isinstance(i.value, P.Star):
            return ".".join([*map(_quote, i.value.of), "*"])
        alias = i.alias or (i.value.parts[-1] if isinstance(i.value, P.Field) else None)
        return self.e(i.value) + (f" AS {_quote(alias)}" if alias else "")

    def order(self, o: P.Order) -> str:
        return self.e(o.value) + (" DESC NULLS LAST" if o.descending else " ASC NULLS FIRST")

    # sources

    def source(self, s) -> str:
        if isinstance(s, P.Join):
            left, right = self.source(s.left), self.source(s.right)
            if isinstance(s.right, P.Join):
                right = f"({right})"
            if s.kind == "cross":
                return f"{left} CROSS JOIN {right}"
            return f"{left} {s.kind.upper()} JOIN {right} ON {self.e(s.on)}"
        if isinstance(s, P.Derived):
            self.views[(s.alias or "").lower()] = None
            return f"({self.select(s.query)}) {_quote(s.alias)}" if s.alias else f"({self.select(s.query)})"
        name = "&" + s.name if isinstance(s, P.ParamTable) else ".".join(s.parts)
        view = self.mapping.tables.get(name) or (s.parts[0] if isinstance(s, P.Table) and len(s.parts) == 1 else None)
        if view is None:
            raise BadRequest(f"no table is mapped to {name}")
        alias = s.alias or (s.name if isinstance(s, P.ParamTable) else s.parts[-1])
        self.views[alias.lower()] = view
        return f"{_quote(view)} {_quote(alias)}"

    # expressions

    def field(self, parts: list[str]) -> str:
        if parts[0].lower() not in self.views:
            if len(parts) == 1:
                return _quote(parts[0])
            if len(self.views) != 1:
                raise BadRequest(f"unknown source of {'.'.join(parts)}")
            parts = [next(iter(self.views)), *parts]
        at, view, rest = _quote(parts[0]), self.views[parts[0].lower()], parts[1:]
        while len(rest) > 1:
            target = self.mapping.refs.get((view, rest[0]))
            if target is None:
                raise BadRequest(f"{'.'.join(parts)}: {rest[0]} is no reference")
            hop = (f"{at}.{_quote(rest[0])}", *target)
            at = _quote(self.hops.setdefault(hop, f"hop_{len(self.hops) + 1}"))
            view, rest = target[0], rest[1:]
        return f"{at}.{_quote(rest[0])}" if rest else at

    def e(self, n) -> str:
        match n:
            case P.Literal(kind="number"):
                return n.value
            case P.Literal(kind="string" | "unit"):
                return _text(n.value)
            case P.Literal(kind="boolean"):
                return "TRUE" if n.value else "FALSE"
            case P.Literal():
                return "NULL"
            case P.Param():
                if n.name not in self.params:
                    raise BadRequest(f"no value for &{n.name}")
                return f":{self.name_of(n.name)}"
            case P.Field():
                return self.field(n.parts)
            case P.Star():
                return "*"
            case P.Call():
                return self.call(n)
            case P.Cast():
                kind = {"число": "DECIMAL", "строка": "STRING", "булево": "BOOLEAN", "дата": "TIMESTAMP"}.get(n.type[0].lower())
                if kind is None:
                    return self.e(n.value)
                size = f"({', '.join(map(self.e, n.args))})" if n.args and kind == "DECIMAL" else "(38, 10)" if kind == "DECIMAL" else ""
                return f"CAST({self.e(n.value)} AS {kind}{size})"
            case P.Unary():
                return f"({n.op} {self.e(n.value)})"
            case P.Binary(op="/"):
                return f"try_divide({self.e(n.left)}, {self.e(n.right)})"
            case P.Binary():
                return f"({self.e(n.left)} {n.op} {self.e(n.right)})"
            case P.Between():
                return f"({self.e(n.value)} {'NOT ' * n.negated}BETWEEN {self.e(n.low)} AND {self.e(n.high)})"
            case P.In():
                inside = self.select(n.query) if n.query is not None else ", ".join(map(self.e, n.choices))
                if n.hierarchy:
                    closure = next(iter(self.mapping.closures.values()), None)
                    if closure is None:
                        raise BadRequest("no hierarchy is mapped")
                    inside = f"SELECT node FROM {_quote(closure)} WHERE ancestor IN ({inside})"
                return f"({self.e(n.value)} {'NOT ' * n.negated}IN ({inside}))"
            case P.Like():
                return f"({self.e(n.value)} {'NOT ' * n.negated}LIKE {self.e(n.pattern)}{f' ESCAPE {self.e(n.escape)}' if n.escape is not None else ''})"
            case P.IsNull():
                return f"({self.e(n.value)} IS {'NOT ' * n.negated}NULL)"
            case P.Case():
                branches = "".join(f" WHEN {self.e(a)} THEN {self.e(b)}" for a, b in n.branches)
                return f"CASE{' ' + self.e(n.operand) if n.operand is not None else ''}{branches}{f' ELSE {self.e(n.default)}' if n.default is not None else ''} END"
            case P.Row():
                return f"({', '.join(map(self.e, n.values))})"
            case P.Scalar():
                return f"({self.select(n.query)})"
        raise BadRequest(f"cannot run {type(n).__name__}")

    def name_of(self, param: str) -> str:
        return "p_" + "".join(c if c.isascii() and c.isalnum() else f"_{ord(c):x}" for c in param)

    def call(self, n: P.Call) -> str:
        name = n.name.upper()
        if name in ("НАЧАЛОПЕРИОДА", "КОНЕЦПЕРИОДА") and len(n.args) == 2:
            value, unit = self.e(n.args[0]), n.args[1].value
            match unit:
                case "ДЕКАДА":
                    start = f"date_add(date_trunc('MONTH', {value}), CAST(10 * least(2, (day({value}) - 1) DIV 10) AS INT))"
                    length = None
                case "ПОЛУГОДИЕ":
                    start = f"add_months(date_trunc('YEAR', {value}), 6 * ((month({value}) - 1) DIV 6))"
                    length = "INTERVAL 6 MONTH"
                case _:
                    start, length = f"date_trunc('{SQL_UNITS[unit]}', {value})", "INTERVAL 3 MONTH" if unit == "КВАРТАЛ" else f"INTERVAL 1 {SQL_UNITS[unit].upper()}"
            if name == "НАЧАЛОПЕРИОДА":
                return f"CAST({start} AS TIMESTAMP_NTZ)"
            if length is None:
                raise BadRequest("the end of a ten-day period is not supported")
            return f"CAST({start} AS TIMESTAMP_NTZ) + {length} - INTERVAL 1 SECOND"
        sql = FUNCTIONS.get(name)
        if sql is None:
            raise BadRequest(f"no function {n.name}")
        return f"{sql}({'DISTINCT ' * n.distinct}{', '.join(map(self.e, n.args))})"


def run(spark: SparkSession, text: str, mapping: Mapping, params: dict | None = None) -> DataFrame:
    """Runs a script; ПОМЕСТИТЬ makes temporary views. Returns the last query's result."""
    params, out = params or {}, None
    for s in P.parse(text):
        if isinstance(s, P.Drop):
            spark.sql(f"DROP VIEW IF EXISTS {_quote(s.name)}")
            continue
        w = Writer(mapping, params)
        out = spark.sql(w.select(s), args={w.name_of(k): v for k, v in params.items()})
        if s.into:
            out.createOrReplaceTempView(_quote(s.into))
    return out
