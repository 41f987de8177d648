"""What object headers (nested lists) say: fields, sections, values, types, properties.

A header is walked once as a stream of nodes with their parents; each derivation picks
its records from that stream. `derive` runs all of them in tasks, next to the headers;
the names that types refer to travel as a dimension of bounded size.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.errors import DataError
from lodestone.sources.brace import UUID, unquote

#: Marks of records, the key of a section's fields, primitive types.
FIELD, CORE_MARK, SECTION_KEY = "2", "3", "888744e1-b616-11d4-9436-004095e12fc7"
PRIMITIVES = {"S": "Строка", "N": "Число", "D": "Дата", "B": "Булево", "T": "Тип"}
#: Types that references can lead to.
REFERENCE_TARGETS = frozenset("""Catalog Document Enum InformationRegister AccumulationRegister AccountingRegister CalculationRegister ChartOfAccounts
ChartOfCharacteristicType ChartOfCalculationTypes BusinessProcess Task ExchangePlan DataProcessor Report DocumentJournal FilterCriterion SettingsStorage""".split())
#: Flags of a common module by position, in the order of the list.
CONTEXT_FLAGS = [(1, "Сервер"), (2, "Внешнее соединение"), (0, "Клиент (обычное приложение)"), (5, "Клиент (управляемое приложение)"), (7, "Вызов сервера"), (4, "Глобальный"), (6, "Повторное использование")]
#: Positions of properties, and their codes.
PERIODICITY_AT, WRITE_MODE_AT, VERSION_AT, PREFIX_AT = 18, 19, 15, 42
RECORDER_ONLY = frozenset({"AccumulationRegister", "AccountingRegister", "CalculationRegister"})


def nodes(header, above: tuple = ()) -> Iterator[tuple[list, tuple]]:
    """(list, ((parent, index), ...)) of every list in a header, depth first."""
    if isinstance(header, dict):
        header = list(header.values())
    if isinstance(header, list):
        yield header, above
        for i, child in enumerate(header):
            if isinstance(child, (list, dict)):
                yield from nodes(child, (*above, (header, i)))


def _core(x) -> tuple[str, str | None] | None:
    """(name, uuid) of a named record [mark, [.., .., uuid], name, ...]."""
    if not (isinstance(x, list) and len(x) > 2 and isinstance(x[2], str)):
        return None
    inner = x[1]
    own = inner[2] if isinstance(inner, list) and len(inner) > 2 and isinstance(inner[2], str) and UUID.fullmatch(inner[2]) else None
    return unquote(x[2]), own


@dataclass(frozen=True)
class Attribute:
    name: str
    tabular: str | None
    uuid: str | None
    type: list | None = field(hash=False, default=None)


def _section_of(above: tuple) -> tuple[str, str | None, list] | None:
    """(name, uuid, bag) of the innermost section around a node."""
    for parent, i in reversed(above):
        bag = parent[i]
        if isinstance(bag, list) and bag and bag[0] == SECTION_KEY and i > 1 and str(parent[i - 1]) == "1" and isinstance(parent[i - 2], list):
            queue = [parent[i - 2]]
            for x in queue:  # breadth first: the name nearest to the top
                if isinstance(x, list):
                    if len(x) > 2 and str(x[0]) == CORE_MARK and isinstance(x[2], str) and x[2].startswith('"'):
                        return (*_core(x), bag)
                    queue += x
    return None


def attributes(header) -> list[Attribute]:
    """Fields in the order of declaration; a name counts once per section."""
    out: dict[tuple, Attribute] = {}
    for node, above in nodes(header):
        if len(node) < 3 or node[0] != FIELD or (core := _core(node[1])) is None:
            continue
        if node[1][0] != CORE_MARK and core[1] is None:
            continue
        kind = next((x for x in node[2:4] if isinstance(x, list)), None)
        section = _section_of(above)
        key = (section[0] if section else None, core[0])
        out.setdefault(key, Attribute(core[0], key[0], core[1], kind))
    return list(out.values())


def sections(header) -> list[tuple[str, str | None, int | None]]:
    """(name, uuid, declared number of fields) of the sections, each name once."""
    out: dict[str, tuple] = {}
    for node, above in nodes(header):
        if node and node[0] == SECTION_KEY and above and (s := _section_of(above)) and s[2] is node:
            count = node[1] if len(node) > 1 and isinstance(node[1], str) and node[1].isdigit() else None
            out.setdefault(s[0], (s[0], s[1], int(count) if count else 0 if count == "0" else None))
    return list(out.values())


def enum_values(header) -> list[str]:
    """Names of an enumeration's values, in order, each once."""
    found = (_core(n[0][1]) for n, _ in nodes(header) if len(n) == 2 and isinstance(n[0], list) and len(n[0]) > 1 and str(n[0][0]) == "0" and isinstance(n[0][1], list) and n[0][1] and str(n[0][1][0]) == CORE_MARK)
    return list(dict.fromkeys(f[0] for f in found if f and f[0]))


@dataclass
class Names:
    """What references can lead to: objects by uuid, by name; names by reference uuid; defined types."""

    by_uuid: dict[str, str] = field(default_factory=dict)
    by_name: dict[str, list[str]] = field(default_factory=lambda: defaultdict(list))
    references: dict[str, str] = field(default_factory=dict)
    defined: dict[str, tuple[str, list]] = field(default_factory=dict)  # uuid -> (path, members)

    @staticmethod
    def target(path: str) -> bool:
        kind, slash, rest = path.partition("/")
        return bool(slash) and "/" not in rest and kind in REFERENCE_TARGETS


@dataclass(frozen=True)
class Part:
    """One alternative of a type: its text and the objects it refers to (uuid, path or None)."""

    text: str
    links: tuple = ()


def _reference(uuid: str, names: Names, seen: frozenset = frozenset()) -> list[Part]:
    if (name := names.references.get(uuid)) is not None:
        paths = [p for p in names.by_name.get(name, ()) if Names.target(p)]
        return [Part(f"Ссылка: {p}", ((uuid, p),)) for p in paths] or [Part(f"Ссылка: {name} (объект не найден в базе)", ((uuid, None),))]
    if uuid in names.defined:
        path, members = names.defined[uuid]
        inner = [] if path in seen else [p for m in members for p in _member(m, names, seen | {path})]
        texts = list(dict.fromkeys(p.text for p in inner))
        links = tuple(dict.fromkeys([(uuid, path), *(x for p in inner for x in p.links)]))
        return [Part(f"ОпределяемыйТип: {path}" + (f" ({' | '.join(texts)})" if texts else ""), links)]
    return [Part("Ссылка", ((uuid, None),))]


def _member(entry, names: Names, seen: frozenset = frozenset()) -> list[Part]:
    if not isinstance(entry, list) or not entry:
        return []
    code = str(entry[0]).strip('"')
    if code in PRIMITIVES:
        return [Part(PRIMITIVES[code] + (f"({entry[1]})" if code == "S" and len(entry) > 1 else ""))]
    if code != "#" or len(entry) < 2:
        return []
    own = dict.fromkeys(v for n, _ in nodes(entry[2:]) for v in n if isinstance(v, str) and v in names.by_uuid and Names.target(names.by_uuid[v]))
    return [Part(f"Ссылка: {names.by_uuid[u]}", ((u, names.by_uuid[u]),)) for u in own] or _reference(entry[1], names, seen)


def type_parts(descriptor, names: Names) -> list[Part]:
    """The alternatives of a type descriptor, each text once, in order; none if it is unknown."""
    if not isinstance(descriptor, list) or not descriptor:
        return []
    head = str(descriptor[0]).strip('"')
    if head == "Pattern":
        entries = descriptor[1:2]
    elif head == "0" and len(descriptor) > 1 and str(descriptor[1]).isdigit():
        entries = descriptor[2:]
    else:
        return []
    out: dict[str, Part] = {}
    for p in (p for e in entries for p in _member(e, names)):
        out.setdefault(p.text, p)
    return list(out.values())


def type_text(descriptor, names: Names) -> tuple[str | None, list[tuple[str, str | None]]]:
    """(text, links) of a type: alternatives joined by ``|``, links each once."""
    parts = type_parts(descriptor, names)
    return " | ".join(p.text for p in parts) or None, list(dict.fromkeys(x for p in parts for x in p.links))


def _at(node, *path):
    for i in path:
        if not isinstance(node, (list, dict)) or isinstance(node, list) and (not isinstance(i, int) or len(node) <= i) or isinstance(node, dict) and i not in node:
            return None
        node = node[i]
    return node


def _text_at(node, *path) -> str | None:
    value = _at(node, *path)
    return str(value) if isinstance(value, (str, int)) and not isinstance(value, bool) and str(value) else None


def module_context(header: dict) -> str | None:
    """A common module's flags as a list; null if none is set or they are not there."""
    record = _at(header, "header", 0, 1)
    flags = [x for x in record[2:] if not isinstance(x, list)] if isinstance(record, list) else []
    if len(flags) < 8:
        return None
    return ",".join(name for i, name in CONTEXT_FLAGS if flags[i] == "1" or i == 6 and flags[i] == "2") or None


def register_properties(kind: str, header: dict) -> dict[str, str]:
    """periodicity (a code) and write_mode (recorder or independent) of a register."""
    if kind in RECORDER_ONLY:
        return {"write_mode": "recorder"}
    if kind != "InformationRegister":
        return {}
    record, out = _at(header, "header", 0, 1), {}
    if (code := _text_at(record, PERIODICITY_AT)) is not None:
        out["periodicity"] = code
    if (mode := {"1": "recorder", "0": "independent"}.get(_text_at(record, WRITE_MODE_AT))) is not None:
        out["write_mode"] = mode
    return out


def configuration_properties(header: dict) -> dict[str, str]:
    """version and name_prefix of a configuration."""
    record = _at(header, "header", 0, 3, 1, 1)
    found = {"version": unquote(_text_at(record, VERSION_AT)), "name_prefix": unquote(_text_at(record, PREFIX_AT))}
    return {k: v for k, v in found.items() if v}


#: Codes of an information register's periodicity, where a package has its namespace, and kinds of bases.
PERIODICITY = {"0": "непериодический", "1": "год", "2": "квартал", "3": "месяц", "4": "день", "5": "секунда", "6": "позиция регистратора"}
NAMESPACE_AT = 2
FILE_KINDS = {"cf": "Конфигурация", "cfe": "Расширение конфигурации", "epf": "Внешняя обработка", "erf": "Внешний отчёт"}
ROOT_KINDS = {"Configuration": "Конфигурация", "ConfigurationExtension": "Расширение конфигурации", "ExternalDataProcessor": "Внешняя обработка", "ExternalReport": "Внешний отчёт"}


def card_properties(kind: str, header: dict) -> list[tuple[str, str]]:
    """(name, value) of what an object's card says of it beside its parts: a register's periodicity and
    write mode, a package's namespace, a subscription's event, method and number of sources."""
    own = register_properties(kind, header)
    if "periodicity" in own:
        own["periodicity"] = PERIODICITY.get(own["periodicity"], own["periodicity"])
    if kind == "XDTOPackage":
        namespace = unquote(_text_at(header, "header", 0, 1, NAMESPACE_AT))
        own = {"namespace": namespace} if namespace else {}
    if kind == "EventSubscription" and (found := event_subscription(header)):
        own = {"event": found["event"], "method": found["method"] or "", "sources": str(len(found["sources"]))}
    return sorted(own.items())


#: Where an event subscription has its parts, and where sources are named by.
SOURCES_AT, EVENT_AT, HANDLER_AT, METHOD_AT, SELF_AT = 2, 3, 4, 5, (1, 4)


def _uuid_or_none(x) -> str | None:
    return x if isinstance(x, str) and UUID.fullmatch(x) else None


def self_uuid(header: dict) -> str | None:
    """The uuid by which event subscriptions name an object as their source."""
    return next(filter(None, (_uuid_or_none(_at(header, "header", 0, 1, i)) for i in SELF_AT)), None)


def event_subscription(header: dict) -> dict | None:
    """event, handler (a module's uuid), method and sources of a subscription; None for what is none."""
    record = _at(header, "header", 0, 1)
    sources, event = _at(record, SOURCES_AT), unquote(_at(record, EVENT_AT))
    if not (isinstance(sources, list) and sources and unquote(sources[0]) == "Pattern" and event and _at(record, METHOD_AT) is not None):
        return None
    own = [x for x in (_uuid_or_none(_at(s, 1)) for s in sources[1:]) if x]
    return {"event": event.partition("_")[2] or event, "handler": _uuid_or_none(_at(record, HANDLER_AT)), "method": unquote(_at(record, METHOD_AT)) or None, "sources": own}


def exchange_content(header: dict) -> list[str]:
    """uuids of an exchange plan's content: pairs (uuid, flag) behind two leading values."""
    info = header.get("info") if isinstance(header, dict) else None
    while isinstance(info, list) and len(info) == 1 and isinstance(info[0], list):
        info = info[0]
    pairs = info[2:] if isinstance(info, list) else []
    return [u for u in map(_uuid_or_none, pairs[: len(pairs) // 2 * 2 : 2]) if u]


def event_index(objects: DataFrame) -> DataFrame:
    """subscription, event, method, handler and source (paths, null where unknown) of all
    subscriptions; objects: path, type, uuid, header_json."""
    from pyspark.sql import functions as F

    from lodestone.operators.code import expand

    def subscription(text):
        found = event_subscription(_json(text))
        return [(found["event"], found["method"], found["handler"], u) for u in found["sources"] or [None]] if found else []

    def own(text):
        u = self_uuid(_json(text))
        return [(u,)] if u else []

    subs = expand(objects.where("type = 'EventSubscription'"), ["path"], "header_json", "event string, method string, handler_uuid string, source_uuid string", subscription)
    sources = expand(objects.where("type <> 'EventSubscription'"), ["path"], "header_json", "source_uuid string", own).groupBy("source_uuid").agg(F.min("path").alias("source"))
    modules = objects.select(F.col("uuid").alias("handler_uuid"), F.col("path").alias("handler")).where("handler_uuid is not null")
    return subs.join(sources, "source_uuid", "left").join(modules, "handler_uuid", "left").select(F.col("path").alias("subscription"), "event", "method", "handler", "source", "source_uuid")


def _json(text) -> dict:
    try:
        found = json.loads(text)
    except (TypeError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


DERIVED_ROWS = "object_id long, part string, ord int, name string, tabular string, uuid string, type_str string, links array<struct<uuid:string,path:string>>, count int"


def _derived(ident: int, text: str | None, names: Names) -> Iterator[tuple]:
    """The rows of one header."""
    try:
        header = json.loads(text)
    except (TypeError, ValueError):
        return
    body = header.get("header") if isinstance(header, dict) else header
    for n, a in enumerate(attributes(body)):
        shown, links = type_text(a.type, names)
        yield ident, "attribute", n, a.name, a.tabular, a.uuid, shown, [{"uuid": u, "path": p} for u, p in links], None
    for n, (name, own, count) in enumerate(sections(body)):
        yield ident, "section", n, name, None, own, None, [], count
    for n, name in enumerate(enum_values(body)):
        yield ident, "value", n, name, None, None, None, [], None


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    link = pa.list_(pa.struct([("uuid", pa.string()), ("path", pa.string())]))
    types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), link, pa.int32()]
    fields = ["object_id", "part", "ord", "name", "tabular", "uuid", "type_str", "links", "count"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], fields)


def derive(objects: DataFrame, names: Names) -> DataFrame:
    """object_id, part (attribute, section or value), ord, name, tabular, uuid, type_str, links
    and count, from objects (id, header_json); headers that are no JSON give nothing."""
    sent = objects.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        for batch in batches:
            found = [r for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in _derived(i, t, sent.value)]
            if found:
                yield _batch_of(found)

    return objects.select("id", "header_json").mapInArrow(run, DERIVED_ROWS)


MOST_DEFINED = 100  # defined types inside defined types


def names_by_object(objects: DataFrame, references: DataFrame) -> DataFrame:
    """(object_id, names): what the uuids in each object's header lead to, by joins on the uuid.

    ``objects``: id, path, name, type, uuid, header_json; ``references``: uuid, name. A header
    needs the uuids in it, and those in the definitions of the defined types among them, and
    so on, until nothing is new. Nobody holds the names of a whole base: a row has what its
    header names, and a name that many headers use is one row on the other side of each join."""
    from pyspark.sql import functions as F

    from lodestone.lineage import cut
    from lodestone.operators.code import expand

    def definition(text):
        record = _at(_json(text), "header", 0, 1)
        return [(record[1], json.dumps(record[4]))] if isinstance(record, list) and len(record) > 4 and isinstance(record[1], str) else []

    uuids = lambda column: F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(UUID.pattern), F.lit(0)))).alias("u")
    defined = expand(objects.where("type = 'DefinedType'"), ["path"], "header_json", "u string, members string", definition)
    defined = cut(defined.groupBy("u").agg(F.max(F.struct("path", "members")).alias("d")).select("u", "d.*"))
    inner = defined.select(F.col("u").alias("outer"), uuids("members")).distinct()
    need = fresh = cut(objects.select(F.col("id").alias("object_id"), uuids("header_json")))
    for _ in range(MOST_DEFINED):
        fresh = cut(fresh.withColumnRenamed("u", "outer").join(inner, "outer").select("object_id", "u").distinct().join(need, ["object_id", "u"], "left_anti"))
        if fresh.isEmpty():
            break
        need = need.unionByName(fresh)
    else:
        raise DataError(f"defined types inside defined types, more than {MOST_DEFINED} levels")
    none = F.lit(None).cast("string")
    targets = objects.where(F.col("type").isin(*REFERENCE_TARGETS) & (F.size(F.split("path", "/")) == 2)).select("name", F.col("path").alias("p"))
    known = references.groupBy(F.col("uuid").alias("u")).agg(F.max("name").alias("name")).join(targets, "name", "left")
    own = objects.where("uuid is not null").groupBy(F.col("uuid").alias("u")).agg(F.max("path").alias("p"))
    found = need.join(own, "u").select("object_id", F.lit("object").alias("kind"), "u", none.alias("name"), F.col("p").alias("path"), none.alias("members")).unionByName(
        need.join(known, "u").select("object_id", F.lit("name").alias("kind"), "u", "name", F.col("p").alias("path"), none.alias("members"))).unionByName(
        need.join(defined, "u").select("object_id", F.lit("defined").alias("kind"), "u", none.alias("name"), "path", "members"))
    return found.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("kind", "u", "name", "path", "members"))).alias("names"))


def _names(rows: list[dict] | None) -> Names:
    """`Names` from what `names_by_object` gives one header."""
    out = Names()
    for r in rows or ():
        if r["kind"] == "object":
            out.by_uuid[r["u"]] = r["path"]
        elif r["kind"] == "defined":
            out.defined[r["u"]] = (r["path"], json.loads(r["members"]))
        else:
            out.references[r["u"]] = r["name"]
            if r["path"] is not None and r["path"] not in out.by_name[r["name"]]:
                out.by_name[r["name"]].append(r["path"])
    return out


def derive_joined(objects: DataFrame, references: DataFrame) -> DataFrame:
    """As `derive`, with the names that each header needs joined to it: nothing is broadcast or collected."""
    from pyspark.sql import functions as F

    names = names_by_object(objects, references).withColumnRenamed("object_id", "id")

    def run(batches):
        for batch in batches:
            found = [r for i, t, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True) for r in _derived(i, t, _names(n))]
            if found:
                yield _batch_of(found)

    return objects.select("id", "header_json").join(names, "id", "left").select("id", "header_json", F.col("names")).mapInArrow(run, DERIVED_ROWS)
