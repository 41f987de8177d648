"""Role-rights files: targets, their rights with restrictions, and restriction templates."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.errors import DataError
from lodestone.sources import brace

#: Known versions of the format.
VERSIONS = ("8", "9", "10")
UNSET = "-1"


@dataclass
class Right:
    uuid: str
    value: str
    rls: str | None = None


@dataclass
class Target:
    uuid: str
    flags: str | None
    sub_index: int | None = None
    collection: str | None = None
    rights: list[Right] = field(default_factory=list)


@dataclass
class RoleRights:
    version: str
    targets: list[Target]
    templates: list[tuple[str, str]]


def _is_uuid(x) -> bool:
    return isinstance(x, str) and brace.UUID.fullmatch(x) is not None


def _number(x) -> bool:
    return isinstance(x, str) and x.lstrip("-").isdigit()


def _rights(record: list) -> list[Right]:
    """(right, value) pairs; counters are passed over; blocks that start with a right's UUID
    carry its restriction."""
    flat = [x for x in record[1:] if not isinstance(x, list)]
    blocks = [x for x in record[1:] if isinstance(x, list) and x and _is_uuid(x[0])]
    values = iter(flat[1:] if flat and _number(flat[0]) else flat)
    out = []
    for x in values:
        if _is_uuid(x):
            out.append(Right(x.lower(), str(next(values, UNSET))))
    for b in blocks:
        text = next((brace.unquote(v) for _, v in brace.walk(b[1:]) if isinstance(v, str) and v.startswith('"') and len(v) > 2), None)
        if text is None:
            continue
        owner = next((r for r in reversed(out) if r.uuid == b[0].lower()), None)
        if owner is None:
            out.append(owner := Right(b[0].lower(), UNSET))
        owner.rls = text
    return out


def _target(record: list) -> Target:
    item = lambda i: record[i] if len(record) > i else None
    nested = item(3)
    if isinstance(nested, list) and nested:
        flags = (item(2), item(4))
        sub = int(nested[0]) if _number(nested[0]) else None
        collection = nested[1].lower() if len(nested) > 1 and isinstance(nested[1], str) else None
    else:
        flags, sub, collection = (item(2), nested), None, None
    shown = None if flags == (None, None) else "/".join(":".join(map(str, f)) if isinstance(f, list) else str(f) for f in flags)
    return Target(str(item(1) or "").lower(), shown, sub, collection)


def parse(text: str) -> RoleRights:
    """The rights of one role; an unknown version is an error, never "no rights"."""
    top = brace.parse(text)
    root = top[0] if top else []
    if not isinstance(root, list) or len(root) < 3 or root[0] not in VERSIONS:
        raise DataError(f"unknown format of role rights: {str(root)[:60]}")
    targets: list[Target] = []
    for group in root[1][1:] if isinstance(root[1], list) else []:
        for record in group if group and isinstance(group[0], list) else [group]:
            if isinstance(record, list) and len(record) > 1 and record[0] == "1" and _is_uuid(record[1]):
                targets.append(_target(record))
            elif isinstance(record, list) and record and targets:
                targets[-1].rights += _rights(record)
    templates = []
    for row in root[2][1:] if isinstance(root[2], list) else []:
        for pair in row if row and isinstance(row[0], list) else [row]:
            if isinstance(pair, list) and len(pair) > 1:
                templates.append((brace.unquote(pair[0]), brace.unquote(pair[1])))
    return RoleRights(root[0], targets, templates)


RIGHTS = "target_ord int, target_uuid string, sub_index int, collection_uuid string, target_flags string, right_uuid string, value string, rls_text string"
STATE = "version string, parsed boolean, targets int, rights int, rls_templates int, error string"


def read_rights(files: DataFrame, key: str, content: str) -> DataFrame:
    """One row per right of each file, and one row per file with ``state`` set (right null)."""
    schema = f"{key} {files.schema[key].dataType.simpleString()}, {RIGHTS}, state struct<{STATE.replace(' ', ':').replace(',:', ',')}>"

    def run(batches):
        names = [key, *(f.split()[0] for f in RIGHTS.split(", ")), "state"]
        for batch in batches:
            ids, rows, states = [], [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                try:
                    r = parse(brace.decode(bytes(raw)))
                    found = [(n, t.uuid, t.sub_index, t.collection, t.flags, x.uuid, x.value, x.rls) for n, t in enumerate(r.targets) for x in t.rights]
                    state = {"version": r.version, "parsed": True, "targets": len(r.targets), "rights": len(found), "rls_templates": len(r.templates), "error": None}
                except (DataError, TypeError) as e:
                    found, state = [], {"version": None, "parsed": False, "targets": 0, "rights": 0, "rls_templates": 0, "error": str(e)}
                rows += [*found, (None,) * 8]
                states += [*[None] * len(found), state]
                ids += [i] * (len(found) + 1)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            types = [pa.int32(), pa.string(), pa.int32(), *[pa.string()] * 5]
            state_type = pa.struct([("version", pa.string()), ("parsed", pa.bool_()), ("targets", pa.int32()), ("rights", pa.int32()), ("rls_templates", pa.int32()), ("error", pa.string())])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True)), pa.array(states, state_type)], names)

    return files.select(key, content).mapInArrow(run, schema)
