"""Bases and groups: the registry of what can be queried, and fan-out over several.

A base is a folder of Parquet tables (or given DataFrames). All bases of a call become
one plan with a leading ``base`` column; a base that fails its checks is reported beside
the result and does not stop the others.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import BadArguments, EngineError, SchemaMismatch, category
from lodestone.operators import scopes
from lodestone.schema import DERIVED, REVISION, TABLES
from lodestone.sources import versions


@dataclass
class Base:
    path: str
    revision: int = REVISION
    tables: dict[str, DataFrame] = field(default_factory=dict)
    folder: str = ""  # of the version that was the latest (or the asked one) when the base was opened
    version: int = 0
    content: str | None = None  # names that version's content


class Catalog:
    """Opened bases by alias, groups of them by name, and the active one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.bases, self.groups = spark, {}, {}
        self.active: str | None = None
        self.active_group: str | None = None
        self.failures: dict[tuple[str, str], Exception] = {}  # (alias, table) -> why its last read left the base out

    # bases

    def open(self, path: str, alias: str | None = None, tables: dict[str, DataFrame] | None = None, revision: int | None = None, version: int | None = None) -> str:
        """Registers a base; an alias that is taken gets the suffix _2, _3 ...

        The latest version (or ``version``) is read from now on, also if others are committed
        later; its manifest says the schema revision, unless ``revision`` does."""
        stem = alias or PurePosixPath(path.rstrip("/")).stem
        name, n = stem, 1
        while name in self.bases:
            n += 1
            name = f"{stem}_{n}"
        found = versions.Version(0, path, None, None) if tables else versions.resolve(self.spark, path, version)
        own = next((r for r in (revision, found.revision) if r is not None), REVISION)
        self.bases[name] = Base(path, own, dict(tables or {}), found.folder, found.number, found.id)
        self.active = self.active or name
        return name

    def use(self, alias: str) -> None:
        self._base(alias)
        self.active, self.active_group = alias, None

    def close(self, alias: str) -> None:
        self._base(alias)
        del self.bases[alias]
        self.failures = {k: e for k, e in self.failures.items() if k[0] != alias}
        for members in self.groups.values():
            if alias in members:
                members.remove(alias)
        if self.active == alias:
            self.active = next(iter(self.bases), None)

    def list(self) -> DataFrame:
        rows = [(a, b.path, b.revision, a == self.active) for a, b in self.bases.items()]
        return self.spark.createDataFrame(rows, "alias string, path string, revision int, active boolean")

    def _base(self, alias: str) -> Base:
        if alias not in self.bases:
            raise BadArguments(f"no base {alias!r}")
        return self.bases[alias]

    # groups, with names that do not depend on case

    def group_create(self, name: str) -> None:
        if name.lower() in self.groups:
            raise BadArguments(f"group {name!r} exists")
        self.groups[name.lower()] = []

    def _group(self, name: str) -> list[str]:
        if name.lower() not in self.groups:
            raise BadArguments(f"no group {name!r}")
        return self.groups[name.lower()]

    def group_add(self, name: str, alias: str) -> None:
        self._base(alias)
        if alias not in self._group(name):
            self._group(name).append(alias)

    def group_remove(self, name: str, alias: str) -> None:
        if alias not in self._group(name):
            raise BadArguments(f"{alias!r} is not in group {name!r}")
        self._group(name).remove(alias)

    def group_use(self, name: str) -> None:
        self._group(name)
        self.active_group = name.lower()

    def group_close(self, name: str) -> None:
        self._group(name)
        del self.groups[name.lower()]
        if self.active_group == name.lower():
            self.active_group = None

    def group_list(self) -> DataFrame:
        rows = [(g, a, g == self.active_group) for g, members in self.groups.items() for a in members or [None]]
        return self.spark.createDataFrame(rows, "name string, alias string, active boolean")

    # fan-out

    def scope(self, db: str | list[str] | None = None, group: str | None = None) -> list[str]:
        """The aliases of a call: a group before bases before what is active; '*' is all."""
        if group:
            return list(self.bases) if group == "*" else list(self._group(group))
        if db:
            return list(self.bases) if db == "*" else [db] if isinstance(db, str) else list(db)
        if self.active_group:
            return list(self._group(self.active_group))
        if self.active:
            return [self.active]
        raise BadArguments("no base is open")

    def fingerprints(self) -> DataFrame:
        """alias and fingerprint (the source file's SHA-256, null where none is stored) of all open bases."""
        rows = self.spark.createDataFrame([(a,) for a in self.bases], "alias string")
        known = self.table("source", "*") if self.bases else None
        if known is None:
            return rows.withColumn("fingerprint", F.lit(None).cast("string"))
        one = known.groupBy(F.col("base").alias("alias")).agg(F.min(F.lower("file_sha256")).alias("fingerprint"))
        return rows.join(one, "alias", "left")

    def pinned(self, db: str | None = None, scope: list[str] | None = None, expect: dict[str, str] | None = None) -> DataFrame:
        """alias, state (asked, in_scope, outside or rejected), fingerprint, expected and reason of each open base.

        ``scope`` names the bases beside the asked one in which names are looked up (all open
        ones without it). ``expect`` pins bases by alias to a fingerprint or its beginning: a
        base that is another snapshot is rejected, and so is one without a fingerprint; for the
        asked base that is an error, as the answer would be about another release."""
        asked = self.scope(db)[0]
        self._base(asked)
        low = {a.lower(): a for a in self.bases}
        pins = {}
        for alias, prefix in (expect or {}).items():
            if alias.lower() not in low:
                raise BadArguments(f"a snapshot is expected of {alias!r}, which is not open")
            pins[low[alias.lower()]] = str(prefix)
        for alias in scope or []:
            if alias.lower() not in low:
                raise BadArguments(f"no base {alias!r} for the scope")
        inside = set(self.bases) if scope is None else {low[a.lower()] for a in scope}
        rows = [(a, a == asked, a in inside, pins.get(a)) for a in self.bases]
        found = scopes.states(self.spark.createDataFrame(rows, "alias string, asked boolean, inside boolean, expected string"), self.fingerprints())
        bad = found.where("asked and reason is not null").first()
        if bad:
            raise BadArguments(f"{asked}: {bad.reason}")
        return found.drop("asked", "inside")

    def by_fingerprint(self, pins: DataFrame) -> DataFrame:
        """``pins`` (pin, prefix) with n_bases, base and state: see `scopes.resolve_pins`."""
        return scopes.resolve_pins(pins, self.fingerprints())

    def check(self, alias: str) -> Base:
        base = self._base(alias)
        if base.revision != REVISION:
            raise SchemaMismatch(f"{alias}: revision {base.revision}, this engine reads {REVISION}")
        return base

    def has(self, base: Base, name: str) -> bool:
        """Whether the base holds the table."""
        if name in base.tables:
            return True
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.folder or base.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def read(self, base: Base, name: str) -> DataFrame:
        if name in base.tables:
            return base.tables[name]
        known = TABLES | DERIVED
        reader = self.spark.read.schema(known[name]) if name in known else self.spark.read
        return reader.parquet(f"{base.folder or base.path}/{name}")

    def table(self, name: str, db=None, group: str | None = None) -> DataFrame:
        """A table over all sound bases of the scope, with the column ``base`` in front (a
        column of that name in the table itself becomes ``own_base``).

        A base that cannot be read is left out with a warning, and `status` names it."""
        parts, errors = [], []
        for alias in self.scope(db, group):
            try:
                own = self.read(self.check(alias), name).withColumnRenamed("base", "own_base")
                parts.append(own.select(F.lit(alias).alias("base"), "*"))
                self.failures.pop((alias, name), None)
            except (EngineError, AnalysisException) as e:
                errors.append(e)
                self.failures[alias, name] = e
        if not parts:
            raise errors[0] if errors else BadArguments("the scope is empty")
        for e in errors:
            warnings.warn(f"{name} is incomplete: {str(e).splitlines()[0]}", stacklevel=2)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def status(self, db=None, group: str | None = None) -> DataFrame:
        """base, status (ok or error), error (category) and message of each base in the scope; a base
        that the last read of some table left out is an error."""
        rows = []
        for alias in self.scope(db, group):
            try:
                self.check(alias)
                lost = {table: e for (base, table), e in self.failures.items() if base == alias}
                if lost:
                    first = next(iter(lost.values()))
                    rows.append((alias, "error", category(first), f"{', '.join(lost)}: {str(first).splitlines()[0]}"))
                else:
                    rows.append((alias, "ok", None, None))
            except EngineError as e:
                rows.append((alias, "error", category(e), str(e)))
        return self.spark.createDataFrame(rows, "base string, status string, error string, message string")
