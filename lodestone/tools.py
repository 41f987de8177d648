"""The public operations over the tables of one or several bases.

Every operation returns a DataFrame with the column ``base`` in front. ``db`` is an
alias, a list of aliases or '*'; ``group`` a group's name; without both the active base or
group counts. Names may be given as ``Справочник.X`` or ``Catalog/X``.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.catalog import Catalog
from lodestone.errors import BadArguments, DataError
from lodestone.functions import code as C
from lodestone.functions.paths import compatibility, russian_path, slash_path, source_ext
from lodestone.functions.right_names import with_right_names
from lodestone.lineage import cut
from lodestone.operators import align as A
from lodestone.operators import code as K
from lodestone.operators import diff as D
from lodestone.operators import graph as G
from lodestone.operators import needles, paging, scopes, search, tree
from lodestone.operators import rights as R
from lodestone.ql import checker
from lodestone.sources import edges as call_edges
from lodestone.sources import gram_index, metadata
from lodestone.sql_access import rewrite_paths, run_sql, table_functions

TARGET = ["target_uuid", "target_object_id", "target_attr_id", "target_tabular_id", "sub_index", "collection_uuid", "target_flags"]
TARGET_NO_FLAGS = TARGET[:-1]
TEXT_LIMIT = 20_000
EXTERNAL = r"Ссылка: ([^/|.()]+?)(?= \(|\s*\||\s*\)|\s*$)"  # names of references that are no path
ACCESS_CHECK = "ПравоДоступа"  # fixed value: the platform's function that asks for a right
NESTING, MOST_NESTING = 4, 100  # levels of types inside types: listed without asking whether there are more, and at most


def _card_properties(both: str) -> list[tuple[int, str, str]]:
    found = json.loads(both)
    return [(n, *p) for n, p in enumerate(metadata.card_properties(found.get("type") or "", metadata._json(found.get("header_json"))))]


def _configuration(text: str) -> list[tuple[str | None, str | None, str | None]]:
    header = metadata._json(text)
    found = metadata.configuration_properties(header)
    code = header.get("compatibility_version")
    return [(found.get("version"), found.get("name_prefix"), str(code) if code else None)]


class Tools:
    """All operations on the bases of a catalog."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.spark = catalog, catalog.spark
        self.totals = paging.Memo()

    def _t(self, name, db, group) -> DataFrame:
        return self.catalog.table(name, db, group)

    def _objects(self, db, group, path: str | None = None) -> DataFrame:
        o = self._t("meta_object", db, group)
        return o if path is None else o.where(F.lower("path") == slash_path(path).lower())

    @staticmethod
    def _of(rows: DataFrame, objects: DataFrame, key: str = "object_id", *keep: str) -> DataFrame:
        """Rows of the given objects, with the objects' columns ``keep``."""
        o = objects.select(F.col("base").alias("__b"), F.col("id").alias("__o"), *keep)
        return rows.join(o, (rows["base"] == F.col("__b")) & (rows[key] == F.col("__o"))).drop("__b", "__o")

    # catalog

    def find_objects(self, mask: str = "", type: str | None = None, limit=None, offset=0, db=None, group=None) -> DataFrame:
        o = self._objects(db, group).where(F.col("path") != "")
        kind = F.lit(True) if not type else (F.lower("type") == type.lower()) | (F.lower("type_ru") == type.lower())
        found = o.where(search.mask(["name", "path"], mask) & kind).select("base", "path", "type", "name", "comment", "id")
        return paging.page(found, ["base", F.length("path"), "path", "id"], limit, offset).drop("id")

    def find_objects_total(self, mask: str = "", type: str | None = None, limit=None, offset=0, db=None, group=None) -> DataFrame:
        """The page's note; the total is remembered for the contents of the bases and what is asked, however it is written."""
        o = self._objects(db, group).where(F.col("path") != "").where(search.mask(["name", "path"], mask))
        found = o if not type else o.where((F.lower("type") == type.lower()) | (F.lower("type_ru") == type.lower()))
        key = ("find_objects", mask.replace(" ", "").lower(), (type or "").lower())
        return paging.noted(self.spark, self._total(key, found, db, group), limit, offset)

    def _total(self, key: tuple, found: DataFrame, db, group) -> int:
        """The number of rows of ``found``; bases without a content id are counted each time."""
        aliases = self.catalog.scope(db, group)
        contents = [self.catalog.bases[a].content for a in aliases if a in self.catalog.bases]
        if len(contents) < len(aliases) or None in contents:
            return found.count()
        return self.totals.get((*key, tuple(sorted(contents))), found.count)

    def object_card(self, path: str, db=None, group=None) -> DataFrame:
        """Sections of one object as rows: section, ord, text."""
        o = self._objects(db, group, path)
        row = lambda df, name, ord_, text: df.select("base", F.lit(name).alias("section"), ord_.cast("long").alias("ord"), text.cast("string").alias("text"))
        t = lambda name: self._of(self._t(name, db, group), o)
        kids = self._objects(db, group).withColumnRenamed("id", "kid")
        kids = self._of(kids, o, "parent_id")
        refs = self.refs_of(path, db=db, group=group)
        parts = [
            row(o, "header", F.lit(0), F.concat_ws(" | ", russian_path(F.col("path")), "type_ru", "uuid", "comment")),
            row(t("meta_attribute"), "attributes", F.col("ord"), F.concat_ws(" ", F.concat_ws(".", "tabular", "name"), F.concat(F.lit(": "), "type_str"))),
            row(t("meta_tabular"), "sections", F.col("ord"), F.col("name")),
            row(t("enum_value"), "values", F.col("ord"), F.col("name")),
            row(t("predefined"), "predefined", F.col("ord"), F.concat_ws(" ", "code", "name")),
            row(t("module"), "modules", F.col("id"), F.concat_ws(" ", "code_name", "context")),
            row(kids, "children", F.col("ord"), F.concat_ws(" ", tree.bucket_of(F.col("type")), "name")),
            row(t("skd_query"), "queries", F.col("ord"), F.left("query", F.lit(150))),
            row(t("xdto_type"), "xdto", F.col("ord"), F.concat_ws(" ", "kind", "name")),
            row(refs.withColumn("n", F.lit(0)), "references", F.col("n"), F.concat_ws(" ", "direction", "path")),
        ]
        own = K.expand(o.select("base", F.to_json(F.struct("type", "header_json")).alias("both")), ["base"], "both", "ord int, name string, value string", _card_properties)
        parts.append(row(own, "properties", F.col("ord"), F.concat_ws(": ", "name", "value")))
        content = K.expand(o.where("type = 'ExchangePlan'"), ["base"], "header_json", "uuid string", lambda t: [(u,) for u in metadata.exchange_content(metadata._json(t))])
        members = content.join(self._objects(db, group).select("base", "uuid", "type"), ["base", "uuid"], "left").groupBy("base", F.coalesce("type", F.lit("?")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(row(members, "content", F.lit(0), F.concat_ws(" ", "kind", "n")))
        for alias in self.catalog.scope(db, group):  # subscriptions by their own headers, modules by their uuids
            every = slash_path(path).lower().startswith("eventsubscription/")  # whose sources may be any objects
            some = self._objects(alias, None).where(F.lit(every) | F.col("type").isin("EventSubscription", "CommonModule") | (F.lower("path") == slash_path(path).lower()))
            events = metadata.event_index(some).withColumn("base", F.lit(alias)).withColumn("n", F.lit(0))
            mine = lambda c: events.where(F.lower(c) == slash_path(path).lower())
            parts.append(row(mine("source"), "subscriptions", F.col("n"), F.concat_ws(" ", "subscription", "event", F.concat_ws(".", "handler", "method"))))
            parts.append(row(mine("handler"), "handles", F.col("n"), F.concat_ws(" ", "subscription", "event", "method")))
            parts.append(row(mine("subscription"), "sources", F.col("n"), F.coalesce("source", "source_uuid")))
        return reduce(DataFrame.unionByName, parts)

    def object_tree(self, path: str = "", depth: int = 2, db=None, group=None, limit=None, offset=0) -> DataFrame:
        """Pre-order listing, ``depth`` levels below the object; every base on its own."""
        parts = []
        for alias in self.catalog.scope(db, group):
            o = self._objects(alias, None)
            parts.append(tree.subtree(o, F.lower("path") == slash_path(path).lower(), depth).select(F.lit(alias).alias("base"), "sort_key", "level", "node", "name"))
        return paging.page(reduce(DataFrame.unionByName, parts), ["base", "sort_key"], limit, offset)

    def find_field(self, name: str, limit=None, offset=0, db=None, group=None) -> DataFrame:
        a = self._t("meta_attribute", db, group).where(search.mask(["name"], name))
        both = self._of(a, self._objects(db, group), "object_id", "path").select("base", "path", "tabular", "name", "type_str", "ord", "id")
        return paging.page(both, ["base", "path", F.col("tabular").asc_nulls_first(), "ord", "id"], limit, offset).drop("ord", "id")

    def _edges(self, db, group) -> DataFrame:
        """base, src, dst, field: object references through attributes."""
        a = self._t("meta_attribute", db, group).select("base", F.col("id").alias("attribute_id"), F.col("object_id").alias("src"), F.col("name").alias("field"))
        r = self._t("attribute_ref", db, group).where("object_id is not null").select("base", "attribute_id", F.col("object_id").alias("dst"))
        return r.join(a, ["base", "attribute_id"]).select("base", "src", "dst", "field")

    def refs_of(self, path: str, direction: str = "both", limit=None, offset=0, db=None, group=None) -> DataFrame:
        """direction (out or in), path and field of direct neighbours, distinct; each direction has its own page."""
        e, o = self._edges(db, group), self._objects(db, group, path)
        names = self._objects(db, group).select("base", F.col("id").alias("other"), "path")
        out = self._of(e, o, "src").select("base", F.lit("out").alias("direction"), F.col("dst").alias("other"), "field")
        back = self._of(e, o, "dst").select("base", F.lit("in").alias("direction"), F.col("src").alias("other"), "field")
        wanted = [df for kind, df in (("out", out), ("in", back)) if direction in (kind, "both")]
        if not wanted:
            raise BadArguments("direction is out, in or both")
        found = (df.join(names, ["base", "other"]).select("base", "direction", "path", "field").distinct() for df in wanted)
        return reduce(DataFrame.unionByName, [paging.page(df, ["base", "path", "field"], limit, offset) for df in found])

    def refs_within(self, path: str, depth: int = 2, db: str | None = None) -> DataFrame:
        """Objects within ``depth`` references, with the least number of steps."""
        alias = self.catalog.scope(db)[0]
        start = self._objects(alias, None, path).select(F.col("id").alias("node"))
        found = G.bfs(self._edges(alias, None), start, depth)
        return found.join(self._objects(alias, None).select(F.col("id").alias("node"), "path"), "node").select(F.lit(alias).alias("base"), "path", "depth")

    def configuration_info(self, db=None, group=None) -> DataFrame:
        """One row per base: source, fingerprint, counts, kind (by the source file's extension, then the root's type),
        version, name_prefix and compatibility."""
        counts = [self._t(n, db, group).groupBy("base").agg(F.count(F.lit(1)).alias(f"n_{n}")) for n in ("meta_object", "module", "method", "meta_attribute", "skd_query", "role_right")]
        out = self._t("source", db, group)
        for c in counts:
            out = out.join(c, "base", "left")
        root = self._objects(db, group).where("path = ''").select("base", "header_json")
        own = K.expand(root, ["base"], "header_json", "version string, name_prefix string, code string", _configuration)
        code = F.col("code")
        own = own.withColumn("compatibility", F.when(code.rlike("^[78][0-9]{3,}$"), compatibility(code)).otherwise(code)).drop("code")
        table = lambda kinds, c: F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[c]
        kind = F.coalesce(table(metadata.FILE_KINDS, source_ext(F.col("file"))), table(metadata.ROOT_KINDS, F.col("root_type")), "root_type")
        return out.fillna(0).withColumn("kind", kind).join(own, "base", "left")

    def db_summary(self) -> DataFrame:
        """One row for each open base: alias, path, active, version, groups, and what `configuration_info` says of it (null for bases that cannot be read)."""
        groups = {a: sorted(g for g, members in self.catalog.groups.items() if a in members) for a in self.catalog.bases}
        rows = [(a, b.path, a == self.catalog.active, b.version, groups[a]) for a, b in self.catalog.bases.items()]
        listed = self.spark.createDataFrame(rows, "alias string, path string, active boolean, stored_version int, groups array<string>")
        info = self.configuration_info("*").select(F.col("base").alias("alias"), "kind", "root_name", "version", "compatibility", "name_prefix", F.left("file_sha256", F.lit(16)).alias("fingerprint"), "n_meta_object", "n_module", "n_method")
        return listed.join(info, "alias", "left")

    # rights

    def _roles(self, db, group, roles) -> DataFrame:
        o = self._objects(db, group).where("type = 'Role'")
        wanted = [roles] if isinstance(roles, str) else list(roles)
        low = [slash_path(r).rpartition("/")[2].lower() for r in wanted]
        return o.where(F.lower("name").isin(low))

    def _role_rows(self, db, group, roles=None) -> DataFrame:
        r = self._t("role_right", db, group)
        o = self._roles(db, group, roles) if roles is not None else self._objects(db, group).where("type = 'Role'")
        return self._of(r, o.withColumnRenamed("name", "role"), "role_id", "role")

    def role_rights(self, role: str, limit=None, offset=0, db=None, group=None) -> DataFrame:
        found = R.targets(self._role_rows(db, group, role), ["base", "role", *TARGET], "target_object_id")
        names = self._objects(db, group).select("base", F.col("id").alias("target_object_id"), "path")
        order = ["base", F.col("path").asc_nulls_last(), "target_uuid", F.col("sub_index").asc_nulls_first(), F.col("target_flags").asc_nulls_first(), F.col("target_attr_id").asc_nulls_first(), F.col("target_tabular_id").asc_nulls_first()]
        return paging.page(found.join(names, ["base", "target_object_id"], "left"), order, limit, offset)

    def role_rights_stats(self, role: str, db=None, group=None) -> DataFrame:
        return R.target_stats(self._role_rows(db, group, role), ["base", *TARGET], "target_object_id", "rls_text")

    def rights_state(self, role: str | None = None, db=None, group=None) -> DataFrame:
        """Whether a role's rights are interpreted, partial, unconfirmed, unavailable or absent."""
        roles = self._roles(db, group, role) if role else self._objects(db, group).where("type = 'Role'")
        s = self._t("role_rights_state", db, group).select("base", F.col("role_id").alias("id"), "parsed", "rights", "error")
        open_ = self._t("role_right", db, group).where("target_object_id is null").groupBy("base", F.col("role_id").alias("id")).agg(F.count(F.lit(1)).alias("open"))
        both = roles.select("base", "id", F.col("name").alias("role")).join(s, ["base", "id"], "left").join(open_, ["base", "id"], "left")
        return both.select("base", "role", R.state(F.col("parsed"), F.coalesce("rights", F.lit(0)), F.coalesce("open", F.lit(0))).alias("state"), "error")

    def object_rights(self, path: str, role: str | None = None, limit=None, offset=0, per_role: int = 12, db=None, group=None) -> DataFrame:
        rows = self._of(self._role_rows(db, group, role), self._objects(db, group, path), "target_object_id", "path")
        keys = rows.select("base", "role", *TARGET).distinct()
        order = [F.col("sub_index").asc_nulls_first(), "target_uuid", F.col("target_attr_id").asc_nulls_first(), F.col("target_tabular_id").asc_nulls_first(), F.col("target_flags").asc_nulls_first()]
        return paging.page(R.targets_per_role(keys, "role", order, per_role), ["base", "role", "rank"], limit, offset)

    def object_rights_note(self, path: str, db=None, group=None) -> DataFrame:
        """One row per base: n_roles with a right to the object, n_targets, n_all_roles, and n_unreadable, the roles whose rights could not be read, so that they may have some."""
        rows = self._of(self._role_rows(db, group), self._objects(db, group, path), "target_object_id", "path")
        found = rows.groupBy("base").agg(F.count_distinct("role_id").alias("n_roles"), F.count_distinct(F.struct(*TARGET)).alias("n_targets"))
        roles = self._objects(db, group).where("type = 'Role'").select("base", F.col("id").alias("role_id"))
        state = self._t("role_rights_state", db, group).select("base", "role_id", "parsed")
        every = roles.join(state, ["base", "role_id"], "left").groupBy("base").agg(F.count(F.lit(1)).alias("n_all_roles"), F.count_if(~F.coalesce("parsed", F.lit(False))).alias("n_unreadable"))
        return every.join(found, "base", "left").fillna(0).select("base", "n_roles", "n_targets", "n_all_roles", "n_unreadable")

    def effective_rights(self, roles: list[str], path: str | None = None, limit=None, offset=0, db=None, group=None) -> DataFrame:
        rows = self._role_rows(db, group, roles)
        rows = rows if path is None else self._of(rows, self._objects(db, group, path), "target_object_id")
        found = with_right_names(R.effective(rows, ["base", *TARGET_NO_FLAGS, "right_uuid", "value"]))
        return paging.page(found, ["base", "target_uuid", F.col("sub_index").asc_nulls_first(), "right_uuid", "value", F.col("target_attr_id").asc_nulls_first(), F.col("target_tabular_id").asc_nulls_first()], limit, offset)

    def role_diff(self, roles_a: list[str], roles_b: list[str], db=None, group=None) -> DataFrame:
        key = ["base", *TARGET_NO_FLAGS, "right_uuid", "value"]
        return with_right_names(R.role_diff(self._role_rows(db, group, roles_a), self._role_rows(db, group, roles_b), key))

    def lost_rights(self, roles_before: list[str], roles_after: list[str], db=None, group=None) -> DataFrame:
        """Rights that the roles before give and those after do not (none: all of them), with their whole key, unresolved targets too."""
        key = ["base", *TARGET_NO_FLAGS, "right_uuid", "value"]
        lost = R.lost_targets(self._role_rows(db, group, roles_before), self._role_rows(db, group, roles_after), key)
        names = self._objects(db, group).select("base", F.col("id").alias("target_object_id"), "path")
        return with_right_names(lost.join(names, ["base", "target_object_id"], "left"))

    def _impact_hits(self, roles_before, roles_after, path, mode, alias) -> DataFrame:
        """base, path, needle, kind and where_id: texts of one base that name an object of which a right is lost."""
        lost = self.lost_rights(roles_before, roles_after, alias).where("target_object_id is not null").select("base", "target_object_id").distinct()
        objects = self._objects(alias, None, path).select("base", F.col("id").alias("target_object_id"), "path", "name", "type")
        targets = lost.join(objects, ["base", "target_object_id"])
        if mode == "literal":
            texts = self._t("module", alias, None).select(F.lit("module").alias("kind"), F.col("id").alias("where_id"), F.col("body").alias("text"))
            named = targets.select("base", "path", F.col("path").alias("needle"))
        else:
            texts = self._t("method", alias, None).select(F.lit("method").alias("kind"), F.col("id").alias("where_id"), F.col("body").alias("text")).unionByName(
                self._t("skd_query", alias, None).select(F.lit("query").alias("kind"), F.col("id").alias("where_id"), F.col("query").alias("text")))
            manager = F.create_map(*(F.lit(x) for k, v in C.MANAGERS.items() for x in (v, k)))
            forms = F.array_compact(F.array(russian_path(F.col("path")), F.concat(manager[F.col("type")], F.lit("."), F.col("name"))))
            named = targets.select("base", "path", F.explode(forms).alias("needle"))
        found = needles.hits(named, "needle", texts, ["kind", "where_id"], "text")
        checks = found.where("kind <> 'query'").join(texts.where(search.body_has(F.col("text"), F.lit(ACCESS_CHECK))).select("kind", "where_id"), ["kind", "where_id"], "left_semi")
        found = found.unionByName(checks.withColumn("kind", F.lit("check")))
        return needles.first_lines(found.withColumn("source", F.when(F.col("kind") == "query", "query").otherwise(F.lit("module" if mode == "literal" else "method"))),
                                   texts.withColumnRenamed("kind", "source"), ["source", "where_id"], "text", "needle")

    def role_impact(self, roles_before: str | list[str], roles_after: list[str] = (), path: str | None = None, mode: str = "intent", db=None, group=None) -> DataFrame:
        """Objects of which any right is lost (on the object or a part of it) and what names them: kind (method, query, or check: a
        method that also asks for access rights), how many and the first.

        With one role and nothing after it, everything that it gives is lost. ``intent`` looks
        for the names that code uses (manager and dotted form) in method bodies and queries;
        ``literal`` for the slash path in module texts."""
        parts = [self._impact_hits(roles_before, roles_after, path, mode, a) for a in self.catalog.scope(db, group)]
        return reduce(DataFrame.unionByName, parts).groupBy("base", "path", "kind").agg(F.count_distinct("where_id").alias("n"), F.min("where_id").alias("first_id"))

    def role_impact_places(self, roles_before: str | list[str], roles_after: list[str] = (), path: str | None = None, most: int = 20, db=None, group=None) -> DataFrame:
        """The places behind `role_impact`: base, path, kind, place, method and line in its module; at most ``most`` of each object and kind, with ``n``, their number."""
        parts = []
        for alias in self.catalog.scope(db, group):
            found = self._impact_hits(roles_before, roles_after, path, "intent", alias).groupBy("base", "path", "kind", "where_id").agg(F.min("line").alias("line"))
            m = self._methods(alias, None).select(F.col("id").alias("where_id"), F.lit(False).alias("q"), F.col("path").alias("place"), F.col("name").alias("method"), F.coalesce("line_start", F.lit(1)).alias("first"))
            q = self._of(self._t("skd_query", alias, None), self._objects(alias, None), "object_id", "path").select(
                F.col("id").alias("where_id"), F.lit(True).alias("q"), F.col("path").alias("place"), F.lit(None).cast("string").alias("method"), F.lit(1).alias("first"))
            parts.append(found.withColumn("q", F.col("kind") == "query").join(m.unionByName(q), ["where_id", "q"]).select("base", "path", "kind", "place", "method", (F.col("first") + F.col("line") - 1).alias("line"), "where_id"))
        return needles.top_per(reduce(DataFrame.unionByName, parts), ["base", "path", "kind"], ["place", "line", "where_id"], most).drop("where_id")

    # code

    def _methods(self, db, group, method: DataFrame | None = None) -> DataFrame:
        m = self._t("module", db, group).select("base", F.col("id").alias("module_id"), "object_id", "code_name")
        both = (self._t("method", db, group) if method is None else method).join(m, ["base", "module_id"])
        return self._of(both, self._objects(db, group), "object_id", "path")

    def _index(self, alias: str) -> tuple[dict | None, str]:
        """(manifest of the base's n-gram index, why there is none)."""
        base = self.catalog.check(alias)
        if "method" in base.tables:
            return None, "the base is not stored"
        try:
            return gram_index.manifest(self.spark, base.path, content=base.content), ""
        except gram_index.StaleIndex as e:
            return None, str(e)

    def index_status(self, db=None, group=None) -> DataFrame:
        """base, indexed and reason: whether searches of texts read the stored n-gram index."""
        rows = [(a, self._index(a)) for a in self.catalog.scope(db, group)]
        return self.spark.createDataFrame([(a, m is not None, why or None) for a, (m, why) in rows], "base string, indexed boolean, reason string")

    def _methods_with(self, text: str, db, group) -> DataFrame:
        """Methods whose body has ``text``: through a base's index where one is valid, by a scan elsewhere."""
        parts, scanned = [], []
        for alias in self.catalog.scope(db, group):
            found = self._index(alias)[0] if len(text) >= gram_index.N else None
            ids = gram_index.candidate_ids(self.spark, self.catalog.check(alias).path, text, found) if found else None
            if ids is None:
                scanned.append(alias)
            else:
                parts.append(self._t("method", alias, None).join(ids, "id", "left_semi"))
        parts += [self._t("method", scanned, None)] if scanned else []
        return self._methods(db, group, reduce(DataFrame.unionByName, parts).where(search.body_has(F.col("body"), F.lit(text))))

    def module_outline(self, path: str, code_name: str | None = None, db=None, group=None) -> DataFrame:
        m = self._of(self._t("module", db, group), self._objects(db, group, path), "object_id", "path")
        return (m if code_name is None else m.where(F.lower("code_name") == code_name.lower())).select("base", "path", "code_name", "context", "body")

    def get_method(self, path: str, name: str, code_name: str | None = None, db=None, group=None) -> DataFrame:
        m = self._methods(db, group).where((F.lower("path") == slash_path(path).lower()) & (F.lower("name") == name.lower()))
        return m if code_name is None else m.where(F.lower("code_name") == code_name.lower())

    def find_method_context(self, path: str, name: str, match: str, before: int = 20, after: int = 20, limit: int = 3, code_name=None, db=None, group=None) -> DataFrame:
        m = self.get_method(path, name, code_name, db, group)
        found = search.context_window(m, "body", ["base", "path", "code_name", "name", "line_start"], match, before, after, limit)
        return found.withColumn("line_no", F.col("line_no") + F.col("line_start") - 1).withColumn("hit_line", F.col("hit_line") + F.col("line_start") - 1).drop("line_start")

    def find_methods(self, mask: str = "", text: str | None = None, path: str | None = None, limit=None, offset=0, db=None, group=None) -> DataFrame:
        m = self._methods(db, group) if text is None else self._methods_with(text, db, group)
        m = m.where(search.mask(["name", "signature", "description"], mask))
        m = m if path is None else m.where(F.lower("path") == slash_path(path).lower())
        return paging.page(m.select("base", "path", "code_name", "kind", "name", "signature", "is_export", "line_start", "id"), ["base", "id"], limit, offset)

    def method_hits(self, text: str, db=None, group=None) -> DataFrame:
        """The first lines with ``text`` of every method that has it."""
        return search.body_hits(self._methods_with(text, db, group), "body", ["base", "path", "code_name", "name"], text)

    def method_dependencies(self, path: str, name: str, code_name=None, scope: list[str] | None = None, expect: dict[str, str] | None = None,
                            callers: bool = False, depth: int = 1, diff_db: str | None = None, db=None, group=None) -> DataFrame:
        """What a method uses: base, kind, line in the module, target, state, place and detail.

        Names are looked up in the method's base, then in those of ``scope`` (see
        `Catalog.pinned`, also for ``expect``); ``place`` is the base that has the name. Kinds
        and states:

        * call (of a common module): ok, not_export, missing_method; ambiguous (several bases
          of the scope have the module), outside (only bases beyond it), unknown (none);
        * metadata: ok, ambiguous, outside, missing;
        * plain (no module before it): own, global;
        * dynamic (a name in an evaluated literal): ok, not_export, missing_method, missing, unknown;
        * query: error (the detail says which), partial (put together at run time, not checked);
        * context: a call from client code to a module that runs on the server only;
        * caller and callee, with ``callers`` or a ``depth`` above 1 (at most 3): the edges of
          `callers` and `callees`, with the verdict against ``diff_db`` if one is given.

        Several bases are answered each for itself, with its own names and query context."""
        if not 1 <= depth <= 3:
            raise BadArguments("depth is 1 to 3")
        return reduce(DataFrame.unionByName, [self._dependencies(path, name, code_name, scope, expect, callers, depth, diff_db, a) for a in self.catalog.scope(db, group)])

    def _dependencies(self, path, name, code_name, scope, expect, callers, depth, diff_db, alias) -> DataFrame:
        bases = self.catalog.pinned(alias, scope, expect).select("alias", "state")
        m = self.get_method(path, name, code_name, alias, None).withColumn("first", F.coalesce("line_start", F.lit(1)))
        uses = K.uses(m, ["object_id", "first"]).withColumn("line", F.col("first") + F.col("line") - 1)
        uses = cut(uses.withColumn("l", F.lower("left")).withColumn("n", F.lower("name")))  # parsed once, read by each kind
        target = F.concat_ws(".", "left", "name")
        row = lambda df, kind, target, state, place=None, detail=None: df.select(
            F.lit(alias).alias("base"), F.lit(kind).alias("kind"), "line", target.alias("target"), state.alias("state"),
            *((F.lit(None).cast("string") if c is None else c).alias(n) for n, c in (("place", place), ("detail", detail))))

        everywhere = self._objects("*", None)
        common = everywhere.where("type = 'CommonModule'").select("base", "path", F.col("id").alias("object_id"), F.lower("name").alias("l"))
        own = self._t("method", "*", None).join(self._t("module", "*", None).select("base", F.col("id").alias("module_id"), "object_id"), ["base", "module_id"])
        exported = own.groupBy("base", "object_id", F.lower("name").alias("n")).agg(F.bool_or("is_export").alias("is_export"))
        dotted = uses.where("kind in ('call', 'dynamic') and l is not null").select("l", "n").distinct()
        fate = F.when(F.col("is_export").isNull(), "missing_method").when(~F.col("is_export"), "not_export").otherwise("ok")
        in_modules = dotted.join(common, "l").join(exported, ["base", "object_id", "n"], "left").select("l", "n", "base", fate.alias("detail"))
        known = cut(scopes.by_scope(in_modules, ["l", "n"], bases))
        calls = uses.where("kind = 'call'").join(known, ["l", "n"], "left")
        where = F.col("where")
        state = F.when(where.isNull(), "unknown").when(where.isin("ambiguous", "outside"), where).otherwise(F.col("detail"))
        kinds = F.create_map(*(F.lit(x) for pair in C.MANAGERS.items() for x in pair))
        managed = uses.where("kind = 'metadata' or kind = 'dynamic'").withColumn("type", F.when(F.col("kind") == "metadata", F.col("left")).otherwise(kinds[F.col("l")])).where("type is not null")
        objects = everywhere.select("base", "type", F.lower("name").alias("n"), F.col("path").alias("detail"))
        found = scopes.by_scope(managed.select("type", "n").distinct().join(objects, ["type", "n"]), ["type", "n"], bases)
        of_type = managed.join(found, ["type", "n"], "left")
        meta_state = F.when(where.isNull(), "missing").when(where.isin("ambiguous", "outside"), where).otherwise("ok")
        names = exported.where(F.col("base") == alias).select("object_id", "n", F.lit(True).alias("own"))
        plain = uses.where("kind = 'plain'").join(names, ["object_id", "n"], "left")
        dynamic = uses.where("kind = 'dynamic'")
        by_module = dynamic.where(F.col("l").isNotNull() & kinds[F.col("l")].isNull()).join(known.where("where = 'here'"), ["l", "n"], "left")
        modules = common.where(F.col("base") == alias).select(F.col("l").alias("n"), "path").distinct()
        alone = dynamic.where("l is null").join(modules, "n", "left").join(names, ["object_id", "n"], "left")
        parts = [
            row(calls, "call", target, state, F.col("base"), F.col("detail")),
            row(of_type.where("kind = 'metadata'"), "metadata", F.concat_ws("/", "type", "name"), meta_state, F.col("base"), F.col("detail")),
            row(plain, "plain", F.col("name"), F.when(F.col("own"), "own").otherwise("global")),
            row(by_module, "dynamic", target, F.coalesce("detail", F.lit("unknown")), F.col("base")),
            row(of_type.where("kind = 'dynamic'"), "dynamic", target, F.when(where == "here", "ok").otherwise("missing"), F.when(where == "here", F.col("base")), F.when(where == "here", F.col("detail"))),
            row(alone, "dynamic", F.col("name"), F.when(F.col("path").isNotNull() | F.col("own"), "ok").otherwise("unknown"), None, F.col("path")),
        ]
        context = checker.Context.from_catalog(self.catalog, alias)
        wrong = K.query_violations(m, ["first"], "body", context).withColumn("line", F.col("first") + F.col("line"))
        parts.append(row(wrong, "query", F.col("message"), F.lit("error")))
        loose = K.query_rows(m, ["first"], "body").where("not complete").withColumn("line", F.col("first") + F.col("line") - 1)
        parts.append(row(loose, "query", F.left("query", F.lit(150)), F.lit("partial")))
        warned = self.context_warnings(path, name, code_name, alias).join(m.select("first").limit(1), how="cross")
        parts.append(row(warned.withColumn("line", F.col("first") + F.col("line") - 1), "context", F.col("target"), F.lit("server_only"), None, F.col("context")))
        for wanted, kind, edges in ((callers, "caller", self.callers), (depth > 1, "callee", self.callees)):
            if wanted:
                e = edges(path, name, depth, diff_db, alias)
                end = F.concat_ws("/", "path", "method") if kind == "caller" else F.col("dst")
                parts.append(row(e, kind, end, F.col("kind"), F.col("path"), F.concat_ws("; ", F.concat(F.lit("depth "), "depth"), F.concat_ws(", ", "conditions"), "verdict")))
        return reduce(DataFrame.unionByName, parts)

    def _edges_of_code(self, alias: str) -> DataFrame:
        """The base's typed call edges: the stored table, or (for bases without it) from the texts."""
        base = self.catalog.check(alias)
        if self.catalog.has(base, "call_edge"):
            return self.catalog.read(base, "call_edge")
        t = lambda name: self._t(name, alias, None).drop("base")
        events = metadata.event_index(t("meta_object")).where("handler is not null and method is not null")
        events = events.select(F.col("subscription").alias("path"), F.col("handler").alias("handler_path"), "method").distinct()
        return call_edges.resolve(call_edges.parse(t("method"), t("module")), t("meta_object"), t("method"), t("module"), events)

    def _with_verdict(self, edges: DataFrame, alias: str, diff_db: str | None) -> DataFrame:
        """``edges`` with how the method that an edge leaves differs in another base: unchanged, changed or missing."""
        if diff_db is None:
            return edges.withColumn("verdict", F.lit(None).cast("string"))
        one = lambda db, tag: self._methods(db, None).groupBy("path", F.lower("name").alias("low")).agg(F.min(F.sha1("body")).alias(tag))
        both = edges.withColumn("low", F.lower("method")).join(one(alias, "a"), ["path", "low"], "left").join(one(diff_db, "b"), ["path", "low"], "left")
        verdict = F.when(F.col("method").isNull(), F.lit(None)).when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
        return both.withColumn("verdict", verdict).drop("low", "a", "b")

    def callers(self, path: str, name: str, depth: int = 1, diff_db: str | None = None, db: str | None = None) -> DataFrame:
        """Edges that lead to a method within ``depth`` (1 to 3) steps: depth, kind, path, code_name, method, line, form, left, conditions, src, dst and verdict.

        Of kinds code, unconfirmed, string, intercept and event only code edges are followed.
        Where the base's edges are stored, no body is read."""
        return self._graph(call_edges.callers, path, name, depth, diff_db, db)

    def callees(self, path: str, name: str, depth: int = 2, diff_db: str | None = None, db: str | None = None) -> DataFrame:
        """Edges that leave a method within ``depth`` steps, as `callers` gives them."""
        return self._graph(call_edges.callees, path, name, depth, diff_db, db)

    def _graph(self, walk, path, name, depth, diff_db, db) -> DataFrame:
        if not 1 <= depth <= 3:
            raise BadArguments("depth is 1 to 3")
        alias = self.catalog.scope(db)[0]
        found = walk(self._edges_of_code(alias), slash_path(path), name, depth)
        return self._with_verdict(found, alias, diff_db).select(F.lit(alias).alias("base"), "depth", "kind", "path", "code_name", "method", "line", "form", "left", "conditions", "src", "dst", "verdict")

    def context_warnings(self, path: str, name: str, code_name=None, db=None, group=None) -> DataFrame:
        """Calls from client code to common modules that run on the server only: line and target."""
        m = self.get_method(path, name, code_name, db, group)
        where = self._t("module", db, group).select("base", F.col("id").alias("module_id"), F.col("context").alias("own"))
        side = lambda words: F.exists(F.split(F.lower(F.coalesce("directives", F.lit(""))), r",\s*"), lambda x: x.isin(*words))
        own = F.lower(F.coalesce("own", F.lit("")))
        has = lambda column, word: F.contains(column, F.lit(word))
        client = (side(C.CLIENT) & ~side(C.SERVER)) | ((side(C.CLIENT) == side(C.SERVER)) & has(own, "клиент") & ~has(own, "сервер"))
        callers = m.join(where, ["base", "module_id"], "left").where(client).select("base", F.col("name").alias("caller"), "body")
        calls = K.call_facts(callers, ["base", "caller"], "body").where("form = 'dotted'")
        modules = self._of(self._t("module", db, group).select("base", "object_id", F.lower("context").alias("context")), self._objects(db, group).where("type = 'CommonModule'").withColumnRenamed("name", "module"), "object_id", "module")
        modules = modules.select("base", F.lower("module").alias("low"), "context")
        both = calls.withColumn("low", F.lower("left")).join(modules, ["base", "low"])
        return both.where(has(F.col("context"), "сервер") & ~has(F.col("context"), "клиент")).select("base", "caller", "line", F.concat_ws(".", "left", "name").alias("target"), "context")

    def call_graph(self, path: str, name: str, depth: int = 2, callers: bool = False, db: str | None = None) -> DataFrame:
        """Methods within ``depth`` (1 to 3) calls (or callers), as module.name keys in lower case, with the least number of steps."""
        if not 1 <= depth <= 3:
            raise BadArguments("depth is 1 to 3")
        alias = self.catalog.scope(db)[0]
        key = lambda end: F.concat_ws(".", F.element_at(F.split(end, "/"), -2), F.element_at(F.split(end, "/"), -1))
        edges = self._edges_of_code(alias).where("kind = 'code'").select(key(F.col("src")).alias("src"), key(F.col("dst")).alias("dst"))
        start = self.spark.range(1).select(F.lit(f"{slash_path(path).rpartition('/')[2]}.{name}".lower()).alias("node"))
        return G.bfs(edges, start, depth, *(("dst", "src") if callers else ("src", "dst")))

    def method_result_schema(self, path: str, name: str, code_name=None, db=None, group=None) -> DataFrame:
        return K.schema_rows(self.get_method(path, name, code_name, db, group).withColumnRenamed("name", "method").withColumnRenamed("kind", "method_kind"), ["base", "path", "method"], "body")

    def query_check(self, db: str | None = None) -> DataFrame:
        """Violations in the query literals of all methods: path, method, line, col, message (0-based)."""
        alias = self.catalog.scope(db)[0]
        m = self._methods(alias, None).select("object_id", "path", F.col("name").alias("method"), "line_start", "body")
        found = K.query_violations(m, ["object_id", "path", "method", "line_start"], "body", checker.Context.from_catalog(self.catalog, alias))
        return found.select("object_id", "path", "method", (F.col("line") + F.col("line_start") - 1).alias("line"), "col", (F.col("line_end") + F.col("line_start") - 1).alias("line_end"), "message")

    # queries and schema packages

    def skd_of(self, path: str, db=None, group=None) -> DataFrame:
        q = self._of(self._t("skd_query", db, group), self._objects(db, group, path), "object_id", "path")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "query"))), lambda x: x["query"]), "\n;\n")
        return q.groupBy("base", "path").agg(F.left(text, F.lit(TEXT_LIMIT)).alias("text"))

    def find_skd(self, mask: str, limit=None, offset=0, db=None, group=None) -> DataFrame:
        q = self._of(self._t("skd_query", db, group).where(search.body_has(F.col("query"), F.lit(mask))), self._objects(db, group), "object_id", "path")
        return paging.page(q.select("base", "path", "ord", search.snippet(F.col("query"), mask).alias("snippet")), ["base", "path", "ord"], limit, offset)

    def xdto_of(self, path: str, type: str | None = None, db=None, group=None) -> DataFrame:
        """level, ord and text of a package's types and properties, nested ones below their property."""
        o = self._objects(db, group, path)
        t = self._of(self._t("xdto_type", db, group), o).withColumnRenamed("id", "type_no")
        p = self._of(self._t("xdto_property", db, group), o)
        inner = p.where("nested_type_id is not null").select("base", F.col("nested_type_id").alias("type_no"), F.col("type_id").alias("outer"))
        level = t.join(inner.select("base", "type_no"), ["base", "type_no"], "left_anti")
        level = level if type is None else level.where(F.lower("name") == type.lower())
        key = lambda prefix, n: F.concat(prefix, F.lpad(n.cast("string"), 8, "0"))
        at = level.select("base", "type_no", F.lit(0).alias("level"), key(F.lit(""), F.col("ord")).alias("sort_key"), F.concat_ws(" ", "kind", "name", "base_ns", "facets", "enum_values").alias("text"))
        out = at
        for depth in range(1, MOST_NESTING + 2):
            if depth > NESTING and at.isEmpty():
                break
            if depth > MOST_NESTING:
                raise DataError(f"{path}: types inside types without end")
            props = at.select("base", F.col("type_no").alias("type_id"), "sort_key").join(p.select("base", "type_id", "ord", "name", "type", "lower_bound", "upper_bound", "nested_type_id"), ["base", "type_id"])
            out = out.unionByName(props.select("base", F.col("type_id").alias("type_no"), F.lit(depth).alias("level"), key(F.col("sort_key"), F.col("ord")).alias("sort_key"),
                                               F.concat_ws(" ", "name", "type", F.concat(F.lit("["), F.coalesce(F.col("lower_bound").cast("string"), F.lit("")), F.lit(".."), F.coalesce(F.col("upper_bound").cast("string"), F.lit("")), F.lit("]"))).alias("text")))
            at = props.where("nested_type_id is not null").select("base", F.col("nested_type_id").alias("type_no"), F.lit(depth).alias("level"), key(F.col("sort_key"), F.col("ord")).alias("sort_key"), F.lit("").alias("text"))
        return out.select("base", "level", "sort_key", "text")

    def find_xdto(self, mask: str, limit=None, offset=0, db=None, group=None) -> DataFrame:
        """Types, then properties, as one list with one paging."""
        o = self._objects(db, group)
        t = self._of(self._t("xdto_type", db, group).where(search.mask(["name"], mask)), o, "object_id", "path").select("base", F.lit(1).alias("section"), "path", "name", "id")
        p = self._of(self._t("xdto_property", db, group).where(search.mask(["name"], mask)), o, "object_id", "path").select("base", F.lit(2).alias("section"), "path", "name", "id")
        return paging.page(t.unionByName(p).where("name is not null"), ["base", "section", "path", "id"], limit, offset)

    def check_query(self, text: str, db: str | None = None) -> checker.Result:
        return checker.check(text, checker.Context.from_catalog(self.catalog, self.catalog.scope(db)[0]))

    def sql(self, query: str, db: str | None = None) -> DataFrame:
        """A query over the base's tables by their names; subtree(path, depth), refs_of(path) and effective(roles) are tables too."""
        from lodestone.schema import TABLES

        alias = self.catalog.scope(db)[0]
        base = self.catalog.check(alias)
        views = self.spark._jsparkSession.sessionState().catalog()
        own = {n: self.spark.table(n) for n in TABLES if views.getTempView(n).isDefined()}  # the user's views of these names come back
        for name in own:
            self.spark.catalog.dropTempView(name)
        try:
            for name in TABLES:
                if self.catalog.has(base, name):
                    self.catalog.read(base, name).createOrReplaceTempView(name)
            with table_functions(self.spark):
                return run_sql(self.spark, rewrite_paths(query))  # names are resolved here, so views and functions can go
        finally:
            for name in TABLES:
                self.spark.catalog.dropTempView(name)
            for name, view in own.items():
                view.createOrReplaceTempView(name)

    # comparison

    def snapshot(self, path: str | None, db: str) -> DataFrame:
        """path, section, key and fingerprint of an object's parts (of all objects without a path)."""
        o = self._objects(db, None, path)
        row = lambda df, section, key, *what: df.select("path", F.lit(section).alias("section"), key.alias("key"), F.sha1(F.to_json(F.struct(*((F.col(w) if isinstance(w, str) else w).alias(f"p{i}") for i, w in enumerate(what))), {"ignoreNullFields": "false"})).alias("fp"))
        t = lambda name: self._of(self._t(name, db, None), o, "object_id", "path")
        key = lambda name, extra: F.when(F.col(extra).isNull(), F.col(name)).otherwise(F.concat_ws("@", name, extra))
        m = self._methods(db, None).join(o.select(F.col("path").alias("p")), F.col("path") == F.col("p"), "left_semi")
        kids = self._of(self._objects(db, None).withColumnRenamed("path", "kid"), o, "parent_id", "path")
        return reduce(DataFrame.unionByName, [
            row(t("meta_attribute"), "attrs", key("name", "tabular"), "type_str"), row(t("meta_tabular"), "tabulars", F.col("name"), "name"),
            row(t("module"), "modules", F.col("code_name"), F.coalesce("context", F.lit("")), F.coalesce("body", F.lit(""))),
            row(m, "methods", F.concat_ws(".", "code_name", F.lower("name")), "body", F.coalesce("directives", F.lit(""))), row(kids, "children", F.col("kid"), "type"),
            row(t("skd_query"), "queries", F.col("ord").cast("string"), "query"), row(t("xdto_type").where("name is not null"), "xdto", F.col("name"), F.coalesce("base_ns", F.lit("")), F.coalesce("facets", F.lit("")))])

    def compare_object(self, path: str, db_left: str, db_right: str, path_right: str | None = None, limit=None, offset=0) -> DataFrame:
        a = self.snapshot(path, db_left).drop("path")
        b = self.snapshot(path_right or path, db_right).drop("path")
        found = D.snapshot_diff(a, b, ["section", "key"], "fp").withColumn("id", F.concat_ws(":", "section", "key"))
        return paging.page(found, [D.section_order(F.col("section")), D.kind_order(F.col("kind")), "key"], limit, offset)

    def config_diff(self, db_left: str, db_right: str, limit=None, offset=0) -> DataFrame:
        side = lambda db: self._objects(db, None).select("path", F.col("id").alias("object_id")).join(self._t("module", db, None).select("object_id", F.col("id").alias("part")), "object_id", "left")
        return paging.page(D.config_diff(side(db_left), side(db_right), "path", "part"), [D.kind_order(F.col("kind")), "path"], limit, offset)

    def config_diff_totals(self, db_left: str, db_right: str) -> DataFrame:
        """One row: objects of each side, of one side only, with another number of modules, and with the same."""
        side = lambda db, tag: self._objects(db, None).select("path").distinct().withColumn(tag, F.lit(1))
        both = side(db_left, "a").join(side(db_right, "b"), "path", "full")
        n = both.agg(F.count("a").alias("n_left"), F.count("b").alias("n_right"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"),
                     F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"))
        count = lambda df: df.groupBy("path").agg(F.count("part").alias("n"))
        part = lambda db: self._objects(db, None).select("path", F.col("id").alias("object_id")).join(self._t("module", db, None).select("object_id", F.col("id").alias("part")), "object_id", "left")
        other = count(part(db_left)).join(count(part(db_right)).withColumnRenamed("n", "m"), "path").agg(F.count_if(F.col("n") != F.col("m")).alias("changed"))
        return n.join(other, how="cross").select("n_left", "n_right", "only_left", "only_right", "changed", (F.col("common") - F.col("changed")).alias("unchanged"))  # two single rows

    def method_verdicts(self, db_left: str, db_right: str, path: str | None = None) -> DataFrame:
        """path, code_name, name and verdict of every method of both bases (of one object with ``path``): only_left,
        only_right, unchanged, formatting, or the aspects that changed (code, parameters, export, directives, kind, comments)."""
        def side(db: str, tag: str) -> DataFrame:
            m = self._methods(db, None)
            m = m if path is None else m.where(F.lower("path") == slash_path(path).lower())
            bare = F.regexp_replace(F.coalesce("signature", F.lit("")), r"\s+", "")
            one = F.struct(F.sha1("body").alias("body"), F.sha1(D.normalized(F.col("body"))).alias("code"), F.lower(bare).alias("signature"), "is_export",
                           F.lower(F.coalesce("directives", F.lit(""))).alias("directives"), "kind", F.coalesce("description", F.lit("")).alias("description"))
            return m.groupBy("path", "code_name", F.lower("name").alias("low")).agg(F.min("name").alias(f"name_{tag}"), F.min_by(one, "id").alias(tag))

        both = side(db_left, "a").join(side(db_right, "b"), ["path", "code_name", "low"], "full")
        differs = lambda *fields: reduce(lambda x, y: x | y, (~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) for f in fields))
        aspects = D.verdict(code=differs("code"), parameters=differs("signature"), export=differs("is_export"), directives=differs("directives"), kind=differs("kind"), comments=differs("description"))
        verdict = (F.when(F.col("b").isNull(), "only_left").when(F.col("a").isNull(), "only_right").when((aspects == "unchanged") & differs("body"), "formatting").otherwise(aspects))
        return both.select("path", "code_name", F.coalesce("name_a", "name_b").alias("name"), verdict.alias("verdict"))

    def method_diff(self, path: str, name: str, db_left: str, db_right: str, code_name: str | None = None, context: int = 3) -> dict:
        """The aspects that changed between two versions of one method."""
        rows = [self.get_method(path, name, code_name, db, None).orderBy("id").limit(1).collect() for db in (db_left, db_right)]
        if not all(rows):
            raise BadArguments(f"no method {name} in {path}")
        both = [C.Method(r[0].ord or 0, r[0].kind, r[0].name, r[0].signature or "", r[0].is_export, r[0].directives or "", r[0].description or "", r[0].line_start or 1, r[0].line_end or 1, r[0].body) for r in rows]
        return C.compare_methods(*both, context=context)

    def _interceptions(self, extension_db: str, *bases: str) -> DataFrame:
        """Interceptions with the digest of their target in each of ``bases`` (found_0, found_1, ...): path, code_name,
        name, id, how, target, low. A target is looked for in the module of the same name, then in the object's others."""
        own = self._methods(extension_db, None).select("id", "path", "code_name", "name", "directives")
        hooks = K.expand(own, ["id", "path", "code_name", "name"], "directives", "how string, target string", C.intercepts).withColumn("low", F.lower("target"))
        for i, db in enumerate(bases):
            methods = self._methods(db, None).select("path", F.lower("name").alias("low"), "code_name", "id", F.sha1("body").alias("digest"))
            best = D.ranked_match(hooks, methods, ["path", "low"], "code_name", "id").withColumnRenamed("found", f"found_{i}")
            hooks = best.drop("found_in").join(methods.select(F.col("id").alias(f"found_{i}"), F.col("digest").alias(f"digest_{i}")), f"found_{i}", "left")
        return hooks

    def extension_diff(self, extension_db: str, base_db: str, base_db_new: str | None = None, prefix: str | None = None, most: int | None = None) -> DataFrame:
        """kind, path, key and state of what an extension does; with ``most``, at most so many rows of each kind, and in ``n`` how many there are.

        Kinds: new objects (state `prefixed` if the name begins with ``prefix``), borrowed ones,
        attributes (added to an object: their number, and the first), own methods (state
        `name_in_base` where the base has a method of that name), interceptions (state: what
        became of the target in the new release: missing, removed, changed or unchanged) and
        external references (names in types that the extension lacks: `found` or `missing` in
        the base, with the object's path)."""
        ext, base = self._objects(extension_db, None).where("path <> ''"), self._objects(base_db, None)
        row = lambda df, kind, key, state: df.select(F.lit(kind).alias("kind"), "path", key.cast("string").alias("key"), state.alias("state"))
        none = F.lit(None).cast("string")
        attrs = lambda db, o: self._of(self._t("meta_attribute", db, None), o, "object_id", "path").select("path", F.concat_ws(".", "tabular", "name").alias("item"))
        added = D.added_items(attrs(extension_db, ext), attrs(base_db, base), "path", "item")
        both = cut(self._interceptions(extension_db, base_db, base_db_new or base_db))
        fate = F.when(F.col("found_0").isNull(), "missing").when(F.col("found_1").isNull(), "removed").when(F.col("digest_0") != F.col("digest_1"), "changed").otherwise("unchanged")
        methods = self._methods(extension_db, None).select("id", "path", "code_name", "name").join(both.select("id").distinct(), "id", "left_anti")
        known = self._methods(base_db, None).select("path", "code_name", F.lower("name").alias("low")).distinct().withColumn("known", F.lit(True))
        own = methods.join(base.select("path"), "path", "left_semi").withColumn("low", F.lower("name")).join(known, ["path", "code_name", "low"], "left")
        new = D.split_new(ext, base, "path")
        parts = [
            row(new, "new", F.col("type"), F.when(F.col("name").startswith(prefix), "prefixed") if prefix else none),
            row(D.split_borrowed(ext, base, "path"), "borrowed", F.col("type"), none),
            row(added, "attributes", F.col("n_added"), F.col("first_item")), row(both, "intercept", F.concat_ws(" ", "how", "target"), fate),
            row(own, "own_method", F.concat_ws(".", "code_name", "name"), F.when(F.col("known"), "name_in_base")),
            row(self.external_refs(extension_db, base_db), "external", F.concat_ws(" ", "name", "n"), F.when(F.col("path").isNull(), "missing").otherwise("found"))]
        out = reduce(DataFrame.unionByName, parts)
        return out if most is None else needles.top_per(out, ["kind"], ["path", "key", F.col("state").asc_nulls_first()], max(1, most))

    def external_refs(self, extension_db: str, base_db: str) -> DataFrame:
        """name, n and path: names of references in the extension's types that it has no object for, how many
        distinct types name them, and the base's object of that name (the least path), if there is one."""
        types = self._t("meta_attribute", extension_db, None).where("type_str is not null").select("type_str").distinct()
        names = types.select(F.explode(F.array_distinct(F.regexp_extract_all("type_str", F.lit(EXTERNAL), F.lit(1)))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        found = self._objects(base_db, None).where(F.size(F.split("path", "/")) == 2).groupBy("name").agg(F.min("path").alias("path"))
        return names.join(found, "name", "left").select("name", "n", "path")

    def control_diff(self, extension_db: str, base_db: str, base_db_new: str) -> DataFrame:
        """Regions of controlled methods that differ between the old release, the new one and the extension: path,
        code_name, name, target, region, state (own, changed, missing, same or conflicting), line ranges in each
        body and numbers of lines.

        The extension's text is taken as it takes effect: lines between its deletion marks are gone,
        the marks too. A method whose target is missing in a release has no lines there."""
        keys = ["path", "code_name", "name", "target"]
        hooks = cut(self._interceptions(extension_db, base_db, base_db_new).where("lower(how) = 'изменениеиконтроль' and found_0 is not null"))
        body = lambda db, key: hooks.select(*keys, F.col(key).alias("id")).join(self._t("method", db, None).select("id", "body"), "id").select(*keys, "body")
        old, new = (A.lines_of(body(db, f"found_{i}"), keys, "body") for i, db in enumerate((base_db, base_db_new)))
        marked = A.marked_lines(A.lines_of(body(extension_db, "id"), keys, "body"), keys)
        return A.three_way(old, new, A.renumbered(marked.where("mark <> 'deleted'"), keys), keys)

    def control_state(self, extension_db: str, base_db: str, base_db_new: str) -> DataFrame:
        """One row for each controlled method: path, code_name, name, target, control (whether the text that the
        extension was made from, its insertions left out, is the old release's), inserted and deleted lines, and state:
        missing (no target in the new release), conflicting, changed, or unchanged."""
        keys = ["path", "code_name", "name", "target"]
        hooks = cut(self._interceptions(extension_db, base_db, base_db_new).where("lower(how) = 'изменениеиконтроль' and found_0 is not null"))
        body = lambda db, key: hooks.select(*keys, F.col(key).alias("id")).join(self._t("method", db, None).select("id", "body"), "id").select(*keys, "body")
        inner = lambda df: F.slice(F.transform(F.sort_array(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]), 2, 1 << 30)  # noqa: E731  # without the header
        marked = A.marked_lines(A.lines_of(body(extension_db, "id"), keys, "body"), keys)
        of = lambda mark: F.count_if(F.col("mark") == mark)
        counts = marked.groupBy(*keys).agg(of("inserted").alias("inserted"), of("deleted").alias("deleted"))
        was = marked.where("mark <> 'inserted'").groupBy(*keys).agg(inner(marked).alias("was"))
        old = A.lines_of(body(base_db, "found_0"), keys, "body").groupBy(*keys).agg(inner(marked).alias("old"))
        regions = self.control_diff(extension_db, base_db, base_db_new).groupBy(*keys).agg(F.count_if(F.col("state") == "conflicting").alias("bad"), F.count_if(F.col("state").isin("changed", "missing", "same")).alias("new"))
        out = hooks.select(*keys, "found_1").join(counts, keys, "left").join(was, keys, "left").join(old, keys, "left").join(regions, keys, "left").fillna(0, ["inserted", "deleted", "bad", "new"])
        state = F.when(F.col("found_1").isNull(), "missing").when(F.col("bad") > 0, "conflicting").when(F.col("new") > 0, "changed").otherwise("unchanged")
        return out.select(*keys, F.coalesce(F.col("was") == F.col("old"), F.lit(False)).alias("control"), "inserted", "deleted", state.alias("state"))

    # bases and groups

    def db_list(self) -> DataFrame:
        return self.catalog.list()

    def db_open(self, path: str, alias: str | None = None) -> str:
        return self.catalog.open(path, alias)

    def db_use(self, alias: str) -> None:
        self.catalog.use(alias)

    def db_close(self, alias: str) -> None:
        self.catalog.close(alias)

    def group_create(self, name: str) -> None:
        self.catalog.group_create(name)

    def group_add_db(self, group: str, db: str) -> None:
        self.catalog.group_add(group, db)

    def group_remove_db(self, group: str, db: str) -> None:
        self.catalog.group_remove(group, db)

    def group_list(self) -> DataFrame:
        return self.catalog.group_list()

    def group_use(self, group: str) -> None:
        self.catalog.group_use(group)

    def group_close(self, group: str) -> None:
        self.catalog.group_close(group)
