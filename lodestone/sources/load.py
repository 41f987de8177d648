"""From a dump (a folder of decoded files) to all tables of a base.

Every table is one plan over the files and the objects' headers; what joins them is the
object's folder. Identifiers are made of the owner's identifier and the position under it,
so that they need no numbering over the whole table and are the same for the same dump.

Edge cases: an empty folder gives empty tables; headers that are no JSON give an object
without derived rows; rights that cannot be read give a row in role_rights_state with the
error; predefined data that cannot be read give no rows (`predefined.unreadable` lists them).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.errors import DataError
from lodestone.functions.paths import RUSSIAN
from lodestone.operators import code as K
from lodestone.sources import dump, links, metadata, predefined, rights_file, xdto
from lodestone.sources.brace import to_text
from lodestone.sources.sinks import commit_base, write_base

#: Names of files in an object's folder.
PREDEFINED_FILE, RIGHTS_FILE = "Предустановленные данные.bin", "Role.0.c1brace"


def _under(owner: str, position: str):
    """An identifier from the owner's and a position below 2**20 under it."""
    return F.shiftleft(F.col(owner), 20) + F.col(position).cast("long")


def objects_of(files: DataFrame) -> DataFrame:
    """meta_object without its place among siblings, from the files of a dump."""
    folders = dump.objects(files).select("id", "parent_id", "path", "type", F.col("name").alias("folder"))
    heads = files.where("kind = 'json'").select("dir", F.regexp_extract("path", "([^/]+)$", 1).alias("file"), to_text(F.col("data")).alias("text"))
    own = folders.join(heads, (F.col("dir") == F.col("path")) & (F.col("file") == F.concat("type", F.lit(".json"))), "left")
    own = own.select(*folders.columns, F.col("text").alias("header_json"))
    ids = heads.where(F.col("file").endswith(".id.json")).select(F.col("dir").alias("path"), F.regexp_extract("file", r"^(.*)\.id\.json$", 1).alias("type"), F.get_json_object("text", "$.uuid").alias("own_uuid"))
    field = lambda name: F.get_json_object("header_json", f"$.{name}")
    russian = F.create_map(*(F.lit(x) for pair in RUSSIAN.items() for x in pair))
    return own.join(ids, ["path", "type"], "left").select(
        "id", F.lit(1).cast("long").alias("source_id"), "parent_id", "path", "type", F.coalesce(field("name"), "folder").alias("name"),
        F.coalesce("own_uuid", field("uuid")).alias("uuid"), field("comment").alias("comment"), field("obj_version").alias("obj_version"),
        F.coalesce(russian[F.col("type")], "type").alias("type_ru"), "header_json")


def references_of(objects: DataFrame, files: DataFrame) -> DataFrame:
    """uuid and name of the references that the root's configuration file lists."""
    root = objects.where("path = ''").select(F.concat("type", F.lit(".10.json")).alias("path"))
    texts = files.join(root, "path", "left_semi").select("path", to_text(F.col("data")).alias("text"))

    def rows(text):
        try:
            groups = metadata._at(json.loads(text), 0, 3) or []
        except ValueError:
            return []
        pairs = (p for g in groups if isinstance(g, list) for p in g[1:])
        return [(p[0], metadata.unquote(str(p[1]))) for p in pairs if isinstance(p, list) and len(p) > 1 and isinstance(p[0], str)]

    return K.expand(texts, ["path"], "text", "uuid string, name string", rows).select("uuid", "name")


def _code(objects: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """module and method."""
    found = dump.modules(files).where(F.col("path").endswith(".bsl"))
    own = found.join(objects.select("path", "type", F.col("id").alias("object_id")).withColumnRenamed("path", "dir"), "dir").where("stem = type")
    context = K.expand(objects.where("type = 'CommonModule'"), ["id"], "header_json", "context string", lambda t: [(metadata.module_context(metadata._json(t)),)])
    own = own.join(context.withColumnRenamed("id", "object_id"), "object_id", "left")
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("object_id").orderBy("code_name")) - 1).withColumn("id", _under("object_id", "n"))
    rest = K.residual(own, ["id", "object_id", "code_name", "context"], "body").withColumnRenamed("residual", "body")
    methods = K.methods(own.withColumnRenamed("id", "module_id").select("module_id", F.col("body").alias("text")), ["module_id"], "text")
    return rest, methods.withColumn("id", _under("module_id", "ord"))


def _packages(objects: DataFrame, binaries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """xdto_import, xdto_type and xdto_property."""
    texts = binaries.select("object_id", to_text(F.col("data")).alias("text")).where(F.ltrim("text").startswith("<package"))

    def of(rows):
        def run(text):
            package = xdto.parse(text.encode())
            return rows(package) if package else []
        return run

    imports = K.expand(texts, ["object_id"], "text", "ord int, namespace string", of(lambda p: list(enumerate(p.imports))))
    types = K.expand(texts, ["object_id"], "text", "no int, ord int, name string, kind string, base string, base_ns string, facets string, enum_values string", of(lambda p: xdto.flatten(p)[0]))
    props = K.expand(texts, ["object_id"], "text", "no int, type_no int, ord int, name string, type string, type_ns string, lower_bound int, upper_bound int, nillable boolean, form string, extra string, nested int", of(lambda p: xdto.flatten(p)[1]))
    return (imports.withColumn("id", _under("object_id", "ord")), types.withColumn("id", _under("object_id", "no")),
            props.withColumn("id", _under("object_id", "no")).withColumn("type_id", _under("object_id", "type_no")).withColumn("nested_type_id", _under("object_id", "nested")))


def _predefined(objects: DataFrame, binaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """predefined and predefined_subconto."""
    own = binaries.where(F.element_at(F.split("path", "/"), -1) == PREDEFINED_FILE).select("object_id", to_text(F.col("data")).alias("text"))
    own = own.join(objects.select(F.col("id").alias("object_id"), "header_json"), "object_id").select("object_id", F.to_json(F.struct("text", "header_json")).alias("both"))

    def items(both):
        found = json.loads(both)
        try:
            return predefined.items(found["text"], metadata._json(found.get("header_json")))
        except (DataError, IndexError, TypeError):
            return []

    rows = K.expand(own, ["object_id"], "both", "ord int, parent_ord int, uuid string, name string, code string, display string", lambda t: ((i.ord, i.parent, i.uuid, i.name, i.code, i.display) for i in items(t)))
    rows = rows.withColumn("id", _under("object_id", "ord"))
    kinds = K.expand(own, ["object_id"], "both", "item int, ord int, uuid string, flags string", lambda t: ((i.ord, n, u, f) for i in items(t) for n, (u, f) in enumerate(i.kinds)))
    by_uuid = rows.where("uuid is not null").groupBy("uuid").agg(F.max("id").alias("kind_id"))
    kinds = kinds.withColumn("predefined_id", _under("object_id", "item")).join(by_uuid, "uuid", "left")
    return rows, kinds.withColumn("id", _under("predefined_id", "ord"))


def _rights(objects: DataFrame, binaries: DataFrame, attributes: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """role_right, role_rls_template and role_rights_state."""
    roles = objects.where("type = 'Role'").select(F.col("id").alias("role_id"))
    own = binaries.where(F.element_at(F.split("path", "/"), -1) == RIGHTS_FILE).select(F.col("object_id").alias("role_id"), "data").join(roles, "role_id")
    read = rights_file.read_rights(own, "role_id", "data")
    ends = objects.select(F.col("uuid").alias("target_uuid"), F.lit(0).alias("rank"), F.col("id").alias("o"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("t"))
    ends = ends.unionByName(attributes.select(F.col("uuid").alias("target_uuid"), F.lit(1).alias("rank"), F.col("object_id").alias("o"), F.col("id").alias("a"), F.lit(None).cast("long").alias("t")))
    ends = ends.unionByName(sections.select(F.col("uuid").alias("target_uuid"), F.lit(2).alias("rank"), F.col("object_id").alias("o"), F.lit(None).cast("long").alias("a"), F.col("id").alias("t")))
    best = ends.where("target_uuid is not null").groupBy("target_uuid").agg(F.max(F.struct("rank", "o", "a", "t")).alias("end"))
    rights = read.where("right_uuid is not null").join(best, "target_uuid", "left").select(
        "role_id", "target_uuid", F.col("end.o").alias("target_object_id"), F.col("end.a").alias("target_attr_id"), F.col("end.t").alias("target_tabular_id"),
        "sub_index", "collection_uuid", "target_flags", "right_uuid", "value", "rls_text", F.xxhash64("role_id", "target_ord", "right_uuid", "value", "rls_text").alias("id"))

    def templates(text):
        try:
            return [(n, name, body) for n, (name, body) in enumerate(rights_file.parse(text).templates)]
        except (DataError, TypeError):
            return []

    texts = K.expand(own.select("role_id", to_text(F.col("data")).alias("text")), ["role_id"], "text", "ord int, name string, text string", templates)
    states = roles.join(read.where("state is not null").select("role_id", "state.*"), "role_id", "left").select(
        "role_id", "version", F.coalesce("parsed", F.lit(False)).alias("parsed"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("targets", "rights", "rls_templates")),
        F.when(F.col("parsed").isNull(), "no file of rights").otherwise(F.col("error")).alias("error"))
    return rights, texts.withColumn("id", _under("role_id", "ord")), states


def load_dump(spark: SparkSession, path: str, keep_binary: bool = False) -> dict[str, DataFrame]:
    """All tables of a base, as plans over the dump in folder ``path``."""
    files = dump.file_map(spark, path, with_binary=True)
    objects = objects_of(files)
    order = links.sibling_order(objects.select("id", "parent_id", "uuid", "header_json"))
    meta = objects.join(order, "id", "left")
    derived = metadata.derive_joined(objects, references_of(objects, files)).join(objects.select(F.col("id").alias("object_id"), F.col("type").alias("owner_type")), "object_id")
    attributes = derived.where("part = 'attribute'").withColumn("id", _under("object_id", "ord"))
    sections = derived.where("part = 'section'").withColumn("id", _under("object_id", "ord"))
    refs = attributes.select(F.col("id").alias("attribute_id"), F.posexplode("links").alias("ord", "link")).select("attribute_id", "ord", "link.uuid", "link.path")
    refs = refs.join(objects.select("path", F.col("id").alias("object_id")), "path", "left").withColumn("id", _under("attribute_id", "ord"))
    owned = files.join(objects.select(F.col("path").alias("dir"), F.col("id").alias("object_id"), "type"), "dir", "left")
    binaries = owned.where("object_id is not null")
    module, method = _code(objects, files)
    imports, types, props = _packages(objects, binaries.where("kind = 'bin'"))
    items, kinds = _predefined(objects, binaries)
    rights, templates, states = _rights(objects, binaries, attributes, sections)
    queries = dump.report_queries(files).join(objects.select(F.col("path").alias("dir"), F.col("id").alias("object_id")), "dir")
    queries = queries.withColumn("ord", (F.row_number().over(Window.partitionBy("object_id").orderBy("ord", "query")) - 1).cast("int")).withColumn("id", _under("object_id", "ord"))
    members = links.subsystem_content(objects)
    name = F.element_at(F.split("path", "/"), -1)
    other = owned.where(F.col("type").isNull() | (name != F.concat("type", F.lit(".json"))) & (name != F.concat("type", F.lit(".id.json"))))
    is_code = F.col("type").isNotNull() & (F.col("kind") == "bsl")
    data = F.when(~is_code & (F.lit(keep_binary) | F.col("kind").isin(*dump.TEXT_KINDS)), F.col("data"))
    root = objects.where("path = ''").select(F.col("source_id").alias("id"), F.lit(path).alias("file"), F.col("type").alias("root_type"), F.col("name").alias("root_name"), F.col("uuid").alias("root_uuid"))
    return {
        "source": root, "meta_object": meta, "meta_attribute": attributes, "meta_tabular": sections, "attribute_ref": refs, "enum_value": derived.where("part = 'value' AND owner_type = 'Enum'").withColumn("id", _under("object_id", "ord")),
        "module": module, "method": method, "skd_query": queries, "xdto_import": imports, "xdto_type": types, "xdto_property": props, "predefined": items, "predefined_subconto": kinds,
        "common_target": links.common_targets(objects).withColumn("id", F.xxhash64("common_id", "target_id")), "subsystem_content": members.withColumn("id", _under("subsystem_id", "ord")),
        "role_right": rights, "role_rls_template": templates, "role_rights_state": states,
        "file": other.select(F.xxhash64("path").alias("id"), F.lit(1).cast("long").alias("source_id"), "object_id", "path", F.when(F.col("kind") == "", "bin").otherwise(F.col("kind")).alias("kind"), "size", data.alias("data")),
    }


def import_dump(spark: SparkSession, path: str, base_path: str, keep_binary: bool = False, versioned: bool = False) -> None:
    """The dump in folder ``path`` as a base at ``base_path``: in place of what is there, or as its latest version."""
    (commit_base if versioned else write_base)(spark, load_dump(spark, path, keep_binary), base_path)
