"""The relational schema of a base. Types are Spark DDL; nullable unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the schema's revision.
REVISION = 8

#: The tables of a base and their columns.
TABLES = {
    "source": "id long, file string, created string, root_type string, root_name string, root_uuid string, file_size long, file_sha256 string, extractor_version string",
    "meta_object": "id long, source_id long, parent_id long, ord int, path string, type string, name string, uuid string, comment string, obj_version string, type_ru string, header_json string",
    "module": "id long, object_id long, code_name string, context string, body string",
    "method": "id long, module_id long, ord int, kind string, name string, signature string, is_export boolean, directives string, description string, line_start int, line_end int, body string",
    "skd_query": "id long, object_id long, ord int, query string",
    "xdto_import": "id long, object_id long, ord int, namespace string",
    "xdto_type": "id long, object_id long, ord int, name string, kind string, base string, base_ns string, facets string, enum_values string",
    "xdto_property": "id long, type_id long, object_id long, ord int, name string, type string, type_ns string, lower_bound int, upper_bound int, nillable int, form string, extra string, nested_type_id long",
    "meta_attribute": "id long, object_id long, ord int, name string, type_str string, tabular string, uuid string",
    "meta_tabular": "id long, object_id long, ord int, name string, uuid string",
    "meta_subobject": "id long, object_id long, kind string, ord int, uuid string, name string",
    "attribute_ref": "id long, attribute_id long, ord int, uuid string, object_id long",
    "enum_value": "id long, object_id long, ord int, name string",
    "predefined": "id long, object_id long, ord int, parent_ord int, uuid string, name string, code string, display string",
    "predefined_subconto": "id long, predefined_id long, ord int, uuid string, kind_id long, flags string",
    "common_target": "id long, common_id long, target_id long",
    "subsystem_content": "id long, subsystem_id long, target_id long, ord int",
    "file": "id long, source_id long, object_id long, path string, kind string, size long, data binary",
    "role_right": "id long, role_id long, target_uuid string, target_object_id long, target_attr_id long, target_tabular_id long, target_subobject_id long, sub_index int, collection_uuid string, target_flags string, right_uuid string, value string, rls_text string",
    "role_rls_template": "id long, role_id long, ord int, name string, text string",
    "role_rights_state": "role_id long, version string, parsed boolean, targets int, rights int, rls_templates int, error string",
    "query_violation": "object_id long, path string, line int, col int, line_end int, col_end int, message string",
}

#: Tables that are derived from the others when a base is written; a base can lack them.
DERIVED = {
    "call_site": "module_id long, digest string, object_id long, code_name string, method string, line int, form string, left string, name string, conditions array<string>",
    "call_edge": "kind string, src string, dst string, path string, code_name string, method string, line int, left string, name string, form string, conditions array<string>, module_id long",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])
