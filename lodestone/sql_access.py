"""Read-only SQL for users: queries only, dotted names in literals, capped rows."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator

from py4j.java_gateway import is_instance_of

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import BadRequest
from lodestone.functions.paths import slash_path

MOST_ROWS, MOST_CHARS = 200, 120
#: Functions that queries may use beside Spark's own, as SQL: nothing leaves the JVM.
FUNCTIONS = {"lower_ru": "(x STRING) RETURNS STRING RETURN lower(x)",
             "body_has": "(body STRING, needle STRING) RETURNS BOOLEAN RETURN coalesce(contains(lower(body), lower(needle)), false)"}
#: Functions that return tables, over the views of the base that is asked.
TABLE_FUNCTIONS = {
    "subtree": """(p STRING, depth INT) RETURNS TABLE(level INT, id BIGINT, path STRING, type STRING, name STRING)
        RETURN SELECT (size(split(path, '/')) - size(split(p, '/'))) DIV 2 AS level, id, path, type, name FROM meta_object
        WHERE (lower(path) = lower(p) OR startswith(lower(path), lower(p) || '/')) AND (size(split(path, '/')) - size(split(p, '/'))) DIV 2 <= depth""",
    "refs_of": """(p STRING) RETURNS TABLE(direction STRING, path STRING, field STRING)
        RETURN SELECT DISTINCT d.direction, other.path, a.name AS field
        FROM attribute_ref r JOIN meta_attribute a ON a.id = r.attribute_id CROSS JOIN (VALUES ('out'), ('in')) d(direction)
        JOIN meta_object own ON own.id = CASE d.direction WHEN 'out' THEN a.object_id ELSE r.object_id END
        JOIN meta_object other ON other.id = CASE d.direction WHEN 'out' THEN r.object_id ELSE a.object_id END
        WHERE lower(own.path) = lower(p)""",
    "effective": """(roles ARRAY<STRING>) RETURNS TABLE(target_uuid STRING, target_object_id BIGINT, sub_index INT, collection_uuid STRING, right_uuid STRING, value STRING, granted_by ARRAY<STRING>)
        RETURN SELECT target_uuid, target_object_id, sub_index, collection_uuid, right_uuid, value, sort_array(collect_set(o.name)) AS granted_by
        FROM role_right r JOIN meta_object o ON o.id = r.role_id WHERE o.type = 'Role' AND exists(roles, x -> lower(x) = lower(o.name))
        GROUP BY target_uuid, target_object_id, target_attr_id, target_tabular_id, sub_index, collection_uuid, right_uuid, value""",
}
_LITERAL = re.compile(r"'((?:[^']|'')*)'")


def rewrite_paths(sql: str) -> str:
    """Dotted Russian names inside string literals become slash paths."""
    return _LITERAL.sub(lambda m: "'" + slash_path(m[1]) + "'", sql)


def _nodes(plan):
    """The nodes of a parsed plan."""
    left = [plan]
    while left:
        node = left.pop()
        yield node
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]


def _acts(spark: SparkSession, node) -> bool:
    """Whether a plan's node does something else than to answer a query, by its class."""
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    return any(is_instance_of(spark.sparkContext._gateway, node, logical + c) for c in ("Command", "ParsedStatement", "CompoundPlanStatement"))


def register_functions(spark: SparkSession) -> None:
    """FUNCTIONS for this session; the user's functions of these names stay."""
    for name, what in FUNCTIONS.items():
        if not spark.catalog.functionExists(name):
            spark.sql(f"CREATE TEMPORARY FUNCTION {name}{what}")


@contextlib.contextmanager
def table_functions(spark: SparkSession) -> Iterator[None]:
    """TABLE_FUNCTIONS, as far as the tables that they read are there; they go when the block ends, the user's functions of these names stay."""
    made = []
    for name, what in TABLE_FUNCTIONS.items():
        if not spark.catalog.functionExists(name):
            try:
                spark.sql(f"CREATE TEMPORARY FUNCTION {name}{what}")
                made.append(name)
            except AnalysisException:
                continue
    try:
        yield
    finally:
        for name in made:
            spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")


def run_sql(spark: SparkSession, sql: str, limit: int = MOST_ROWS) -> DataFrame:
    """The result of a query, at most ``limit`` rows. What the plan does decides, not the text:
    commands (anything that writes or sets) are refused before they run."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise BadRequest(str(e).splitlines()[0]) from e
    if any(_acts(spark, node) for node in _nodes(plan)):
        raise BadRequest("only queries are allowed")
    register_functions(spark)
    return spark.sql(sql).limit(limit)


def short_cells(df: DataFrame, width: int = MOST_CHARS) -> DataFrame:
    """All cells as text of at most ``width`` characters, for display."""
    return df.select(*(F.when(F.length(F.col(c).cast("string")) > width, F.concat(F.left(F.col(c).cast("string"), F.lit(width - 1)), F.lit("…"))).otherwise(F.col(c).cast("string")).alias(c) for c in df.columns))
