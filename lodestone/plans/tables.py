"""The driver tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rights(spark: SparkSession, d: str) -> DataFrame:
    """events as rights: role (user), target (event type), right (k of props), value and RLS text."""
    k = F.get_json_object("props", "$.k").cast("long")
    return t(spark, d, "events").select(
        "event_id", F.col("user_id").alias("role"), F.col("event_type").alias("target"), (k % 10).alias("right_no"),
        F.when(k % 7 == 0, None).otherwise(k % 3).alias("sub_index"), F.when(k % 2 == 0, "0/0").otherwise("1/1").alias("flags"),
        F.when(F.col("value") > 40, 1).otherwise(-1).alias("value"), F.when(k % 5 == 0, F.repeat(F.concat(F.lit("  WHERE  user = "), F.col("user_id").cast("string")), (k / 2 + 1).cast("int"))).alias("rls"))


#: The same view in SQL; queries put it in front.
RIGHTS_SQL = """
rights AS (
  SELECT event_id, user_id AS role, event_type AS target, k % 10 AS right_no, CASE WHEN k % 7 = 0 THEN NULL ELSE k % 3 END AS sub_index,
         CASE WHEN k % 2 = 0 THEN '0/0' ELSE '1/1' END AS flags, CASE WHEN value > 40 THEN 1 ELSE -1 END AS value,
         CASE WHEN k % 5 = 0 THEN repeat('  WHERE  user = ' || user_id::VARCHAR, (k // 2 + 1)::INTEGER) END AS rls
  FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events))"""


def tree(spark: SparkSession, d: str) -> DataFrame:
    """region -> nation -> customer as one tree: id, parent_id, ord, name, type."""
    r = t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("name"), F.lit("Region").alias("type"))
    n = t(spark, d, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent_id"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("name"), F.lit("Nation").alias("type"))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "CustomerForm").when(F.col("c_mktsegment") == "MACHINERY", "CustomerCommand").when(F.col("c_mktsegment") == "FURNITURE", "CustomerTemplate").otherwise("Customer")
    c = t(spark, d, "customer").select((F.col("c_custkey") + 10000).alias("id"), (F.col("c_nationkey") + 1000).cast("long").alias("parent_id"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey")).alias("ord"), F.col("c_name").alias("name"), kind.alias("type"))
    return r.unionByName(n).unionByName(c)


TREE_SQL = """
tree AS (
  SELECT r_regionkey::BIGINT AS id, NULL::BIGINT AS parent_id, r_regionkey::BIGINT AS ord, r_name AS name, 'Region' AS type FROM region
  UNION ALL SELECT n_nationkey + 1000, n_regionkey, n_nationkey, n_name, 'Nation' FROM nation
  UNION ALL SELECT c_custkey + 10000, c_nationkey + 1000, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey END, c_name,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'CustomerForm' WHEN 'MACHINERY' THEN 'CustomerCommand' WHEN 'FURNITURE' THEN 'CustomerTemplate' ELSE 'Customer' END FROM customer)"""
