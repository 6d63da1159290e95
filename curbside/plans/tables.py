"""Domain tables made from the driver's tables (orders, lineitem, events, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Text of the same select in Spark SQL and DuckDB.
IMAGES = """SELECT o_orderkey AS image_id, o_orderpriority AS source_id, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS split,
  o_custkey AS group_id, o_orderkey AS ingest_seq FROM orders"""
INSTANCES = """SELECT l_orderkey AS image_id, l_linenumber AS det_idx, l_partkey AS p, l_suppkey AS s,
  CAST(l_partkey % 512 AS DOUBLE) AS x1, CAST(l_suppkey * 5 % 512 AS DOUBLE) AS y1,
  CAST(l_partkey % 512 AS DOUBLE) + 8 + l_quantity AS x2, CAST(l_suppkey * 5 % 512 AS DOUBLE) + 40 + l_partkey % 260 AS y2,
  8 + l_quantity AS w, CAST(40 + l_partkey % 260 AS DOUBLE) AS h, l_returnflag AS class_name, l_linestatus = 'F' AS ignore_flag,
  round(l_tax * 10, 1) AS occlusion, CAST(round(l_discount * 1000) AS INT) AS conf, l_linestatus AS side FROM lineitem"""
EVENTS = """SELECT event_id, user_id, event_type, value, event_id % 2 AS half, CAST(ts AS DATE) AS day, ts FROM events"""
REGISTRY = """SELECT o_orderpriority AS source_id, 'train' AS split, 'train' AS role FROM (SELECT DISTINCT o_orderpriority FROM orders) a
  UNION ALL SELECT o_orderpriority, 'val', 'eval' FROM (SELECT DISTINCT o_orderpriority FROM orders) b"""


def read(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the driver's tables."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "orders")
    return spark.sql(IMAGES)


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "lineitem")
    return spark.sql(INSTANCES)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "events")
    return spark.sql(EVENTS)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "orders")
    return spark.sql(REGISTRY)
