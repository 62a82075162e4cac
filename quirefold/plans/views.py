"""Views that put the driver's tables into the engine's shapes. The SQL runs alike in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

TYPES = "CASE l_partkey % 5 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'table' WHEN 2 THEN 'figure' WHEN 3 THEN 'stamp' ELSE 'signature' END"
RANK = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)"
OBJECTS = f"""
SELECT l_orderkey AS doc_id, 1 + l_suppkey % 3 AS page, {TYPES} AS type,
  {RANK} AS ordinal,
  CAST(l_partkey % 500 AS DOUBLE) AS x1, CAST(l_suppkey * 7 % 700 AS DOUBLE) AS y1,
  CAST(l_partkey % 500 + 40 + 9 * l_quantity AS DOUBLE) AS x2, CAST(l_suppkey * 7 % 700 + 30 + 20 * l_linenumber AS DOUBLE) AS y2,
  0.5 + 5 * l_discount AS confidence
FROM lineitem"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected objects made of order lines.

    Lines are ranked before anything is made of them: only their own columns are shuffled, and Spark knows objects to be dealt by
    doc_id, so what groups them by document or page needs no further shuffle.
    """
    ranked = spark.sql(f"SELECT *, {RANK} AS _rank FROM {{li}}", li=table(spark, sf_dir, "lineitem"))
    return spark.sql(OBJECTS.replace(RANK, "_rank").replace("FROM lineitem", "FROM {li}"), li=ranked)


LINES_SQL = """
SELECT doc_id, line_no, t AS text, length(t) AS n FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of documents, numbered from 0."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).withColumn("n", F.length("text"))
