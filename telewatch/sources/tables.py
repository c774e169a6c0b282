"""Driver tables and the telemetry view derived from them.

The driver ships TPC-H-like parquet tables.  The telemetry queries run over a
view of ``events`` (one row per host per tick); every column below is a plain
projection, so Catalyst prunes the scan to the columns a query touches and
pushes filters into the parquet reader.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# Available-memory scale (MiB per memory percent point) used to
# derive memory_available_mb from memory_percent on the driver data.
MB_PER_PERCENT = 163.84


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def memory_percent_expr(props: Column) -> Column:
    return F.get_json_object(props, "$.k").try_cast("double")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> telemetry rows: system_id, id, ts and the measures."""
    ev = read_table(spark, sf_dir, "events")
    mem = memory_percent_expr(F.col("props"))
    return ev.select(
        F.concat(F.lit("SYSTEM-"), F.col("user_id").cast("string")).alias("system_id"),
        F.col("event_id").alias("id"),
        F.col("ts"),
        F.least(F.col("value"), F.lit(100.0)).alias("cpu_percent"),
        mem.alias("memory_percent"),
        ((F.lit(100.0) - mem) * F.lit(MB_PER_PERCENT)).alias("memory_available_mb"),
        (F.col("value") / F.lit(10.0)).alias("disk_write_mbps"),
        F.col("event_type").alias("process_name"),
        F.floor(F.col("value")).cast("int").alias("process_count"),
        F.col("value"),
    )


# DuckDB twin of ``telemetry``; every oracle query starts with this CTE.
TELEMETRY_CTE = """telemetry AS (
  SELECT 'SYSTEM-' || CAST(user_id AS VARCHAR) AS system_id,
         event_id AS id,
         ts,
         least(value, 100.0) AS cpu_percent,
         TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS memory_percent,
         (100.0 - TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) * 163.84 AS memory_available_mb,
         value / 10.0 AS disk_write_mbps,
         event_type AS process_name,
         CAST(floor(value) AS INTEGER) AS process_count,
         value
  FROM events)"""
