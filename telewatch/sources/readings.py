"""Raw readings re-aimed onto the driver tables.

The reference polls counters, process lists, sensors and SMART reports from
the OS.  These builders derive tables of the same shape from the driver data
so the derivation operators run over data that grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import risk as R
from ..operators.ordered import materialize, ordered_scan
from .tables import read_table, telemetry

# Bytes per unit of event value for the synthetic counters.
BYTES_PER_CENT = 10486
# Event type -> sensor name for the re-aimed sensor table.
SENSOR_OF_EVENT = {"view": "coretemp", "signup": "cpu_thermal", "purchase": "hwmon",
                   "error": "k10temp", "click": "acpitz"}
# Unit of the written volume by part key modulo 4.
UNITS = ["TB", "GB", "PB", "MB"]


COUNTER_COLUMNS = ["read_bytes", "write_bytes", "bytes_sent", "bytes_recv"]
# Process ids are bounded (Linux: below 2**22); row ids stay bigint.
PID_LIMIT = 1 << 22


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monotone byte counters per host: running sums of event values."""
    t = telemetry(spark, sf_dir)
    inc_w = F.round(F.col("value") * 100.0).cast("long") * F.lit(BYTES_PER_CENT)
    inc_s = F.col("memory_percent").cast("long") * F.lit(1048576)
    inc_r = F.round(F.col("value") * 10.0).cast("long") * F.lit(BYTES_PER_CENT)
    s = ordered_scan(t.select(F.col("system_id").alias("hostname"), "ts", "id", "value",
                              "memory_percent"),
                     ["hostname"], ["ts", "id"],
                     running_sums={"read_bytes": inc_r, "write_bytes": inc_w, "bytes_sent": inc_s,
                                   "bytes_recv": inc_s + inc_r})
    return materialize(s.select("hostname", "ts", "id", *COUNTER_COLUMNS))


COUNTERS_CTE = """counters AS (
  SELECT system_id AS hostname, ts, id,
         sum(CAST(round(value * 10.0) AS BIGINT) * 10486)
           OVER (PARTITION BY system_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS read_bytes,
         sum(CAST(memory_percent AS BIGINT) * 1048576 + CAST(round(value * 10.0) AS BIGINT) * 10486)
           OVER (PARTITION BY system_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS bytes_recv,
         sum(CAST(round(value * 100.0) AS BIGINT) * 10486)
           OVER (PARTITION BY system_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS write_bytes,
         sum(CAST(memory_percent AS BIGINT) * 1048576)
           OVER (PARTITION BY system_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS bytes_sent
  FROM telemetry)"""


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process list per daily snapshot: each event is one process."""
    t = telemetry(spark, sf_dir)
    return t.select(F.col("system_id").alias("hostname"),
                    F.date_trunc("day", "ts").alias("ts"),
                    (F.col("id") % PID_LIMIT).cast("int").alias("pid"),
                    F.col("process_name").alias("name"),
                    F.col("value").alias("cpu_percent"),
                    F.col("memory_percent"))


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sensor readings per host as a name -> max reading map."""
    t = telemetry(spark, sf_dir)
    mapping = F.create_map(*[F.lit(x) for kv in SENSOR_OF_EVENT.items() for x in kv])
    per = (t.select(F.col("system_id").alias("hostname"), F.date_trunc("day", "ts").alias("ts"),
                    mapping[F.col("process_name")].alias("sensor"), "value")
           .groupBy("hostname", "ts", "sensor").agg(F.max("value").alias("reading")))
    return per.groupBy("hostname", "ts").agg(
        F.map_from_entries(F.collect_list(F.struct("sensor", "reading"))).alias("temps"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry cut into weekly collection sessions, with the load state."""
    t = telemetry(spark, sf_dir).withColumn("risk_score", R.risk_score())
    sid = F.concat(F.col("system_id"), F.lit("@"),
                   F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd"))
    return t.withColumn("session_id", sid).withColumn("load_state", R.state_label())


SESSIONS_CTE = """sessions AS (
  SELECT *, system_id || '@' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS session_id,
         CASE WHEN risk_score >= 0.7 THEN 'High' WHEN risk_score >= 0.4 THEN 'Moderate'
              ELSE 'Normal' END AS load_state
  FROM (SELECT *, (cpu_percent * 0.4 + memory_percent * 0.6) / 100.0 AS risk_score
        FROM telemetry) x)"""


def smart_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One SMART report text per part, composed from its columns."""
    p = read_table(spark, sf_dir, "part")
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]),
                        (F.pmod(F.col("p_partkey"), F.lit(4)) + 1).cast("int"))
    health = F.when(F.pmod(F.col("p_size"), F.lit(7)) == 0, "FAILED").otherwise("PASSED")
    report = F.concat(
        F.lit("Model Number:   "), F.col("p_brand"), F.lit(" "), F.col("p_type"), F.lit("\n"),
        F.lit("SMART overall-health self-assessment test result: "), health, F.lit("\n"),
        F.lit("Percentage Used:   "), F.pmod(F.col("p_size"), F.lit(100)).cast("string"),
        F.lit("%\n"),
        F.lit("Available Spare:   "), (F.lit(100) - F.pmod(F.col("p_size"), F.lit(100)))
        .cast("string"), F.lit("%\n"),
        F.lit("Temperature:   "), (F.lit(30) + F.pmod(F.col("p_size"), F.lit(40))).cast("string"),
        F.lit(" Celsius\n"),
        F.lit("Data Units Written:   "), F.format_number(F.col("p_partkey") * 1000, 0),
        F.lit(" ["), F.col("p_retailprice").cast("string"), F.lit(" "), unit, F.lit("]\n"),
        F.lit("Power On Hours:   "), F.format_number(F.col("p_partkey") * 7, 0), F.lit("\n"),
        F.when(F.pmod(F.col("p_partkey"), F.lit(5)) != 0,
               F.concat(F.lit("Media and Data Integrity Errors:   "),
                        F.pmod(F.col("p_size"), F.lit(3)).cast("string"), F.lit("\n")))
        .otherwise(F.lit("")),
    )
    return p.select(F.col("p_partkey").alias("part_id"), report.alias("report"))


# Label order of the labelled folders (normal, moderate, high).
LABEL_RANK = {"Normal": 1, "Moderate": 2, "High": 3}


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 model features per telemetry row, labelled by its risk band.

    Features the driver data lacks are derived from the event value and
    memory percent (fixed affine maps).
    """
    t = telemetry(spark, sf_dir).withColumn("risk_score", R.risk_score())
    return t.select(
        "system_id", "id", "ts",
        F.col("cpu_percent"),
        (F.lit(2000.0) + F.col("value") * 2.0).alias("cpu_frequency_mhz"),
        F.col("memory_percent"),
        F.col("memory_available_mb"),
        (F.lit(40.0) + F.col("memory_percent") / 4.0).alias("disk_percent"),
        (F.col("disk_write_mbps") / 2.0).alias("disk_read_mbps"),
        F.col("disk_write_mbps"),
        (F.col("value") / 100.0).alias("network_upload_mbps"),
        (F.col("value") / 50.0).alias("network_download_mbps"),
        F.col("process_count"),
        R.state_label().alias("label"),
    )


TRAINING_CTE = """training AS (
  SELECT system_id, id, ts, cpu_percent, 2000.0 + value * 2.0 AS cpu_frequency_mhz,
         memory_percent, memory_available_mb, 40.0 + memory_percent / 4.0 AS disk_percent,
         disk_write_mbps / 2.0 AS disk_read_mbps, disk_write_mbps,
         value / 100.0 AS network_upload_mbps, value / 50.0 AS network_download_mbps,
         process_count,
         CASE WHEN (cpu_percent * 0.4 + memory_percent * 0.6) / 100.0 >= 0.7 THEN 'High'
              WHEN (cpu_percent * 0.4 + memory_percent * 0.6) / 100.0 >= 0.4 THEN 'Moderate'
              ELSE 'Normal' END AS label
  FROM telemetry)"""


def with_process_ids(training: DataFrame) -> DataFrame:
    """D5 over the labelled rows in folder order (label rank, then time, id)."""
    from ..operators.prep import assign_ids
    rank = F.create_map(*[F.lit(x) for kv in LABEL_RANK.items() for x in kv])[F.col("label")]
    tagged = training.withColumn("_lr", rank.cast("long"))
    return materialize(assign_ids(tagged, ["_lr", "ts", "id"]).drop("_lr"))


IDS_CTE = """ided AS (
  SELECT *, row_number() OVER (ORDER BY CASE label WHEN 'Normal' THEN 1 WHEN 'Moderate' THEN 2
                                          ELSE 3 END, ts, id) AS process_id
  FROM training)"""
