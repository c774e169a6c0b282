"""Registered derivation queries (C1-C17, C11-C12 text parsing)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.smart import smart_fields
from ..operators import derive as D
from ..sources import readings as RD
from ..sources.tables import TELEMETRY_CTE, read_table, telemetry
from .catalog import _with, rnd
from .registry import register


def counter_rates(spark, sf_dir):
    return D.counter_rates(RD.counters(spark, sf_dir), RD.COUNTER_COLUMNS).select(
        "hostname", "id", "elapsed_s", *[f"{c}_mbps" for c in RD.COUNTER_COLUMNS])


def _rate_sql(c: str) -> str:
    expr = (f"({c} - lag({c}) OVER w) / 1048576.0 / "
            "((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0)")
    ok = ("lag(ts) OVER w IS NOT NULL AND "
          "(epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0 > 0.001")
    return f"CASE WHEN {ok} THEN {rnd(expr, 2)} ELSE 0.0 END"


RATES_SQL = _with(TELEMETRY_CTE, RD.COUNTERS_CTE) + f"""
SELECT hostname, id,
       coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0, 0.0) AS elapsed_s,
       {", ".join(f"{_rate_sql(c)} AS {c}_mbps" for c in RD.COUNTER_COLUMNS)}
FROM counters
WINDOW w AS (PARTITION BY hostname ORDER BY ts, id)"""

register("c1_counter_rates", "C1 C4", RATES_SQL)(counter_rates)


def counter_deltas(spark, sf_dir):
    return D.counter_deltas(RD.counters(spark, sf_dir), ["write_bytes"]).select(
        "hostname", "id", "write_bytes_delta_mb")


DELTAS_SQL = _with(TELEMETRY_CTE, RD.COUNTERS_CTE) + f"""
SELECT hostname, id,
       coalesce({rnd("(write_bytes - lag(write_bytes) OVER w) / 1048576.0", 2)}, 0.0)
         AS write_bytes_delta_mb
FROM counters
WINDOW w AS (PARTITION BY hostname ORDER BY ts, id)"""

register("c2_counter_deltas", "C2", DELTAS_SQL)(counter_deltas)


def paired_rates(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    start = F.col("id") * F.lit(1024)
    moved = F.round(F.col("value") * 100.0).cast("long") * F.lit(RD.BYTES_PER_CENT)
    sent = F.col("memory_percent").cast("long") * F.lit(1048576)
    return t.select("system_id", "id",
                    D.paired_rate(start, start + moved).alias("disk_write_mbps"),
                    D.paired_rate(start, start + sent).alias("network_upload_mbps"),
                    D.to_mib(F.col("memory_available_mb") * 1048576.0).alias("memory_available_mib"))


PAIRED_SQL = _with(TELEMETRY_CTE) + f"""
SELECT system_id, id,
       {rnd("(CAST(round(value * 100.0) AS BIGINT) * 10486) / 1048576.0 / 0.1", 2)}
         AS disk_write_mbps,
       {rnd("(CAST(memory_percent AS BIGINT) * 1048576) / 1048576.0 / 0.1", 2)} AS network_upload_mbps,
       {rnd("memory_available_mb * 1048576.0 / 1048576.0", 2)} AS memory_available_mib
FROM telemetry"""

register("c3_paired_rates", "C3 C4", PAIRED_SQL)(paired_rates)


def top_processes(spark, sf_dir):
    return D.top_processes(RD.processes(spark, sf_dir))


TOP_SQL = _with(TELEMETRY_CTE, """p AS (
  SELECT system_id AS hostname, date_trunc('day', ts) AS ts, CAST(id % 4194304 AS INTEGER) AS pid,
         process_name AS name, value AS cpu_percent, memory_percent
  FROM telemetry)""", """c AS (
  SELECT hostname, ts, coalesce(name, 'unknown') AS top_cpu_process, pid AS top_cpu_pid
  FROM p QUALIFY row_number() OVER (PARTITION BY hostname, ts
                                    ORDER BY coalesce(cpu_percent, 0.0) DESC, pid) = 1)""",
                """m AS (
  SELECT hostname, ts, coalesce(name, 'unknown') AS top_mem_process, pid AS top_mem_pid
  FROM p QUALIFY row_number() OVER (PARTITION BY hostname, ts
                                    ORDER BY coalesce(memory_percent, 0.0) DESC, pid) = 1)""",
                """n AS (SELECT hostname, ts, CAST(count(*) AS INTEGER) AS process_count
  FROM p GROUP BY hostname, ts)""") + """
SELECT n.hostname, n.ts, top_cpu_process, top_cpu_pid, top_mem_process, top_mem_pid, process_count
FROM n JOIN c USING (hostname, ts) JOIN m USING (hostname, ts)"""

register("c5_top_processes", "C5 C6", TOP_SQL)(top_processes)


def core_means(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", D.per_core_mean(F.col("embedding")).alias("cpu_per_core_avg"))


CORE_SQL = """
SELECT vec_id,
       CASE WHEN embedding IS NULL OR len(embedding) = 0 THEN 0.0
            ELSE list_reduce(list_prepend(0.0::DOUBLE,
                   list_transform(embedding, lambda x: CAST(x AS DOUBLE))), lambda a, b: a + b)
                 / len(embedding) END AS cpu_per_core_avg
FROM embeddings"""

register("c7_per_core_mean", "C7", CORE_SQL)(core_means)


def cpu_temperature(spark, sf_dir):
    s = RD.sensors(spark, sf_dir)
    return s.select("hostname", "ts", D.first_sensor(F.col("temps")).alias("cpu_temp_celsius"))


_SENSOR_CASE = "CASE " + " ".join(
    f"WHEN process_name = '{k}' THEN '{v}'" for k, v in RD.SENSOR_OF_EVENT.items()) + " END"
TEMP_SQL = _with(TELEMETRY_CTE, f"""s AS (
  SELECT system_id AS hostname, date_trunc('day', ts) AS ts, {_SENSOR_CASE} AS sensor, value
  FROM telemetry)""", """g AS (
  SELECT hostname, ts, """ + ",\n".join(
    f"max(CASE WHEN sensor = '{n}' THEN value END) AS s{i}"
    for i, n in enumerate(D.SENSOR_PRIORITY)) + """
  FROM s GROUP BY hostname, ts)""") + f"""
SELECT hostname, ts,
       CASE WHEN coalesce(s0, s1, s2, s3, s4, 0.0) = 0 THEN 0.0
            ELSE {rnd("coalesce(s0, s1, s2, s3, s4, 0.0)", 2)} END AS cpu_temp_celsius
FROM g"""

register("c8_cpu_temperature", "C8", TEMP_SQL)(cpu_temperature)


def session_clock(spark, sf_dir):
    booted = RD.sessions(spark, sf_dir).withColumn("boot_ts", F.date_trunc("month", "ts").cast("timestamp_ntz"))
    s = D.sample_numbers(D.session_clock(booted, boot_ts="boot_ts"))
    return s.select("session_id", "id", "elapsed_seconds", "elapsed_minutes",
                    "timestamp_seconds", "system_uptime_seconds", "sample_number")


CLOCK_SQL = _with(TELEMETRY_CTE, RD.SESSIONS_CTE) + f"""
SELECT session_id, id,
       (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY session_id))) / 1000000.0
         AS elapsed_seconds,
       {rnd("(epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY session_id)))"
            " / 1000000.0 / 60.0", 1)} AS elapsed_minutes,
       epoch_us(ts) / 1000000.0 AS timestamp_seconds,
       {rnd("(epoch_us(ts) - epoch_us(date_trunc('month', ts))) / 1000000.0", 0)} AS system_uptime_seconds,
       row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS sample_number
FROM sessions"""

register("c9_session_clock", "C9 C10", CLOCK_SQL)(session_clock)


def smart_parse(spark, sf_dir):
    r = RD.smart_reports(spark, sf_dir)
    return r.select("part_id", *smart_fields(F.col("report")))


def _smart_report_sql() -> str:
    units = "[" + ", ".join(f"'{u}'" for u in RD.UNITS) + "]"
    return f"""reports AS (
  SELECT p_partkey AS part_id,
    'Model Number:   ' || p_brand || ' ' || p_type || chr(10) ||
    'SMART overall-health self-assessment test result: ' ||
      CASE WHEN p_size % 7 = 0 THEN 'FAILED' ELSE 'PASSED' END || chr(10) ||
    'Percentage Used:   ' || CAST(p_size % 100 AS VARCHAR) || '%' || chr(10) ||
    'Available Spare:   ' || CAST(100 - p_size % 100 AS VARCHAR) || '%' || chr(10) ||
    'Temperature:   ' || CAST(30 + p_size % 40 AS VARCHAR) || ' Celsius' || chr(10) ||
    'Data Units Written:   ' || format('{{:,}}', p_partkey * 1000) || ' [' ||
      CAST(p_retailprice AS VARCHAR) || ' ' || {units}[p_partkey % 4 + 1] || ']' || chr(10) ||
    'Power On Hours:   ' || format('{{:,}}', p_partkey * 7) || chr(10) ||
    CASE WHEN p_partkey % 5 <> 0 THEN 'Media and Data Integrity Errors:   ' ||
      CAST(p_size % 3 AS VARCHAR) || chr(10) ELSE '' END AS report
  FROM part)"""


def _x(pat: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(report, '{pat}', {group}), '')"


def _xi(pat: str) -> str:
    return f"TRY_CAST(replace({_x(pat)}, ',', '') AS INTEGER)"


SMART_SQL = _with(_smart_report_sql()) + f"""
SELECT part_id,
       trim({_x(r'Model Number:\s+(.+)')}) AS ssd_model,
       {_x(r'SMART overall-health self-assessment test result:\s+(\w+)')} AS ssd_health_status,
       {_xi(r'Percentage Used:\s+(\d+)%')} AS ssd_percentage_used,
       {_xi(r'Available Spare:\s+(\d+)%')} AS ssd_available_spare,
       {_xi(r'Temperature:\s+(\d+) Celsius')} AS ssd_temperature,
       CASE {_x(r'Data Units Written:\s+[\[\(]?[\d,]+\s*[\]\)]?\s+\[([\d.]+)\s+(\w+)\]', 2)}
         WHEN 'TB' THEN TRY_CAST({_x(r'Data Units Written:\s+[\[\(]?[\d,]+\s*[\]\)]?\s+\[([\d.]+)\s+(\w+)\]')} AS DOUBLE)
         WHEN 'GB' THEN TRY_CAST({_x(r'Data Units Written:\s+[\[\(]?[\d,]+\s*[\]\)]?\s+\[([\d.]+)\s+(\w+)\]')} AS DOUBLE) * (1.0 / 1024.0)
         WHEN 'PB' THEN TRY_CAST({_x(r'Data Units Written:\s+[\[\(]?[\d,]+\s*[\]\)]?\s+\[([\d.]+)\s+(\w+)\]')} AS DOUBLE) * 1024.0
       END AS ssd_data_written_tb,
       {_xi(r'Power On Hours:\s+([\d,]+)')} AS ssd_power_on_hours,
       {_xi(r'Media and Data Integrity Errors:\s+([\d,]+)')} AS ssd_media_errors
FROM reports"""

register("c11_smart_report_fields", "C11 C12", SMART_SQL)(smart_parse)


def session_summary(spark, sf_dir):
    return D.session_summary(RD.sessions(spark, sf_dir))


SUMMARY_SQL = _with(TELEMETRY_CTE, RD.SESSIONS_CTE) + f"""
SELECT session_id, count(*) AS samples, min(ts) AS start_time, max(ts) AS end_time,
       {rnd("(epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 / 60.0", 1)} AS duration_minutes,
       {rnd("(epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 / 3600.0", 2)} AS duration_hours,
       CASE WHEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 / 60.0 > 0
            THEN {rnd("count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 / 60.0)", 1)}
            ELSE 0.0 END AS samples_per_minute
FROM sessions GROUP BY session_id"""

register("c14_session_summary", "C14", SUMMARY_SQL)(session_summary)


def state_distribution(spark, sf_dir):
    return D.state_distribution(RD.sessions(spark, sf_dir))


STATE_SQL = _with(TELEMETRY_CTE, RD.SESSIONS_CTE, """g AS (
  SELECT session_id,
         count(*) FILTER (WHERE load_state = 'Normal') AS normal_count,
         count(*) FILTER (WHERE load_state = 'Moderate') AS moderate_count,
         count(*) FILTER (WHERE load_state = 'High') AS high_count
  FROM sessions GROUP BY session_id)""") + f"""
SELECT *,
  CASE WHEN normal_count + moderate_count + high_count > 0
       THEN {rnd("normal_count / (normal_count + moderate_count + high_count) * 100.0", 1)}
       ELSE 0.0 END AS normal_pct,
  CASE WHEN normal_count + moderate_count + high_count > 0
       THEN {rnd("moderate_count / (normal_count + moderate_count + high_count) * 100.0", 1)}
       ELSE 0.0 END AS moderate_pct,
  CASE WHEN normal_count + moderate_count + high_count > 0
       THEN {rnd("high_count / (normal_count + moderate_count + high_count) * 100.0", 1)}
       ELSE 0.0 END AS high_pct
FROM g"""

register("c15_state_distribution", "C15", STATE_SQL)(state_distribution)

# Completeness parameters for the weekly driver sessions: one week at 8 h.
WEEK_S, EVERY_8H_S = 604800.0, 28800.0


def completeness(spark, sf_dir):
    return D.completeness(RD.sessions(spark, sf_dir), WEEK_S, EVERY_8H_S)


COMPLETE_SQL = _with(TELEMETRY_CTE, RD.SESSIONS_CTE, """g AS (
  SELECT session_id, 21 AS expected, count(*) AS actual FROM sessions GROUP BY session_id)""",
                     """r AS (SELECT *, CAST(greatest((expected - actual) * 28800.0, 0) AS BIGINT)
  AS rem FROM g)""") + f"""
SELECT session_id, expected, actual,
       {rnd("actual / 21.0 * 100.0", 1)} AS progress_pct,
       lpad(CAST(rem // 3600 AS VARCHAR), 2, '0') || 'h ' ||
       lpad(CAST((rem // 60) % 60 AS VARCHAR), 2, '0') || 'm ' ||
       lpad(CAST(rem % 60 AS VARCHAR), 2, '0') || 's' AS remaining
FROM r"""

register("c16_completeness", "C16", COMPLETE_SQL)(completeness)

# Log every 10th sample (the reference logs every 100th of a 2 h run).
LOG_EVERY = 10


def sample_log(spark, sf_dir):
    s = D.sample_numbers(RD.sessions(spark, sf_dir))
    return D.every_nth(s, LOG_EVERY).select("session_id", "id", "sample_number",
                                            "cpu_percent", "memory_percent")


LOG_SQL = _with(TELEMETRY_CTE, RD.SESSIONS_CTE) + f"""
SELECT session_id, id, sample_number, cpu_percent, memory_percent FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS sample_number
  FROM sessions) x
WHERE sample_number % {LOG_EVERY} = 0"""

register("c17_every_nth_sample", "C17 C10", LOG_SQL)(sample_log)
