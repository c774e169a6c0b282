"""Registered queries over the driver tables, each with its DuckDB twin.

Parameters that differ from the reference's defaults are chosen for the
driver data (ticks per system are hours apart, 49-86 per system at sf0.01)
and are stated next to each query.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import risk as R
from ..operators import serving as Q
from ..session import scratch_table_dir
from ..sources.tables import TELEMETRY_CTE, telemetry
from .registry import register


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def rnd(expr: str, digits: int) -> str:
    """DuckDB twin of Spark's ``round``: half-up on the shortest decimal form."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


PREDICTIONS_CTE = """predictions AS (
  SELECT system_id, id, ts,
         (cpu_percent * 0.4 + memory_percent * 0.6) / 100.0 AS risk_score
  FROM telemetry)"""

# Date range used by the report / filter queries (inclusive days).
RANGE_FROM, RANGE_TO = "2024-01-08", "2024-01-21"


# ---------------------------------------------------------------- flagship --

def report_in_range(spark, sf_dir):
    m = Q.date_range(telemetry(spark, sf_dir), RANGE_FROM, RANGE_TO)
    return Q.report(m)


REPORT_SQL = _with(TELEMETRY_CTE) + f"""
SELECT system_id,
       count(*) AS total,
       count(*) FILTER (WHERE cpu_percent > 80 OR memory_percent > 85) AS anomalies,
       count(*) - count(*) FILTER (WHERE cpu_percent > 80 OR memory_percent > 85) AS healthy,
       {rnd("(count(*) - count(*) FILTER (WHERE cpu_percent > 80 OR memory_percent > 85))"
            " / count(*) * 100.0", 1)} AS healthy_pct,
       {rnd("avg(cpu_percent)", 1)} AS avg_cpu,
       {rnd("avg(memory_percent)", 1)} AS avg_memory,
       {rnd("avg(disk_write_mbps)", 2)} AS avg_disk
FROM telemetry
WHERE ts >= TIMESTAMP '{RANGE_FROM}' AND ts < TIMESTAMP '{RANGE_TO}' + INTERVAL 1 DAY
GROUP BY system_id"""

register("q8_report_by_system", "Q6 Q8 R10 R1", REPORT_SQL)(report_in_range)


# ------------------------------------------------------ row classification --

def risk_classes(spark, sf_dir):
    m = telemetry(spark, sf_dir)
    risk = R.risk_score()
    pct = R.risk_pct(risk)
    health = R.health_percent(risk)
    return m.select(
        "system_id", "id",
        risk.alias("risk_score"),
        R.vote(risk).alias("vote"),
        R.stored_level(risk).alias("stored_level"),
        R.stored_fault(risk).alias("stored_fault"),
        R.severity(R.stored_level(risk)).alias("severity"),
        R.band(risk).alias("band"),
        health.alias("health_pct"),
        R.health_status(health).alias("health_status"),
        R.anomaly_label().alias("row_anomaly"),
        R.row_fault().alias("row_fault"),
        R.row_severity().alias("row_severity"),
        pct.alias("risk_pct"),
        (F.lit(100.0) - pct).alias("remaining_pct"),
        R.failure_window(pct).alias("failure_window"),
        R.cause_text(R.stored_fault(risk)).alias("cause"),
        R.cause_text(F.upper(R.row_fault())).alias("row_cause"),
        R.recommendation(pct).alias("recommendation"),
        R.warning_flag(pct).alias("warning"),
    )


RISK_SQL = _with(TELEMETRY_CTE, """r AS (
  SELECT system_id, id, cpu_percent, memory_percent,
         (cpu_percent * 0.4 + memory_percent * 0.6) / 100.0 AS risk_score
  FROM telemetry)""") + """
SELECT system_id, id, risk_score,
       CASE WHEN risk_score > 0.6 THEN 1 ELSE 0 END AS vote,
       CASE WHEN risk_score > 0.6 THEN 'HIGH' ELSE 'NORMAL' END AS stored_level,
       CASE WHEN risk_score > 0.6 THEN 'CPU' ELSE 'NONE' END AS stored_fault,
       CASE WHEN risk_score > 0.6 THEN 'WARNING' ELSE 'INFO' END AS severity,
       CASE WHEN risk_score >= 0.7 THEN 'HIGH' WHEN risk_score >= 0.4 THEN 'MODERATE'
            ELSE 'NORMAL' END AS band,
       CASE WHEN risk_score >= 0.7
            THEN CAST(round(greatest(0.0, least(100.0, (1.0 - risk_score) * 100.0))) AS INTEGER)
            ELSE 100 END AS health_pct,
       CASE WHEN (CASE WHEN risk_score >= 0.7
            THEN CAST(round(greatest(0.0, least(100.0, (1.0 - risk_score) * 100.0))) AS INTEGER)
            ELSE 100 END) < 50 THEN 'Critical'
            WHEN (CASE WHEN risk_score >= 0.7
            THEN CAST(round(greatest(0.0, least(100.0, (1.0 - risk_score) * 100.0))) AS INTEGER)
            ELSE 100 END) < 75 THEN 'Warning' ELSE 'Healthy' END AS health_status,
       CASE WHEN cpu_percent > 80 OR memory_percent > 85 THEN 'Anomaly Detected'
            ELSE 'Normal' END AS row_anomaly,
       CASE WHEN cpu_percent > 80 THEN 'CPU' WHEN memory_percent > 85 THEN 'Memory'
            ELSE 'Normal' END AS row_fault,
       CASE WHEN cpu_percent > 80 THEN 'HIGH' WHEN memory_percent > 85 THEN 'MEDIUM'
            ELSE 'LOW' END AS row_severity,
       risk_score * 100.0 AS risk_pct,
       100.0 - risk_score * 100.0 AS remaining_pct,
       CASE WHEN risk_score * 100.0 >= 80 THEN 'Within 24 Hours'
            WHEN risk_score * 100.0 >= 60 THEN '1–3 Days'
            WHEN risk_score * 100.0 >= 40 THEN '3–7 Days' ELSE '7+ Days' END AS failure_window,
       CASE WHEN risk_score > 0.6 THEN 'High CPU utilization and abnormal processing load.'
            ELSE 'No significant anomaly detected.' END AS cause,
       CASE WHEN risk_score * 100.0 >= 80
            THEN 'Immediate maintenance recommended. Investigate system before failure.'
            WHEN risk_score * 100.0 >= 60 THEN 'Schedule maintenance as soon as possible.'
            WHEN risk_score * 100.0 >= 40 THEN 'Increase monitoring frequency.'
            ELSE 'Continue monitoring.' END AS recommendation,
       risk_score * 100.0 >= 60 AS warning
FROM r"""

RISK_SQL = f"""SELECT *, CASE upper(row_fault) WHEN 'CPU' THEN 'High CPU utilization and abnormal processing load.'
         WHEN 'MEMORY' THEN 'Memory pressure and reduced available RAM.'
         WHEN 'DISK' THEN 'High disk activity and write throughput.'
         ELSE 'No significant anomaly detected.' END AS row_cause
FROM ({RISK_SQL}) x"""

register("r_risk_classes", "R1 R2 R3 R4 R6 R8 R9 R10 R11 R12 R13 R14 R15 R17 R18",
         RISK_SQL)(risk_classes)


def risk_contribution(spark, sf_dir):
    """R16 on the latest metric of every system: 4 rows each."""
    from ..operators.classify import contribution
    latest = Q.latest_metric(telemetry(spark, sf_dir))
    return contribution(latest).select("system_id", "component", "contribution")


CONTRIB_SQL = _with(TELEMETRY_CTE, """l AS (
  SELECT * FROM telemetry
  QUALIFY row_number() OVER (PARTITION BY system_id ORDER BY ts DESC, id DESC) = 1)""") + """
SELECT system_id, 'CPU' AS component, coalesce(cpu_percent, 0.0) AS contribution FROM l
UNION ALL SELECT system_id, 'Memory', coalesce(memory_percent, 0.0) FROM l
UNION ALL SELECT system_id, 'Disk', least(coalesce(disk_write_mbps, 0.0) * 5.0, 100.0) FROM l
UNION ALL SELECT system_id, 'Other',
   greatest(100.0 - (coalesce(cpu_percent, 0.0) + coalesce(memory_percent, 0.0)) / 2.0, 0.0) FROM l"""

register("r16_risk_contribution", "R16 Q1", CONTRIB_SQL)(risk_contribution)


def prediction_rows(spark, sf_dir):
    """The stored predictions table in rule mode; the probability
    text is read back at full precision."""
    p = Q.predictions(telemetry(spark, sf_dir))
    probs = F.from_json("probabilities_json", "map<string,double>")
    return p.select("*", probs["xgboost"].alias("p_xgboost"), probs["normal"].alias("p_normal")) \
        .drop("probabilities_json")


PRED_SQL = _with(TELEMETRY_CTE, """r AS (
  SELECT system_id, id, ts, (cpu_percent * 0.4 + memory_percent * 0.6) / 100.0 AS risk_score
  FROM telemetry)""") + """
SELECT system_id, id, ts, risk_score,
       CASE WHEN risk_score > 0.6 THEN 'HIGH' ELSE 'NORMAL' END AS risk_level,
       0.95 AS confidence, 1 AS votes,
       CASE WHEN risk_score > 0.6 THEN 'CPU' ELSE 'NONE' END AS fault_type,
       'INFO' AS severity_level, 'NORMAL' AS pem_status, 'NORMAL' AS md_status,
       '{"xgboost":' || CASE WHEN risk_score > 0.6 THEN '1' ELSE '0' END || '}' AS models_json,
       risk_score AS p_xgboost, 1.0 - risk_score AS p_normal
FROM r"""

register("s10_predictions_table", "S10 R1 R3 R7 L4", PRED_SQL)(prediction_rows)


def vote_table(spark, sf_dir):
    """One row per model vote; one model has a probability, one only its
    published F1, one neither."""
    from ..operators.classify import vote_table as vt
    t = telemetry(spark, sf_dir).withColumn("risk_score", R.risk_score())
    votes = F.create_map(F.lit("xgboost"), R.vote(F.col("risk_score")).cast("int"),
                         F.lit("random forest"), (F.col("cpu_percent") > 80).cast("int"),
                         F.lit("site rule"), (F.col("memory_percent") > 90).cast("int"))
    return vt(t.select("system_id", "id", R.stored_fault(F.col("risk_score")).alias("fault_type"),
                       F.to_json(votes).alias("models_json"),
                       R.probabilities_json(F.col("risk_score")).alias("probabilities_json")))


VOTE_SQL = _with(TELEMETRY_CTE, """r AS (
  SELECT system_id, id, (cpu_percent * 0.4 + memory_percent * 0.6) / 100.0 AS risk_score,
         CASE WHEN cpu_percent > 80 THEN 1 ELSE 0 END AS rf,
         CASE WHEN memory_percent > 90 THEN 1 ELSE 0 END AS site
  FROM telemetry)""", f"""v AS (
  SELECT system_id, id, risk_score, 'xgboost' AS model, CASE WHEN risk_score > 0.6 THEN 1 ELSE 0 END AS vote,
         printf('%.2f', {rnd("risk_score * 100.0", 2)}) || '%' AS score, rf, site FROM r
  UNION ALL SELECT system_id, id, risk_score, 'random forest', rf, '98.62%', rf, site FROM r
  UNION ALL SELECT system_id, id, risk_score, 'site rule', site, 'N/A', rf, site FROM r)""") + """
SELECT system_id, id, model, CASE WHEN vote = 1 THEN 'Anomaly' ELSE 'Normal' END AS vote_label, score,
       CASE WHEN vote = 1 THEN 'High ' || CASE WHEN risk_score > 0.6 THEN 'CPU' ELSE 'NONE' END
            || ' anomaly detected' ELSE 'Normal operating pattern' END AS reason,
       CASE WHEN risk_score > 0.6 THEN 1 ELSE 0 END + rf + site AS anomaly_count
FROM v"""

register("r19_vote_table", "R19 R7 L17", VOTE_SQL)(vote_table)


def served_prediction(spark, sf_dir):
    """R5 without a model, over the device registry: systems without any metric
    get the no-data row."""
    from ..sources.tables import read_table
    systems = read_table(spark, sf_dir, "customer").select(
        F.concat(F.lit("SYSTEM-"), F.col("c_custkey").cast("string")).alias("system_id"))
    out = Q.rule_prediction(telemetry(spark, sf_dir), systems)
    return out.select("*", F.to_json("models").alias("models_json"),
                      F.get(F.map_values("probabilities"), F.lit(0)).alias("p_first")) \
        .drop("models", "probabilities")


SERVED_SQL = _with(TELEMETRY_CTE, """l AS (
  SELECT *, (cpu_percent * 0.4 + memory_percent * 0.6) / 100.0 AS risk FROM telemetry
  QUALIFY row_number() OVER (PARTITION BY system_id ORDER BY ts DESC, id DESC) = 1)""",
                   """s AS (SELECT DISTINCT 'SYSTEM-' || CAST(c_custkey AS VARCHAR) AS system_id
  FROM customer)""") + f"""
SELECT s.system_id, l.ts AS metric_ts, coalesce({rnd("risk", 3)}, 0.0) AS risk_score,
       CASE WHEN risk > 0.6 THEN 'HIGH' ELSE 'NORMAL' END AS risk_level, 0.0::DOUBLE AS confidence,
       CASE WHEN l.id IS NULL THEN 0 ELSE 1 END AS votes,
       CASE WHEN risk > 0.6 THEN 'CPU' ELSE 'NONE' END AS fault_type,
       CASE WHEN risk > 0.6 THEN 'WARNING' ELSE 'INFO' END AS severity_level,
       'NORMAL' AS pem_status, 'NORMAL' AS md_status,
       CASE WHEN l.id IS NULL THEN '{{}}' WHEN risk > 0.6 THEN '{{"xgboost":1}}' ELSE '{{"xgboost":0}}' END AS models_json,
       CASE WHEN l.id IS NULL THEN NULL ELSE 0.0::DOUBLE END AS p_first
FROM s LEFT JOIN l ON s.system_id = l.system_id"""

register("r5_rule_prediction", "R5 R6 R7 R20 Q1", SERVED_SQL)(served_prediction)


def latest_status(spark, sf_dir):
    """Q2 + R20 over the device registry (every customer is a system)."""
    from ..sources.tables import read_table
    preds = Q.predictions(telemetry(spark, sf_dir))
    systems = read_table(spark, sf_dir, "customer").select(
        F.concat(F.lit("SYSTEM-"), F.col("c_custkey").cast("string")).alias("system_id"))
    return Q.latest_status(preds, systems)


STATUS_SQL = _with(TELEMETRY_CTE, """p AS (
  SELECT system_id,
         CASE WHEN (cpu_percent * 0.4 + memory_percent * 0.6) / 100.0 > 0.6 THEN 'HIGH'
              ELSE 'NORMAL' END AS risk_level,
         CASE WHEN (cpu_percent * 0.4 + memory_percent * 0.6) / 100.0 > 0.6 THEN 'CPU'
              ELSE 'NONE' END AS fault_type,
         'INFO' AS severity_level
  FROM telemetry
  QUALIFY row_number() OVER (PARTITION BY system_id ORDER BY ts DESC, id DESC) = 1)""",
                   """s AS (SELECT DISTINCT 'SYSTEM-' || CAST(c_custkey AS VARCHAR) AS system_id
  FROM customer)""") + """
SELECT s.system_id, coalesce(risk_level, 'NORMAL') AS risk_level,
       coalesce(fault_type, 'NONE') AS fault_type,
       coalesce(severity_level, 'INFO') AS severity_level
FROM s LEFT JOIN p ON s.system_id = p.system_id"""

register("q2_latest_status", "Q2 R20 Q1", STATUS_SQL)(latest_status)


# ---------------------------------------------------------------- serving --

def latest_metric(spark, sf_dir):
    return Q.latest_metric(telemetry(spark, sf_dir))


LATEST_SQL = _with(TELEMETRY_CTE) + """
SELECT * FROM telemetry
QUALIFY row_number() OVER (PARTITION BY system_id ORDER BY ts DESC, id DESC) = 1"""

register("q1_latest_metric", "Q1 C13", LATEST_SQL)(latest_metric)


def history_last100(spark, sf_dir):
    return Q.history(telemetry(spark, sf_dir), 100)


def _last_n_sql(n: int, cols: str, src: str = "telemetry") -> str:
    return f"""
SELECT {cols}, {n} + 1 - rk AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY ts DESC, id DESC) AS rk
  FROM {src}) x
WHERE rk <= {n}"""


HISTORY_SQL = _with(TELEMETRY_CTE) + _last_n_sql(
    100, "id, ts, system_id, cpu_percent, memory_percent, memory_available_mb, "
         "disk_write_mbps, process_count")

register("q4_history_last100", "Q4 Q10", HISTORY_SQL)(history_last100)


def risk_history_last30(spark, sf_dir):
    return Q.risk_history(Q.predictions(telemetry(spark, sf_dir)), 30)


RISK_HISTORY_SQL = _with(TELEMETRY_CTE, """p AS (
  SELECT system_id, id, ts, (cpu_percent * 0.4 + memory_percent * 0.6) / 100.0 AS risk_score
  FROM telemetry)""", """q AS (
  SELECT *, CASE WHEN risk_score > 0.6 THEN 'HIGH' ELSE 'NORMAL' END AS risk_level,
         CASE WHEN risk_score > 0.6 THEN 'CPU' ELSE 'NONE' END AS fault_type,
         strftime(ts, '%H:%M:%S') AS time
  FROM p)""") + _last_n_sql(30, "system_id, id, time, risk_score, risk_level, fault_type", "q")

register("q5_risk_history_last30", "Q5 Q10", RISK_HISTORY_SQL)(risk_history_last30)


def date_filter(spark, sf_dir):
    return Q.date_range(telemetry(spark, sf_dir), RANGE_FROM, RANGE_TO).select(
        "system_id", "id", "ts", "cpu_percent", "memory_percent")


DATE_SQL = _with(TELEMETRY_CTE) + f"""
SELECT system_id, id, ts, cpu_percent, memory_percent FROM telemetry
WHERE ts >= TIMESTAMP '{RANGE_FROM}' AND ts < TIMESTAMP '{RANGE_TO}' + INTERVAL 1 DAY"""

register("q6_date_range", "Q6", DATE_SQL)(date_filter)


def pagination(spark, sf_dir):
    m = Q.date_range(telemetry(spark, sf_dir), RANGE_FROM, RANGE_TO)
    return Q.paginate(m.select("system_id", "id", "ts"), page_size=20)


PAGE_SQL = _with(TELEMETRY_CTE, f"""f AS (
  SELECT system_id, id, ts FROM telemetry
  WHERE ts >= TIMESTAMP '{RANGE_FROM}' AND ts < TIMESTAMP '{RANGE_TO}' + INTERVAL 1 DAY)""") + """
SELECT system_id, id, ts,
       CAST(ceil(pos / 20.0) AS BIGINT) AS page,
       CAST((pos - 1) % 20 + 1 AS BIGINT) AS row_in_page,
       CAST(greatest(1, ceil(n / 20.0)) AS BIGINT) AS pages
FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY ts, id) AS pos,
             count(*) OVER (PARTITION BY system_id) AS n FROM f) x"""

register("q7_pagination", "Q7 Q6", PAGE_SQL)(pagination)

DEEP_PAGE = 3


def page_by_keyset(spark, sf_dir):
    """Q7: one deep page of the first system, read through the page index."""
    path = scratch_table_dir(spark, f"paged-{uuid.uuid4().hex}")
    m = telemetry(spark, sf_dir).select("system_id", "id", "ts", "cpu_percent", "memory_percent")
    Q.write_paged(m, path, page_size=20)
    first = m.agg(F.min("system_id")).first()[0]
    return Q.read_page(spark, path, first, DEEP_PAGE).withColumn("page", F.lit(DEEP_PAGE).cast("long"))


KEYSET_SQL = f"""WITH {TELEMETRY_CTE}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY ts, id) AS pos,
         count(*) OVER (PARTITION BY system_id) AS n FROM telemetry)
SELECT system_id, id, ts, cpu_percent, memory_percent, CAST((pos - 1) % 20 + 1 AS BIGINT) AS row_in_page,
       CAST(greatest(1, ceil(n / 20.0)) AS BIGINT) AS pages, CAST({DEEP_PAGE} AS BIGINT) AS page
FROM ranked WHERE system_id = (SELECT min(system_id) FROM telemetry) AND ceil(pos / 20.0) = {DEEP_PAGE}"""

register("q7_page_by_keyset", "Q7", KEYSET_SQL)(page_by_keyset)


def latest_series(spark, sf_dir):
    """Q10 with N = 50 (live monitor)."""
    return Q.last_n_per_system(telemetry(spark, sf_dir).select(
        "system_id", "id", "ts", "cpu_percent", "memory_percent", "disk_write_mbps"), 50)


SERIES_SQL = _with(TELEMETRY_CTE) + _last_n_sql(
    50, "system_id, id, ts, cpu_percent, memory_percent, disk_write_mbps")

register("q10_latest_series", "Q10", SERIES_SQL)(latest_series)


def trend_series(spark, sf_dir):
    """Q11: last 20 points per system as chart rows (risk from predictions)."""
    m = telemetry(spark, sf_dir).withColumn("risk_score", R.risk_score())
    return Q.trend(m, 20)


TREND_SQL = _with(TELEMETRY_CTE, """t AS (
  SELECT *, (cpu_percent * 0.4 + memory_percent * 0.6) / 100.0 AS risk_score FROM telemetry)""") + f"""
SELECT system_id, id, 20 + 1 - rk AS position, strftime(ts, '%H:%M') AS time,
       {rnd("cpu_percent", 1)} AS cpu, {rnd("memory_percent", 1)} AS memory,
       coalesce(risk_score, 0.0) AS risk
FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY ts DESC, id DESC) AS rk
      FROM t) x
WHERE rk <= 20"""

register("q11_trend", "Q10 Q11", TREND_SQL)(trend_series)


def packet_roundtrip(spark, sf_dir):
    """S12 -> Q12: live packets as JSON, parsed back into metric rows."""
    from ..sources.sinks import live_packets
    packets = live_packets(telemetry(spark, sf_dir).withColumn(
        "memory_available_bytes", F.col("memory_available_mb") * 1048576.0))
    # every fifth packet comes without disk, process count and memory
    bare = F.regexp_replace("value", r'"(disk|process_count|memory_available_mb)":[^,]*,', "")
    packets = packets.withColumn("value", F.when(F.col("id") % 5 == 0, bare).otherwise(F.col("value")))
    return Q.normalise_packet(packets)


PACKET_SQL = _with(TELEMETRY_CTE) + f"""
SELECT system_id, id,
       {rnd("cpu_percent", 1)} AS cpu_percent,
       {rnd("memory_percent", 1)} AS memory_percent,
       CASE WHEN id % 5 = 0 THEN 0.0 ELSE {rnd("disk_write_mbps", 2)} END AS disk_write_mbps,
       CASE WHEN id % 5 = 0 THEN 0 ELSE coalesce(process_count, 0) END AS process_count,
       CASE WHEN id % 5 = 0 THEN 0
            ELSE CAST(trunc(memory_available_mb * 1048576.0 / 1048576.0) AS INTEGER) END AS memory_available_mb,
       {rnd("(cpu_percent * 0.4 + memory_percent * 0.6) / 100.0", 3)} AS risk,
       process_name AS top_cpu_process,
       process_name AS top_mem_process
FROM telemetry"""

register("q12_packet_normalise", "S12 Q12 C4", PACKET_SQL)(packet_roundtrip)


def feature_defaults(spark, sf_dir):
    m = telemetry(spark, sf_dir).select(
        "id", F.col("system_id").alias("hostname"), "ts", "cpu_percent", "memory_percent",
        "disk_write_mbps", F.col("process_count").cast("double").alias("process_count"))
    return Q.feature_defaults(m)


DEFAULTS_SQL = _with(TELEMETRY_CTE) + """
SELECT id, coalesce(nullif(system_id, ''), 'system-01') AS hostname, ts,
       coalesce(cpu_percent, 0.0) AS cpu_percent,
       coalesce(memory_percent, 0.0) AS memory_percent,
       0.0 AS disk_read_mbps,
       coalesce(disk_write_mbps, 0.0) AS disk_write_mbps,
       0.0 AS network_upload_mbps, 0.0 AS network_download_mbps,
       coalesce(CAST(process_count AS DOUBLE), 0.0) AS process_count,
       0.0 AS ssd_percentage_used
FROM telemetry"""

register("q13_feature_defaults", "Q13", DEFAULTS_SQL)(feature_defaults)


def _requests(spark, sf_dir):
    """Requests as text: some lack the available memory, some carry a process
    count that is not an integer, the others are complete."""
    from ..sources.tables import read_table
    from ..schemas import METRIC_REQUEST_FIELDS
    ev = read_table(spark, sf_dir, "events")
    raw = ev.select(
        F.col("event_id").alias("id"), "ts",
        F.col("value").cast("string").alias("cpu_percent"),
        F.get_json_object("props", "$.k").alias("memory_percent"),
        F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 4096).cast("string")).alias("memory_available_mb"),
        F.col("value").cast("string").alias("disk_write_mbps"),
        F.when(F.col("event_id") % 7 != 0, F.floor("value").cast("string"))
        .otherwise(F.concat(F.floor("value").cast("string"), F.lit(" running"))).alias("process_count"),
    )
    return Q.validate_requests(raw, [(n, t.simpleString()) for n, t in METRIC_REQUEST_FIELDS])


def ingest_validation(spark, sf_dir):
    """Q14: requests carried as text, parsed and split."""
    return _requests(spark, sf_dir).select(
        "id", "cpu_percent", "memory_percent", "memory_available_mb", "disk_write_mbps",
        "process_count", "accepted", F.array_join("missing", ",").alias("missing"))


REQUESTS_CTE = """t AS (
  SELECT event_id AS id, ts, value AS cpu_percent,
         TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS memory_percent,
         CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 4096 AS DOUBLE) END AS memory_available_mb,
         value AS disk_write_mbps,
         CASE WHEN event_id % 7 <> 0 THEN CAST(floor(value) AS INTEGER) END AS process_count
  FROM events),
checked AS (
  SELECT *, (cpu_percent IS NOT NULL AND memory_percent IS NOT NULL
             AND memory_available_mb IS NOT NULL AND disk_write_mbps IS NOT NULL
             AND process_count IS NOT NULL) AS accepted
  FROM t)"""

INGEST_SQL = _with(REQUESTS_CTE) + """
SELECT * EXCLUDE (ts),
       concat_ws(',', CASE WHEN cpu_percent IS NULL THEN 'cpu_percent' END,
                 CASE WHEN memory_percent IS NULL THEN 'memory_percent' END,
                 CASE WHEN memory_available_mb IS NULL THEN 'memory_available_mb' END,
                 CASE WHEN disk_write_mbps IS NULL THEN 'disk_write_mbps' END,
                 CASE WHEN process_count IS NULL THEN 'process_count' END) AS missing
FROM checked"""

register("q14_ingest_validation", "Q14", INGEST_SQL)(ingest_validation)


def request_append(spark, sf_dir):
    """S9 by request: accepted requests appended to the metrics table as sent."""
    import uuid

    from ..session import scratch_table_dir
    from ..sources.sinks import write_table
    path = scratch_table_dir(spark, f"metrics-{uuid.uuid4().hex}")
    write_table(Q.request_metrics(_requests(spark, sf_dir)), path)
    return spark.read.parquet(path)


APPEND_SQL = _with(REQUESTS_CTE) + """
SELECT id, ts, cpu_percent, memory_percent, memory_available_mb, disk_write_mbps, process_count,
       'SYSTEM-01' AS system_id
FROM checked WHERE accepted"""

register("s9_request_append", "S9 Q14 C13", APPEND_SQL)(request_append)


def status_panel(spark, sf_dir):
    m = telemetry(spark, sf_dir)
    return Q.panel(m, Q.predictions(m))


PANEL_SQL = _with(TELEMETRY_CTE, """p AS (
  SELECT system_id, id, ts, (cpu_percent * 0.4 + memory_percent * 0.6) / 100.0 AS risk_score,
         cpu_percent, memory_percent, disk_write_mbps
  FROM telemetry
  QUALIFY row_number() OVER (PARTITION BY system_id ORDER BY ts DESC, id DESC) = 1)""") + """
SELECT system_id, id AS metric_id, ts AS metric_ts, cpu_percent, memory_percent,
       disk_write_mbps, id AS prediction_id, ts AS prediction_ts, risk_score,
       CASE WHEN risk_score > 0.6 THEN 'HIGH' ELSE 'NORMAL' END AS risk_level,
       CASE WHEN risk_score > 0.6 THEN 'CPU' ELSE 'NONE' END AS fault_type,
       'INFO' AS severity_level,
       CASE WHEN risk_score > 0.6 THEN 'HIGH' ELSE 'NORMAL' END AS status_level,
       CASE WHEN risk_score > 0.6 THEN 'CPU' ELSE 'NONE' END AS status_fault,
       'INFO' AS status_severity
FROM p"""

register("q15_status_panel", "Q15 Q1 Q2", PANEL_SQL)(status_panel)
