"""Registered streaming queries (T6, S5, S9, S10, S11, S12; streaming T1 + T2).

Each builder lets the telemetry of the driver data arrive as raw tick files, in
six arrivals whose order is not the event order: the files of an arrival (one or
two, as many files as tasks) are added to the source folder and the Structured
Streaming query runs to its end on them with an ``availableNow`` trigger, from
the checkpoint of the run before.  It returns what the sinks hold.  The DuckDB
twins compute the same rows in batch.  Ticks of the driver data are hours apart,
so they arrive up to two days late and the state retains three.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..schemas import TICK
from ..session import scratch_table_dir
from ..sources import readings as RD
from ..sources.tables import TELEMETRY_CTE, telemetry
from ..streaming.live import run_to_end, start_alerts, start_live
from ..streaming.commits import read_sink
from .catalog import rnd
from .catalog_alerts import (COOLDOWN_S, MOD_BAND, SCORED_CTE, STREAK, STREAK_CTE,
                             _rec, cooldown_sql)
from .registry import register

ARRIVALS = 6
ARRIVALS_PER_BATCH = 2
DELAY_S = 172_800
RETAIN_S = 259_200
LATE_RETAIN_S = 518_400


def ticks(spark, sf_dir):
    """Raw ticks: the write counter and a process list of two per tick."""
    count = RD.counters(spark, sf_dir).select(F.col("hostname").alias("system_id"), "id",
                                              F.col("write_bytes").alias("disk_write_bytes"))
    load, mem = F.col("value"), F.col("memory_percent")
    process = "array<struct<pid:int,name:string,cpu_percent:double,memory_percent:double>>"
    t = telemetry(spark, sf_dir).join(count, ["system_id", "id"]).withColumn("processes", F.array(
        F.struct((F.col("id") % RD.PID_LIMIT + 2).cast("int").alias("pid"), F.col("process_name").alias("name"),
                 load.alias("cpu_percent"), mem.alias("memory_percent")),
        F.struct(F.lit(1).alias("pid"), F.lit("init").alias("name"), (100.0 - load).alias("cpu_percent"),
                 (100.0 - mem).alias("memory_percent"))).cast(process))
    return t.select(*[f.name for f in TICK.fields])


def deliver(arrivals, path: str, start, per_run: int = ARRIVALS_PER_BATCH) -> None:
    """Runs the stream that ``start(path)`` starts to its end on every ``per_run``
    arrivals (values of ``_file``), in that order: a micro-batch each, written
    by as many tasks as the ticks have, so no arrival meets in one task."""
    staged = path + "-staged"
    spark = arrivals.sparkSession
    arrivals.write.partitionBy("_file").parquet(staged)
    rows = spark.read.schema(arrivals.schema).parquet(staged)
    for n in range(0, ARRIVALS, per_run):
        rows.where(F.col("_file").between(n, n + per_run - 1)).drop("_file").write.mode("append").parquet(path)
        run_to_end(start(path))


def _span(spark, sf_dir):
    """First time of the ticks and the seconds that an arrival covers."""
    first, last = telemetry(spark, sf_dir).agg(F.min("ts"), F.max("ts")).first()
    return first, (last - first).total_seconds() / ARRIVALS + 1


def _file(seconds, first, width):
    """Number of the arrival that a tick coming ``seconds`` after its time falls in."""
    since = F.timestamp_diff("SECOND", F.lit(first), F.col("ts")) + seconds
    return F.least(F.lit(ARRIVALS - 1), F.floor(since / F.lit(width)).cast("int"))


def tick_arrivals(spark, sf_dir):
    """Ticks by arrival: every tick up to ``DELAY_S`` after its time, by a hash of it."""
    first, width = _span(spark, sf_dir)
    delay = F.pmod(F.xxhash64("system_id", "id"), F.lit(DELAY_S))
    return ticks(spark, sf_dir).withColumn("_file", _file(delay, first, width))


def _live(spark, sf_dir) -> str:
    base = scratch_table_dir(spark, f"live-{uuid.uuid4().hex}")
    out = os.path.join(base, "out")
    deliver(tick_arrivals(spark, sf_dir), os.path.join(base, "ticks"), lambda source: start_live(
        spark, source, out, os.path.join(base, "state"), cooldown_s=COOLDOWN_S, streak_len=STREAK, retain_s=RETAIN_S))
    return out


def live_pipeline(spark, sf_dir):
    """Every tick as the metrics, predictions and packet sinks hold it."""
    out = _live(spark, sf_dir)
    metrics = read_sink(spark, out, "metrics")
    preds = read_sink(spark, out, "predictions").select("system_id", "id", "risk_score", "risk_level")
    packet = F.from_json("value", "disk double, risk double, top_mem_process string, timestamp string")
    packets = read_sink(spark, out, "packets").select(
        "system_id", "id", packet["disk"].alias("packet_disk"), packet["risk"].alias("packet_risk"),
        packet["top_mem_process"].alias("packet_mem_process"), packet["timestamp"].alias("packet_time"))
    return metrics.join(preds, ["system_id", "id"]).join(packets, ["system_id", "id"])


TICKS_CTE = """ticks AS (
  SELECT t.*, CASE WHEN value > 100.0 - value THEN process_name ELSE 'init' END AS top_cpu,
         CASE WHEN memory_percent > 100.0 - memory_percent THEN process_name ELSE 'init' END AS top_mem,
         CAST(round(value * 100.0) AS BIGINT) * 10486 AS moved,
         row_number() OVER (PARTITION BY system_id ORDER BY ts, id) AS n
  FROM telemetry t)"""
DELTA = f"CASE WHEN n = 1 THEN 0.0 ELSE {rnd('moved / 1048576.0', 2)} END"
RISK = "(cpu_percent * 0.4 + memory_percent * 0.6) / 100.0"

LIVE_SQL = "WITH " + TELEMETRY_CTE + ", " + TICKS_CTE + f"""
SELECT id, ts, system_id, {rnd("cpu_percent", 1)} AS cpu_percent,
       {rnd("memory_percent", 1)} AS memory_percent,
       CAST(trunc(memory_available_mb) AS DOUBLE) AS memory_available_mb,
       {DELTA} AS disk_write_mbps, process_count, top_cpu AS top_cpu_process, top_mem AS top_mem_process,
       {RISK} AS risk_score, CASE WHEN {RISK} > 0.6 THEN 'HIGH' ELSE 'NORMAL' END AS risk_level,
       {DELTA} AS packet_disk, {rnd(RISK, 3)} AS packet_risk, top_mem AS packet_mem_process,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS packet_time
FROM ticks"""

register("t6_live_pipeline", "T6 S9 S10 S11 S12 C2 C5 C13", LIVE_SQL)(live_pipeline)


def live_log(spark, sf_dir):
    """Every row of the live log, read back from its CSV files as text."""
    log = read_sink(spark, _live(spark, sf_dir), "live_log")
    return log.select("timestamp", "top_cpu_process", "top_mem_process",
                      *[F.col(c).try_cast("double").alias(c) for c in ("cpu", "memory", "disk", "risk")],
                      *[F.col(c).try_cast("int").alias(c) for c in ("process_count", "memory_available_mb")])


LOG_SQL = "WITH " + TELEMETRY_CTE + ", " + TICKS_CTE + f"""
SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, top_cpu AS top_cpu_process,
       top_mem AS top_mem_process, {rnd("cpu_percent", 1)} AS cpu, {rnd("memory_percent", 1)} AS memory,
       {DELTA} AS disk, {rnd(RISK, 3)} AS risk, process_count,
       CAST(trunc(memory_available_mb * 1048576.0 / 1048576.0) AS INTEGER) AS memory_available_mb
FROM ticks"""

register("s5_live_log", "S5 S12 T6", LOG_SQL)(live_log)


def stream_alerts(spark, sf_dir):
    base = scratch_table_dir(spark, f"alerts-{uuid.uuid4().hex}")
    out = os.path.join(base, "out")
    deliver(tick_arrivals(spark, sf_dir), os.path.join(base, "ticks"), lambda source: start_alerts(
        spark, source, out, os.path.join(base, "state"), COOLDOWN_S, STREAK, retain_s=RETAIN_S))
    return read_sink(spark, out, "alerts")


STREAM_ALERTS_SQL = _rec(TELEMETRY_CTE, SCORED_CTE,
                         *cooldown_sql("scored", "system_id", MOD_BAND, f"{COOLDOWN_S}000000",
                                       True, "fires"), STREAK_CTE) + """
SELECT s.system_id, s.id, s.ts, 'MODERATE' AS alert_type, CAST(NULL AS BIGINT) AS streak
FROM scored s JOIN fires f ON s.system_id = f.k AND s.id = f.id
UNION ALL
SELECT system_id, id, ts, 'SUSTAINED_HIGH', streak FROM streaks"""

register("t1_t2_streaming_state", "T1 T2 S11", STREAM_ALERTS_SQL)(stream_alerts)


def late_and_repeated(spark, sf_dir):
    """S11 of a stream that repeats ticks and brings some far too late.

    Arrivals cover a sixth of the time each; ticks whose id is divisible by 13 come
    again two arrivals later, those divisible by 29 come with the last one only.
    One arrival per micro-batch.  Returns the kept ticks with their counter delta
    and every tick that was put aside with its kind.
    """
    base = scratch_table_dir(spark, f"arrivals-{uuid.uuid4().hex}")
    first, width = _span(spark, sf_dir)
    own = F.when(F.col("id") % 29 == 0, ARRIVALS - 1).otherwise(_file(F.lit(0), first, width))
    rows = ticks(spark, sf_dir).withColumn("_file", own)
    again = rows.where(F.col("id") % 13 == 0).withColumn("_file", F.least(F.col("_file") + 2, F.lit(ARRIVALS - 1)))
    out = os.path.join(base, "out")
    deliver(rows.unionByName(again), os.path.join(base, "ticks"), lambda source: start_live(
        spark, source, out, os.path.join(base, "state"), cooldown_s=COOLDOWN_S, streak_len=STREAK,
        retain_s=LATE_RETAIN_S), per_run=1)
    kept = read_sink(spark, out, "metrics").select("system_id", "id", "ts", F.lit("tick").alias("kind"), "disk_write_mbps")
    aside = read_sink(spark, out, "aside").select("system_id", "id", "ts", "kind",
                                                  F.lit(None).cast("double").alias("disk_write_mbps"))
    return kept.unionByName(aside)


LATE_SQL = "WITH " + TELEMETRY_CTE + f""", counted AS (
  SELECT system_id, id, ts,
         sum(CAST(round(value * 100.0) AS BIGINT) * 10486) OVER (PARTITION BY system_id ORDER BY ts, id) AS counter
  FROM telemetry),
span AS (SELECT min(ts) AS first, epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6 AS s FROM telemetry),
own AS (
  SELECT c.*, CASE WHEN id % 29 = 0 THEN {ARRIVALS - 1}
                   ELSE least({ARRIVALS - 1}, CAST(floor(
                     (epoch_us(ts) - epoch_us(first)) // 1000000 / (s / {ARRIVALS} + 1)) AS INTEGER)) END AS f
  FROM counted c, span),
arrivals AS (
  SELECT * FROM own UNION ALL
  SELECT system_id, id, ts, counter, least(f + 2, {ARRIVALS - 1}) FROM own WHERE id % 13 = 0),
clocked AS (
  SELECT a.*, (SELECT max(b.ts) FROM arrivals b WHERE b.system_id = a.system_id AND b.f < a.f) AS clock
  FROM arrivals a),
judged AS (
  SELECT *, clock IS NOT NULL AND ts < clock - INTERVAL {LATE_RETAIN_S} SECOND AS late FROM clocked),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY system_id, ts, late ORDER BY f, id) AS n FROM judged),
kinds AS (
  SELECT *, CASE WHEN late THEN 'late' WHEN n > 1 THEN 'repeated' ELSE 'tick' END AS kind FROM placed),
kept AS (
  SELECT *, counter - lag(counter) OVER (PARTITION BY system_id ORDER BY ts, id) AS moved FROM kinds WHERE kind = 'tick')
SELECT system_id, id, ts, kind, coalesce({rnd('moved / 1048576.0', 2)}, 0.0) AS disk_write_mbps FROM kept
UNION ALL
SELECT system_id, id, ts, kind, NULL FROM kinds WHERE kind <> 'tick'"""

register("s11_late_and_repeated", "S11 T6 C2", LATE_SQL)(late_and_repeated)
