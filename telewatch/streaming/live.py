"""The live pipeline as one Structured Streaming query.

tick files -> top process of the tick's list (C5) and scoring -> keyed state
(``state``: order, repeats, counter delta C2, alerts T1 and T2) ->
``foreachBatch`` appending to the sinks: metrics, predictions, live packets,
the live log, alerts, and the ticks put aside (late, repeated, untimed).
``commits.read_sink`` reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.derive import MIB, counter_deltas, top_of_list
from ..operators.serving import predictions
from ..schemas import TICK
from ..sources.sinks import live_log_rows, live_packets
from .commits import Sinks, query_id
from .state import ASIDE, GROUPS, RETAIN_S, tick_changes

COOLDOWN_S, STREAK = 300.0, 30
PAYLOAD = ("cpu_percent double, memory_percent double, memory_available_mb double, process_count int, "
           "top_cpu_process string, top_mem_process string")


def read_ticks(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Tick source (parquet files; a message bus in a deployment).  Repeated
    and late ticks are told apart by the keyed state, none is dropped here."""
    reader = spark.readStream.schema(TICK)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _with_top(ticks: DataFrame) -> DataFrame:
    return ticks.withColumns({"top_cpu_process": top_of_list("processes", "cpu_percent"),
                              "top_mem_process": top_of_list("processes", "memory_percent")}).drop("processes")


def derive_ticks(ticks: DataFrame) -> DataFrame:
    """C2 + C5 on a table of raw ticks: written MiB since the previous tick of the
    system (0 on its first), and the busiest processes of the tick's list."""
    rows = counter_deltas(ticks, ["disk_write_bytes"], key="system_id")
    return _with_top(rows).withColumnRenamed("disk_write_bytes_delta_mb", "disk_write_mbps").drop("disk_write_bytes")


def tick_rows(changes: DataFrame) -> DataFrame:
    """Derived ticks (first versions and revisions) among the changes of a batch."""
    p = F.from_json("payload", PAYLOAD)
    delta = F.coalesce(F.round(F.col("moved") / F.lit(MIB), 2), F.lit(0.0))
    return (changes.where("kind = 'tick'").withColumn("_p", p)
            .select("system_id", "id", _time().alias("ts"), "rev", "_p.*", delta.alias("disk_write_mbps")))


def _time():
    """Epoch microseconds as a time without a zone, whatever the session zone."""
    return F.expr("timestamp_ntz '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, "
                  "cast(cast(t AS decimal(20,0)) / 1000000 AS decimal(18,6)))")


def alert_rows(changes: DataFrame) -> DataFrame:
    return changes.where("kind = 'alert'").select("system_id", "id", _time().alias("ts"), "alert_type", "streak", "sign")


def aside_rows(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("kind").isin(*ASIDE)).select("system_id", "id", _time().alias("ts"), "kind", "payload")


def metric_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """Metrics row with the reference's rounding (1 / 1 / int / 2 digits)."""
    return rows.select(
        *keep,
        "id", "ts", F.coalesce("system_id", F.lit("SYSTEM-01")).alias("system_id"),
        F.round("cpu_percent", 1).alias("cpu_percent"),
        F.round("memory_percent", 1).alias("memory_percent"),
        F.col("memory_available_mb").cast("long").cast("double").alias("memory_available_mb"),
        F.round("disk_write_mbps", 2).alias("disk_write_mbps"),
        F.col("process_count").cast("int").alias("process_count"),
        "top_cpu_process", "top_mem_process")


def write_batch(out_dir: str, ticks: bool = True):
    """foreachBatch body: append the batch to all sinks, then commit it."""
    def run(batch: DataFrame, batch_id: int) -> None:
        sinks = Sinks(batch.sparkSession, out_dir, query_id(batch))
        batch.persist()
        try:
            if ticks:
                rows = tick_rows(batch)
                keyed = ("system_id", "id", "rev")
                sinks.write(metric_rows(rows, "rev"), "metrics", batch_id)
                sinks.write(predictions(rows, keep=("rev",)), "predictions", batch_id)
                packets = live_packets(rows.withColumn(
                    "memory_available_bytes", F.col("memory_available_mb") * 1048576.0), keyed)
                sinks.write(packets, "packets", batch_id)
                log = live_log_rows(packets, keyed)
                sinks.write(log.select(*[c for c in log.columns if c not in keyed], *keyed), "live_log", batch_id)
            sinks.write(alert_rows(batch), "alerts", batch_id)
            sinks.write(aside_rows(batch), "aside", batch_id)
            sinks.commit(batch_id)
        finally:
            batch.unpersist()
    return run


def start_live(spark: SparkSession, source: str, out_dir: str, checkpoint: str,
               available_now: bool = True, max_files: int | None = None, cooldown_s: float = COOLDOWN_S,
               streak_len: int = STREAK, retain_s: float | None = RETAIN_S, groups: int = GROUPS):
    """Start the live query; returns the StreamingQuery.

    ``retain_s`` is how far a tick may lie behind the latest one of its system
    and still be put in its place (None: any tick), ``groups`` the number of
    state rows that hold the systems; see ``state``.
    """
    ticks = _with_top(read_ticks(spark, source, max_files))
    names = [f.split()[0] for f in PAYLOAD.split(", ")]
    changes = tick_changes(ticks, cooldown_s, streak_len, retain_s, F.to_json(F.struct(*names)), groups=groups)
    writer = (changes.writeStream.outputMode("append").foreachBatch(write_batch(out_dir))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="1 second")
    return writer.start()


def run_to_end(query, timeout_s: float | None = None) -> None:
    """Wait for an ``availableNow`` query to process all its input.

    Its error is raised by the wait itself.  With a limit, a query that is not
    done in time is stopped and an error raised: what its sinks hold by then is
    part of the result and must not be read as the whole.
    """
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream did not finish within {timeout_s} s")


def start_alerts(spark: SparkSession, source: str, out_dir: str, checkpoint: str,
                 cooldown_s: float = COOLDOWN_S, streak_len: int = STREAK, max_files: int | None = None,
                 retain_s: float | None = RETAIN_S, groups: int = GROUPS):
    """Streaming T1 + T2 alone: the alerts and aside sinks of ``start_live``."""
    ticks = read_ticks(spark, source, max_files).select("system_id", "id", "ts", "cpu_percent", "memory_percent")
    return (tick_changes(ticks, cooldown_s, streak_len, retain_s, groups=groups).writeStream.outputMode("append")
            .foreachBatch(write_batch(out_dir, ticks=False)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
