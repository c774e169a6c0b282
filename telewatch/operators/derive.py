"""Telemetry derivations (C1-C17) over tables of raw readings.

The reference computes these on one host from OS counters; here each is a
DataFrame transformation over a table of readings keyed by host and time, so
the same code handles one host or a fleet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import epoch_micros
from ..schemas import STATES
from .ordered import ordered_scan

MIB = 1048576.0
MIN_ELAPSED_S = 0.001
PAIRED_GAP_S = 0.1

# Sensor names tried in order for the CPU temperature.
SENSOR_PRIORITY = ["coretemp", "cpu_thermal", "hwmon", "k10temp", "zenpower"]


def _micros(ts: str = "ts") -> Column:
    return epoch_micros(ts)


def counter_rates(counters: DataFrame, counter_cols: Sequence[str], key: str = "hostname",
                  suffix: str = "_mbps") -> DataFrame:
    """Δcounter / 2^20 / elapsed seconds, 2 digits; one elapsed per tick.

    Elapsed is measured from the previous reading of the same key; 0 when it
    is at most 1 ms (and on a key's first reading).  A falling counter gives
    a negative rate (ledger L10).
    """
    lags = {f"_prev_{c}": c for c in counter_cols}
    lags["_prev_ts"] = "ts"
    s = ordered_scan(counters, [key], ["ts", "id"], lags=lags)
    elapsed = (_micros("ts") - _micros("_prev_ts")) / F.lit(1e6)
    ok = F.col("_prev_ts").isNotNull() & (elapsed > MIN_ELAPSED_S)
    out = s.withColumn("elapsed_s", F.coalesce(elapsed, F.lit(0.0)))
    for c in counter_cols:
        rate = F.round((F.col(c) - F.col(f"_prev_{c}")) / F.lit(MIB) / elapsed, 2)
        out = out.withColumn(f"{c}{suffix}", F.when(ok, rate).otherwise(F.lit(0.0)))
    return out.drop(*lags.keys())


def counter_deltas(counters: DataFrame, counter_cols: Sequence[str], key: str = "hostname",
                   suffix: str = "_delta_mb") -> DataFrame:
    """Per-tick Δcounter / 2^20 (2 digits), not divided by elapsed; first tick 0."""
    lags = {f"_prev_{c}": c for c in counter_cols}
    s = ordered_scan(counters, [key], ["ts", "id"], lags=lags)
    for c in counter_cols:
        delta = F.round((F.col(c) - F.col(f"_prev_{c}")) / F.lit(MIB), 2)
        s = s.withColumn(f"{c}{suffix}", F.coalesce(delta, F.lit(0.0)))
    return s.drop(*lags.keys())


def paired_rate(start: Column, end: Column, gap_s: float = PAIRED_GAP_S) -> Column:
    """(end - start) / 2^20 / fixed gap, 2 digits."""
    return F.round((end - start) / F.lit(MIB) / F.lit(gap_s), 2)


def to_mib(bytes_col: Column, digits: int = 2) -> Column:
    """C4: bytes -> MiB, rounded."""
    return F.round(bytes_col / F.lit(MIB), digits)


def top_of_list(processes: str, load: str, empty_name: str = "N/A") -> Column:
    """C5 on a tick that carries its process list (array of pid, name and
    loads): the name with the highest load, ties to the lowest pid."""
    best = F.array_max(F.transform(processes, lambda p: F.struct(
        F.coalesce(p[load], F.lit(0.0)).alias("load"), (-p["pid"]).alias("pid"),
        F.coalesce(p["name"], F.lit("unknown")).alias("name"))))
    return F.coalesce(best["name"], F.lit(empty_name))


def top_processes(processes: DataFrame, snapshots: DataFrame | None = None,
                  keys: Sequence[str] = ("hostname", "ts"), empty_name: str = "unknown") -> DataFrame:
    """C5 + C6: top process by CPU and by memory, and the process count, per snapshot.

    Load ties go to the lowest pid; a null load counts as 0 and a null name is
    reported as ``unknown``.  Snapshots without any process get
    (``empty_name``, 0) and a count of 0.  ``max_by`` aggregates partially
    before the shuffle, so a snapshot with millions of processes costs one
    row per map task.
    """
    keys = list(keys)
    name = F.coalesce(F.col("name"), F.lit("unknown"))

    def top(load: str) -> Column:
        order = F.struct(F.coalesce(F.col(load), F.lit(0.0)), -F.col("pid"))
        return F.max_by(F.struct(name.alias("name"), F.col("pid").alias("pid")), order)

    agg = processes.groupBy(*keys).agg(
        top("cpu_percent").alias("_cpu"), top("memory_percent").alias("_mem"),
        F.count(F.lit(1)).alias("process_count"))
    if snapshots is not None:
        agg = snapshots.select(*keys).distinct().join(agg, keys, "left")
    return agg.select(
        *keys,
        F.coalesce(F.col("_cpu.name"), F.lit(empty_name)).alias("top_cpu_process"),
        F.coalesce(F.col("_cpu.pid"), F.lit(0)).alias("top_cpu_pid"),
        F.coalesce(F.col("_mem.name"), F.lit(empty_name)).alias("top_mem_process"),
        F.coalesce(F.col("_mem.pid"), F.lit(0)).alias("top_mem_pid"),
        F.coalesce(F.col("process_count"), F.lit(0)).cast("int").alias("process_count"),
    )


def per_core_mean(arr: Column) -> Column:
    """Mean of the per-core readings, 0 when there are none."""
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    n = F.size(arr)
    return F.when(arr.isNull() | (n <= 0), F.lit(0.0)).otherwise(total / n)


def first_sensor(temps: Column, names: Sequence[str] = SENSOR_PRIORITY) -> Column:
    """First sensor present in the priority list, else 0 (2 digits)."""
    value = F.coalesce(*[F.element_at(temps, F.lit(n)) for n in names], F.lit(0.0))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value, 2))


def session_clock(df: DataFrame, session: str = "session_id",
                  boot_ts: str | None = None) -> DataFrame:
    """Elapsed seconds / minutes since session start, epoch seconds, uptime.

    The session start is a grouped ``min`` (partial aggregate) joined back.
    """
    starts = df.groupBy(session).agg(F.min("ts").alias("_start"))
    out = df.join(starts, session, "left")
    elapsed = (_micros("ts") - _micros("_start")) / F.lit(1e6)
    out = (out.withColumn("elapsed_seconds", elapsed)
           .withColumn("elapsed_minutes", F.round(elapsed / F.lit(60.0), 1))
           .withColumn("timestamp_seconds", _micros("ts") / F.lit(1e6)))
    if boot_ts:
        out = out.withColumn("system_uptime_seconds",
                             F.round((_micros("ts") - _micros(boot_ts)) / F.lit(1e6), 0))
    return out.drop("_start")


def sample_numbers(df: DataFrame, session: str = "session_id", name: str = "sample_number") -> DataFrame:
    """1-based sample number within a session (skew-safe ordered scan)."""
    return ordered_scan(df, [session], ["ts", "id"], row_number=name)


def every_nth(df: DataFrame, n: int = 100, col: str = "sample_number") -> DataFrame:
    """C17: rows whose sample number is a multiple of n."""
    return df.filter(F.pmod(F.col(col), F.lit(n)) == 0)


def session_summary(df: DataFrame, session: str = "session_id") -> DataFrame:
    """C14: samples, start, end, minutes, hours, samples per minute per session."""
    g = df.groupBy(session).agg(F.count(F.lit(1)).alias("samples"),
                                F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    secs = (_micros("end_time") - _micros("start_time")) / F.lit(1e6)
    minutes = secs / F.lit(60.0)
    return g.select(
        session, "samples", "start_time", "end_time",
        F.round(minutes, 1).alias("duration_minutes"),
        F.round(secs / F.lit(3600.0), 2).alias("duration_hours"),
        F.when(minutes > 0, F.round(F.col("samples") / minutes, 1)).otherwise(F.lit(0.0))
        .alias("samples_per_minute"),
    )


def state_distribution(df: DataFrame, state: str = "load_state",
                       key: str | None = "session_id") -> DataFrame:
    """Count and share of every state, zeros included, per key.

    Conditional counts in one aggregate give the zero rows without a join.
    """
    aggs = [F.count_if(F.col(state) == s).alias(f"{s.lower()}_count") for s in STATES]
    g = df.groupBy(key).agg(*aggs) if key else df.agg(*aggs)
    total = sum((F.col(f"{s.lower()}_count") for s in STATES), F.lit(0))
    pct = [F.when(total > 0, F.round(F.col(f"{s.lower()}_count") / total * 100.0, 1))
           .otherwise(F.lit(0.0)).alias(f"{s.lower()}_pct") for s in STATES]
    return g.select("*", *pct)


def _hms(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0)).cast("long")
    return F.concat(F.lpad((s / 3600).cast("long").cast("string"), 2, "0"), F.lit("h "),
                    F.lpad(F.pmod(s / 60, F.lit(60)).cast("long").cast("string"), 2, "0"),
                    F.lit("m "),
                    F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"), F.lit("s"))


def completeness(df: DataFrame, duration_s: float = 7200.0, interval_s: float = 1.0,
                 session: str = "session_id") -> DataFrame:
    """Expected vs actual samples, progress % and time remaining (hh mm ss)."""
    expected = int(duration_s / interval_s)
    g = df.groupBy(session).agg(F.count(F.lit(1)).alias("actual"))
    remaining = (F.lit(expected) - F.col("actual")) * F.lit(interval_s)
    return g.select(
        session, F.lit(expected).alias("expected"), "actual",
        F.round(F.col("actual") / F.lit(float(expected)) * 100.0, 1).alias("progress_pct"),
        _hms(remaining).alias("remaining"),
    )
