"""Declared schemas.  Files are always read with one of these, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

D = T.DoubleType()
I = T.IntegerType()
L = T.LongType()
S = T.StringType()
TS = T.TimestampType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# The 10 model features, in the reference's order.
FEATURES = [
    "cpu_percent", "cpu_frequency_mhz", "memory_percent", "memory_available_mb",
    "disk_percent", "disk_read_mbps", "disk_write_mbps",
    "network_upload_mbps", "network_download_mbps", "process_count",
]

# Labelled folder -> class.
LABEL_FOLDERS = {"normal": "Normal", "moderate": "Moderate", "high": "High", "high_load": "High"}

# The three load states, in display order.
STATES = ["Normal", "Moderate", "High"]

# Telemetry CSV written by the collector (24 columns, header, declared order).
TELEMETRY = _struct(
    ("timestamp", S), ("hostname", S),
    ("cpu_percent", D), ("cpu_frequency_mhz", D), ("memory_percent", D),
    ("memory_available_mb", D), ("disk_percent", D), ("disk_read_mbps", D),
    ("disk_write_mbps", D), ("network_upload_mbps", D), ("network_download_mbps", D),
    ("process_count", I), ("top_cpu_process", S), ("top_cpu_pid", I),
    ("top_mem_process", S), ("top_mem_pid", I),
    ("ssd_model", S), ("ssd_health_status", S), ("ssd_percentage_used", I),
    ("ssd_available_spare", I), ("ssd_temperature", I), ("ssd_data_written_tb", D),
    ("ssd_power_on_hours", I), ("ssd_media_errors", I),
)

# Moderate-session CSV (21 columns, ISO-8601 timestamp, no hostname).
MODERATE = _struct(
    ("timestamp", S), ("cpu_percent", D), ("cpu_frequency_mhz", D), ("cpu_per_core_avg", D),
    ("memory_percent", D), ("memory_available_mb", D), ("memory_used_mb", D),
    ("memory_total_mb", D), ("swap_percent", D), ("disk_percent", D),
    ("disk_read_mbps", D), ("disk_write_mbps", D), ("network_upload_mbps", D),
    ("network_download_mbps", D), ("process_count", I), ("load_state", S),
    ("cpu_temp_celsius", D), ("system_uptime_seconds", D), ("elapsed_minutes", D),
    ("sample_number", I), ("timestamp_seconds", D),
)

# Live log written once per tick (fixed column order).
LIVE_LOG_COLUMNS = ["cpu", "memory", "disk", "risk", "process_count",
                    "memory_available_mb", "timestamp", "top_cpu_process", "top_mem_process"]

# Calibration input: the four measures.
CALIBRATION_COLUMNS = ["cpu_percent", "memory_percent", "memory_available_mb", "disk_write_mbps"]
CALIBRATION = _struct(*[(c, D) for c in CALIBRATION_COLUMNS])

# Metric ingest request: five required typed fields.
METRIC_REQUEST_FIELDS = [("cpu_percent", D), ("memory_percent", D),
                         ("memory_available_mb", D), ("disk_write_mbps", D),
                         ("process_count", I)]

# One live tick: raw counters and the process list, before C2 and C5.
TICK = _struct(("system_id", S), ("id", L), ("ts", T.TimestampNTZType()), ("cpu_percent", D),
               ("memory_percent", D), ("memory_available_mb", D), ("disk_write_bytes", L),
               ("process_count", I),
               ("processes", T.ArrayType(_struct(("pid", I), ("name", S), ("cpu_percent", D),
                                                 ("memory_percent", D)))))
