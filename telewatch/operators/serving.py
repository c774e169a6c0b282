"""Serving queries over the metrics / predictions / alerts tables (Q1-Q15).

The reference answers these with ``ORDER BY id DESC LIMIT n`` on one host;
here every query is per ``system_id`` and runs over the whole history:

* latest row per system: ``max_by`` aggregate (partial aggregation before
  the shuffle, so a hot system costs one row per map task, not its history);
* last-N per system: ``row_number() <= N``, which Spark turns into a partial
  window-group-limit before the shuffle (again N rows per map task per key);
* date ranges are half-open ``[from, to + 1 day)`` predicates on ``ts``, which
  the parquet reader receives as pushed filters.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import risk as R
from .ordered import materialize, ordered_scan

DEFAULT_SYSTEM = "SYSTEM-01"
PAGE_SIZE = 20

# Columns of the history response (8-column projection of metrics).
HISTORY_COLUMNS = ["id", "ts", "system_id", "cpu_percent", "memory_percent",
                   "memory_available_mb", "disk_write_mbps", "process_count"]


def predictions(metrics: DataFrame, t: R.Thresholds = R.DEFAULT, keep: Sequence[str] = ()) -> DataFrame:
    """Stored prediction per metric row in rule mode (R1-R3, R6, R7; ledger L4);
    ``keep`` names further columns of the rows to carry along."""
    risk = R.risk_score()
    return metrics.select(
        *keep, "system_id", "id", "ts",
        risk.alias("risk_score"),
        R.stored_level(risk, t).alias("risk_level"),
        F.lit(0.95).alias("confidence"),
        F.lit(1).alias("votes"),
        R.stored_fault(risk, t).alias("fault_type"),
        F.lit("INFO").alias("severity_level"),
        F.lit("NORMAL").alias("pem_status"),
        F.lit("NORMAL").alias("md_status"),
        R.models_json(R.vote(risk, t)).alias("models_json"),
        R.probabilities_json(risk).alias("probabilities_json"),
    )


def rule_prediction(metrics: DataFrame, systems: DataFrame | None = None,
                    t: R.Thresholds = R.DEFAULT) -> DataFrame:
    """R5 (no model): the prediction served for the latest metric of each system.

    Risk has 3 digits, the class probabilities are 0 and the confidence is 0.
    ``systems`` lists the systems to report; one without any metric gets the
    no-data row (risk 0, NORMAL / NONE / INFO, no votes, empty maps).
    """
    latest = latest_per_system(stamp_system(metrics), ["id", "ts", "cpu_percent", "memory_percent"])
    if systems is not None:
        latest = systems.select("system_id").distinct().join(latest, "system_id", "left")
    risk, data = R.risk_score(), F.col("id").isNotNull()
    level = R.stored_level(risk, t)
    zero = F.lit(0.0)
    return latest.select(
        "system_id", F.col("ts").alias("metric_ts"),
        F.when(data, F.round(risk, 3)).otherwise(zero).alias("risk_score"),
        F.when(data, level).otherwise("NORMAL").alias("risk_level"),
        zero.alias("confidence"), F.when(data, 1).otherwise(0).alias("votes"),
        F.when(data, R.stored_fault(risk, t)).otherwise("NONE").alias("fault_type"),
        F.when(data, R.severity(level)).otherwise("INFO").alias("severity_level"),
        F.lit("NORMAL").alias("pem_status"), F.lit("NORMAL").alias("md_status"),
        F.when(data, F.create_map(F.lit("xgboost"), R.vote(risk, t).cast("int")))
        .otherwise(F.create_map().cast("map<string,int>")).alias("models"),
        F.when(data, F.create_map(F.lit("normal"), zero, F.lit("moderate"), zero, F.lit("high"), zero))
        .otherwise(F.create_map().cast("map<string,double>")).alias("probabilities"))


def stamp_system(df: DataFrame, default: str = DEFAULT_SYSTEM) -> DataFrame:
    """Every row carries a system id; missing ones get the default."""
    return df.withColumn("system_id", F.coalesce(F.col("system_id"), F.lit(default)))


def latest_per_system(df: DataFrame, columns: list[str], key: str = "system_id") -> DataFrame:
    """Q1: newest row per system by (ts, id) as one partial aggregate."""
    packed = F.max_by(F.struct(*[F.col(c) for c in columns]), F.struct("ts", "id"))
    return df.groupBy(key).agg(packed.alias("_latest")).select(key, "_latest.*")


def latest_metric(metrics: DataFrame) -> DataFrame:
    cols = [c for c in metrics.columns if c != "system_id"]
    return latest_per_system(stamp_system(metrics), cols)


def latest_status(predictions_df: DataFrame, systems: DataFrame | None = None) -> DataFrame:
    """Q2 + R20: latest (risk_level, fault_type, severity_level) per system.

    ``systems`` lists the systems to report; those without any prediction get
    the NORMAL / NONE / INFO defaults.
    """
    latest = latest_per_system(predictions_df, ["id", "ts", "risk_level", "fault_type",
                                                "severity_level"])
    if systems is None:
        base = latest
    else:
        base = systems.select("system_id").distinct().join(latest, "system_id", "left")
    return base.select(
        "system_id",
        F.coalesce("risk_level", F.lit("NORMAL")).alias("risk_level"),
        F.coalesce("fault_type", F.lit("NONE")).alias("fault_type"),
        F.coalesce("severity_level", F.lit("INFO")).alias("severity_level"),
    )


def newest(df: DataFrame, n: int = 20) -> DataFrame:
    """Q3: newest n rows overall, newest first (top-k is the feature)."""
    return df.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)


def last_n_per_system(df: DataFrame, n: int, key: str = "system_id") -> DataFrame:
    """Q4 / Q10: the last n rows of every system (ascending position column)."""
    w = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("id").desc())
    ranked = df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n)
    return ranked.withColumn("position", (F.lit(n + 1) - F.col("_rk")).cast("long")).drop("_rk")


def history(metrics: DataFrame, n: int = 100) -> DataFrame:
    """Q4: last 100 metrics per system, 8-column projection."""
    return last_n_per_system(metrics.select(*HISTORY_COLUMNS), n)


def risk_history(predictions_df: DataFrame, n: int = 30) -> DataFrame:
    """Q5: last 30 predictions per system with an HH:mm:ss label."""
    last = last_n_per_system(predictions_df, n)
    return last.select("system_id", "id", F.date_format("ts", "HH:mm:ss").alias("time"),
                       "risk_score", "risk_level", "fault_type", "position")


def _day(value) -> Column:
    if isinstance(value, (dt.date, dt.datetime)):
        value = value.strftime("%Y-%m-%d")
    return F.to_timestamp_ntz(F.lit(value))


def date_range(df: DataFrame, start: str | None = None, end: str | None = None,
               ts: str = "ts") -> DataFrame:
    """Q6: inclusive day range; either bound optional; end runs to day's end."""
    cond = F.lit(True)
    if start:
        cond = cond & (F.col(ts) >= _day(start))
    if end:
        cond = cond & (F.col(ts) < F.dateadd(_day(end), 1))
    return df.filter(cond)


def paginate(df: DataFrame, page_size: int = PAGE_SIZE, key: str = "system_id") -> DataFrame:
    """Q7: page number, row within page, and page count for every row.

    Positions and row counts come from the skew-safe ordered scan; pages =
    max(1, ceil(n / size)).
    """
    ranked = ordered_scan(df, [key], ["ts", "id"], row_number="_pos", key_count="_n")
    return (ranked.withColumn("page", F.ceil(F.col("_pos") / F.lit(page_size)).cast("long"))
            .withColumn("row_in_page", ((F.col("_pos") - 1) % F.lit(page_size) + 1).cast("long"))
            .withColumn("pages", page_count(F.col("_n"), page_size))
            .drop("_pos", "_n"))


def write_paged(metrics: DataFrame, path: str, page_size: int = PAGE_SIZE, key: str = "system_id") -> None:
    """Q7 by keyset, the store: ``rows`` sorted by (key, ts, id) over all files,
    and ``pages``, a row per page with the key of its first row.

    One ordered scan gives the positions.  Rows without a time have no place in
    the order and are left out.
    """
    scan = materialize(ordered_scan(metrics.where("ts IS NOT NULL"), [key], ["ts", "id"], row_number="_pos",
                                    key_count="_n"))
    (scan.drop("_pos", "_n").repartitionByRange(key, "ts", "id").sortWithinPartitions(key, "ts", "id")
     .write.mode("overwrite").parquet(f"{path}/rows"))
    (scan.where((F.col("_pos") - 1) % page_size == 0)
     .select(key, ((F.col("_pos") - 1) / page_size + 1).cast("long").alias("page"),
             page_count(F.col("_n"), page_size).alias("pages"), "ts", "id")
     .repartitionByRange(key, "page").sortWithinPartitions(key, "page")
     .write.mode("overwrite").parquet(f"{path}/pages"))


def read_page(spark: SparkSession, path: str, system, page: int, key: str = "system_id") -> DataFrame:
    """Q7 by keyset: the rows of one page, oldest first, with ``row_in_page`` and ``pages``.

    Two rows of the page index give the range of keys; the read of the rows is a
    pushed filter on it, which the row group statistics of the sorted files cut
    to about one row group, however deep the page.  A page that does not exist
    has no rows.
    """
    same = F.col(key).eqNullSafe(F.lit(system))
    index = spark.read.parquet(f"{path}/pages").where(same & F.col("page").isin(page, page + 1))
    found = {r["page"]: r for r in index.collect()}                # two rows at most
    rows = spark.read.parquet(f"{path}/rows").where(same)
    if page not in found:
        return rows.where(F.lit(False)).withColumns({"row_in_page": F.lit(0).cast("long"), "pages": F.lit(0).cast("long")})

    def time(r) -> Column:
        value = F.lit(r["ts"].strftime("%Y-%m-%d %H:%M:%S.%f"))
        return value.cast(spark.read.parquet(f"{path}/rows").schema["ts"].dataType)

    first, following = found[page], found.get(page + 1)
    rows = rows.where((F.col("ts") >= time(first)) & ((F.col("ts") > time(first)) | (F.col("id") >= first["id"])))
    if following is not None:
        rows = rows.where((F.col("ts") <= time(following))
                          & ((F.col("ts") < time(following)) | (F.col("id") < following["id"])))
    order = Window.partitionBy(key).orderBy("ts", "id")             # the rows of one page
    return rows.withColumns({"row_in_page": F.row_number().over(order).cast("long"),
                             "pages": F.lit(first["pages"]).cast("long")})


def page_count(n_rows: Column, page_size: int = PAGE_SIZE) -> Column:
    return F.greatest(F.lit(1), F.ceil(n_rows / F.lit(page_size))).cast("long")


def report(metrics: DataFrame, key: str | None = "system_id",
           t: R.Thresholds = R.DEFAULT) -> DataFrame:
    """Q8: totals, anomalies, healthy share and mean measures, 0 when empty."""
    anomaly = R.is_anomaly(t=t)
    n = F.count(F.lit(1))
    aggs = [
        n.alias("total"),
        F.count_if(anomaly).alias("anomalies"),
        F.avg("cpu_percent").alias("_cpu"),
        F.avg("memory_percent").alias("_mem"),
        F.avg("disk_write_mbps").alias("_disk"),
    ]
    grouped = metrics.groupBy(key).agg(*aggs) if key else metrics.agg(*aggs)
    total = F.col("total")
    zero = total == 0
    out = grouped.select(
        *([key] if key else []),
        total,
        F.col("anomalies"),
        (total - F.col("anomalies")).alias("healthy"),
        F.when(zero, 0.0).otherwise(
            F.round((total - F.col("anomalies")) / total * 100.0, 1)).alias("healthy_pct"),
        F.when(zero, 0.0).otherwise(F.round("_cpu", 1)).alias("avg_cpu"),
        F.when(zero, 0.0).otherwise(F.round("_mem", 1)).alias("avg_memory"),
        F.when(zero, 0.0).otherwise(F.round("_disk", 2)).alias("avg_disk"),
    )
    return out


def alert_status(alerts: DataFrame, drop_resolved: bool = False) -> DataFrame:
    """Q9: Resolved / Active from resolved_at; optionally keep only active."""
    out = alerts.withColumn("status", F.when(F.col("resolved_at").isNull(), "Active")
                            .otherwise("Resolved"))
    return out.filter(F.col("resolved_at").isNull()) if drop_resolved else out


def trend(df: DataFrame, n: int = 20) -> DataFrame:
    """Q10 + Q11: last n points per system as a chart series."""
    last = last_n_per_system(df, n)
    risk_cols = [c for c in ("risk_score", "risk") if c in df.columns]
    risk = F.coalesce(*[F.col(c) for c in risk_cols], F.lit(0.0)) if risk_cols else F.lit(0.0)
    return last.select(
        "system_id", "id", "position",
        F.date_format("ts", "HH:mm").alias("time"),
        F.round("cpu_percent", 1).alias("cpu"),
        F.round("memory_percent", 1).alias("memory"),
        risk.alias("risk"),
    )


def normalise_packet(packets: DataFrame, json_col: str = "value") -> DataFrame:
    """Q12: live packet JSON -> metric row; missing disk/process/memory -> 0."""
    schema = ("cpu double, memory double, disk double, risk double, process_count int, "
              "memory_available_mb int, top_cpu_process string, top_mem_process string, "
              "timestamp string")
    p = F.from_json(F.col(json_col), schema)
    return packets.select(*[c for c in packets.columns if c != json_col], p.alias("_p")).select(
        *[c for c in packets.columns if c != json_col],
        F.col("_p.cpu").alias("cpu_percent"),
        F.col("_p.memory").alias("memory_percent"),
        F.coalesce(F.col("_p.disk"), F.lit(0.0)).alias("disk_write_mbps"),
        F.coalesce(F.col("_p.process_count"), F.lit(0)).alias("process_count"),
        F.coalesce(F.col("_p.memory_available_mb"), F.lit(0)).alias("memory_available_mb"),
        F.col("_p.risk").alias("risk"),
        F.col("_p.top_cpu_process").alias("top_cpu_process"),
        F.col("_p.top_mem_process").alias("top_mem_process"),
    )


# Request fields defaulted to 0 by the client (Q13).
REQUEST_FIELDS = ["cpu_percent", "memory_percent", "disk_read_mbps", "disk_write_mbps",
                  "network_upload_mbps", "network_download_mbps", "process_count",
                  "ssd_percentage_used"]


def feature_defaults(df: DataFrame, host_default: str = "system-01") -> DataFrame:
    """Q13: null / NaN / empty request fields become 0; host and time defaulted."""
    out = []
    for name in REQUEST_FIELDS:
        if name in df.columns:
            c = F.col(name).try_cast("double")
            out.append(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)).alias(name))
        else:
            out.append(F.lit(0.0).alias(name))
    host = F.coalesce(F.nullif(F.col("hostname"), F.lit("")), F.lit(host_default)) \
        if "hostname" in df.columns else F.lit(host_default)
    when = F.coalesce(F.col("ts"), F.current_timestamp()) if "ts" in df.columns \
        else F.current_timestamp()
    keep = [c for c in df.columns if c not in REQUEST_FIELDS + ["hostname", "ts"]]
    return df.select(*keep, host.alias("hostname"), when.alias("ts"), *out)


def validate_requests(raw: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """Q14: typed parse of required fields; rows failing any are quarantined.

    Returns the typed columns plus ``accepted`` (bool) and ``missing`` (array of
    field names that were absent or not parseable).
    """
    typed = [F.col(n).try_cast(t).alias(n) for n, t in fields]
    bad = F.array_compact(F.array(*[F.when(F.col(n).try_cast(t).isNull(), F.lit(n))
                                    for n, t in fields]))
    keep = [c for c in raw.columns if c not in dict(fields)]
    return raw.select(*keep, *typed, bad.alias("missing")).withColumn(
        "accepted", F.size("missing") == 0)


def request_metrics(validated: DataFrame) -> DataFrame:
    """S9 by request: accepted requests as metric rows, stored as sent (not rounded)."""
    rows = validated.filter("accepted")
    if "system_id" not in rows.columns:
        rows = rows.withColumn("system_id", F.lit(None).cast("string"))
    return stamp_system(rows).drop("accepted", "missing")


def panel(metrics: DataFrame, predictions_df: DataFrame) -> DataFrame:
    """Q15: latest prediction x latest metric x latest status, per system."""
    lm = latest_per_system(metrics, ["id", "ts", "cpu_percent", "memory_percent",
                                     "disk_write_mbps"]) \
        .withColumnsRenamed({"id": "metric_id", "ts": "metric_ts"})
    lp = latest_per_system(predictions_df, ["id", "ts", "risk_score", "risk_level", "fault_type",
                                            "severity_level"]) \
        .withColumnsRenamed({"id": "prediction_id", "ts": "prediction_ts"})
    st = latest_status(predictions_df).withColumnsRenamed(
        {"risk_level": "status_level", "fault_type": "status_fault",
         "severity_level": "status_severity"})
    return lm.join(lp, "system_id").join(st, "system_id")
