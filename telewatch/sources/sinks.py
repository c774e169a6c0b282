"""Sinks: live packets, live log, session files, tables and exports."""

from __future__ import annotations

import csv
import io
import os
import re
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import risk as R
from ..operators.ordered import materialize, ordered_scan
from ..schemas import LIVE_LOG_COLUMNS

MIB = 1048576.0


def packet_struct(df: DataFrame) -> Column:
    """The 9-field live packet (rounding 1 / 1 / 2 / 3, ints truncated)."""
    risk = R.risk_score()
    return F.struct(
        F.round("cpu_percent", 1).alias("cpu"),
        F.round("memory_percent", 1).alias("memory"),
        F.round("disk_write_mbps", 2).alias("disk"),
        F.round(risk, 3).alias("risk"),
        F.col("process_count").cast("int").alias("process_count"),
        (F.col("memory_available_bytes") / F.lit(MIB)).cast("int").alias("memory_available_mb"),
        F.col("top_cpu_process"),
        F.col("top_mem_process"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
    )


def live_packets(df: DataFrame, keys=("system_id", "id")) -> DataFrame:
    """One JSON packet per tick in ``value`` next to its keys."""
    if "top_cpu_process" not in df.columns:
        df = df.withColumn("top_cpu_process", F.col("process_name"))
    if "top_mem_process" not in df.columns:
        df = df.withColumn("top_mem_process", F.col("process_name"))
    return df.select(*keys, F.to_json(packet_struct(df)).alias("value"))


def live_log_rows(packets: DataFrame, keys=()) -> DataFrame:
    """Packet fields in the fixed log order; absent values become ''."""
    schema = ("cpu double, memory double, disk double, risk double, process_count int, "
              "memory_available_mb int, timestamp string, top_cpu_process string, "
              "top_mem_process string")
    p = F.from_json("value", schema)
    return packets.select(*keys, *[F.coalesce(p[c].cast("string"), F.lit("")).alias(c)
                                   for c in LIVE_LOG_COLUMNS])


def write_session_files(df: DataFrame, path: str, mode: str = "overwrite",
                        host: str = "hostname", session: str = "session_id",
                        order: str = "timestamp") -> None:
    """One CSV folder per host and session, with header.

    The files keep the collector columns (hostname included); the folders are
    named by the host and session keys, as Spark's partitioned writer names
    them.  Rows are range-partitioned on (host, session, time) first: each task
    writes a contiguous run of sessions (few open files, few small files), and a
    very large session is cut by time across several tasks instead of landing in
    one.  ``mode`` is that of a Spark writer.

    Tasks write the files where they belong, each under a hidden name until it
    is whole, so nothing is moved one by one on the driver; a task that runs
    again replaces its files by equal ones.  ``_SUCCESS`` follows when all are
    written.
    """
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if mode in ("ignore", "error", "errorifexists") and fs.exists(at):
        if mode == "ignore":
            return
        raise FileExistsError(f"{path} exists")
    if mode == "overwrite":
        fs.delete(at, True)
    folder, run = _qualified(spark, path), uuid.uuid4().hex
    columns = [c for c in df.columns if c != session]
    keys = ["_host", "_session"]
    out = df.select(F.col(host).cast("string").alias("_host"), F.col(session).cast("string").alias("_session"),
                    (F.col(order) if order in df.columns else F.lit(None).cast("string")).alias("_at"),
                    F.to_csv(F.struct(*columns)).alias("_line"))
    # a number of its own: adaptive execution would leave all files to a few tasks
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = out.repartitionByRange(parts, *keys, "_at").sortWithinPartitions(*keys, "_at").select(*keys, "_line")

    def write(batches):
        out, key, n = None, None, 0
        name = f"part-{TaskContext.get().partitionId():05d}-{run}.csv"
        try:
            for batch in batches:
                for h, s, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or key != (h, s):
                        if out is not None:
                            whole, out = out, None
                            whole.finish()
                        key, n = (h, s), n + 1
                        out = _OneFile(f"{folder}/host={_folder_value(h)}/session={_folder_value(s)}", name, columns, True)
                    out.text.write(line + "\n")
            if out is not None:
                whole, out = out, None
                whole.finish()
        except BaseException:
            if out is not None:
                out.drop()
            raise
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    rows.mapInArrow(write, "files long").agg(F.sum("files")).first()
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"), True).close()


def _folder_value(value: str | None) -> str:
    """A key in the name of a folder, escaped as Spark does."""
    if not value:
        return "__HIVE_DEFAULT_PARTITION__"
    return re.sub("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]", lambda m: f"%{ord(m[0]):02X}", value)


ROWS_PER_FILE = 5_000_000


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme; the folder is made if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    return fs.makeQualified(at).toString().rstrip("/")


class _OneFile:
    """A CSV file that appears under its name when it is whole: written beside
    it under a name of this attempt, then moved, so a task that is repeated or
    runs twice replaces the file by an equal one."""

    def __init__(self, folder: str, name: str, columns: list[str], make: bool = False):
        self.rows, self.name, self.fs = 0, name, None
        attempt = f".{uuid.uuid4().hex}"
        if folder.startswith("file:"):
            base = re.sub(r"^file:/+", "/", folder)
            self.temp, self.path = f"{base}/{attempt}", f"{base}/{name}"
            if make:
                os.makedirs(base, exist_ok=True)
            self.raw = open(self.temp, "wb")
        else:                                              # hdfs, s3, gs, abfs
            from pyarrow.fs import FileSystem
            self.fs, base = FileSystem.from_uri(quote(folder, safe=":/@"))
            self.temp, self.path = f"{base}/{attempt}", f"{base}/{name}"
            if make:
                self.fs.create_dir(base, recursive=True)
            self.raw = self.fs.open_output_stream(self.temp)
        self.text = io.TextIOWrapper(self.raw, "utf-8", newline="")
        self.csv = csv.writer(self.text, lineterminator="\n" if make else "\r\n")
        self.csv.writerow(columns)

    def write(self, batch: pa.RecordBatch):
        self.csv.writerows(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        self.rows += batch.num_rows

    def finish(self):
        self.text.close()
        if self.fs is None:
            os.replace(self.temp, self.path)
        else:
            self.fs.move(self.temp, self.path)

    def drop(self):
        self.text.close()
        if self.fs is None:
            os.remove(self.temp)
        else:
            self.fs.delete_file(self.temp)


def write_collection_files(df: DataFrame, path: str, host: str = "hostname", session: str = "session_id",
                           order: str = "timestamp", rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """One CSV file with a header per host and collection run, named
    ``<host>_<yyyyMMdd_HHmmss>.csv`` by the run's first timestamp.

    Returns the manifest ``(file, n_rows)``, a row per file, once all are
    written.  All columns but ``session`` are written, in their order, rows by
    ``order``.  Files of the folder with other names stay, one of the same name
    is replaced.

    Shape: rows are numbered per run by an ordered scan, so a run beyond
    ``rows_per_file`` goes on in a further file, as after a restart, and no task
    holds more than its files; one shuffle by file, sorted inside, streamed to
    the file by the task that has it.

    Edge cases: runs of a host that begin in the same second, and further files
    of a run that do, get ``_2``, ``_3``, ... in the order of (session, part); a null host is
    ``unknown``, a run without a timestamp that parses is ``undated``;
    characters of a host that cannot be in a name are percent-encoded; nulls are
    empty fields; an empty frame writes no file.
    """
    spark = df.sparkSession
    folder = _qualified(spark, path)
    columns = [c for c in df.columns if c != session]
    keys = [host, session]
    parts = ordered_scan(df, keys, [order], row_number="_row").withColumn(
        "_part", F.floor((F.col("_row") - 1) / F.lit(rows_per_file)))
    starts = parts.groupBy(*keys, "_part").agg(F.min(F.col(order).try_cast("timestamp_ntz")).alias("_start"))
    stem = F.concat(F.url_encode(F.coalesce(F.col(host).cast("string"), F.lit("unknown"))), F.lit("_"),
                    F.coalesce(F.date_format("_start", "yyyyMMdd_HHmmss"), F.lit("undated")))
    again = F.row_number().over(Window.partitionBy("_stem").orderBy(F.col("_host"), F.col("_session"), F.col("_p")))
    named = materialize(
        starts.select(F.col(host).alias("_host"), F.col(session).alias("_session"), F.col("_part").alias("_p"),
                      stem.alias("_stem"))
        .withColumn("_n", again)
        .select("_host", "_session", "_p", F.concat("_stem", F.when(F.col("_n") > 1, F.concat(
            F.lit("_"), F.col("_n").cast("string"))).otherwise(F.lit("")), F.lit(".csv")).alias("_file")))
    same = (F.col(host).eqNullSafe(F.col("_host")) & F.col(session).eqNullSafe(F.col("_session"))
            & (F.col("_part") == F.col("_p")))
    rows = (parts.join(named, same)
            .select("_file", "_row", *[F.col(c).cast("string").alias(c) for c in columns])
            .repartition("_file").sortWithinPartitions("_file", "_row"))

    def write(batches):
        out, done = None, []
        try:
            for batch in batches:
                names = batch.column(0).to_pylist()
                at = 0
                while at < len(names):
                    end = at + 1
                    while end < len(names) and names[end] == names[at]:
                        end += 1
                    if out is None or out.name != names[at]:
                        if out is not None:
                            whole, out = out, None
                            whole.finish()
                            done.append((whole.name, whole.rows))
                        out = _OneFile(folder, names[at], columns)
                    out.write(batch.slice(at, end - at).select(columns))
                    at = end
            if out is not None:
                whole, out = out, None
                whole.finish()
                done.append((whole.name, whole.rows))
        except BaseException:
            if out is not None:
                out.drop()
            raise
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()),
                                          pa.array([r for _, r in done], pa.int64())], names=["file", "n_rows"])

    return materialize(rows.mapInArrow(write, "file string, n_rows long"))


def write_table(df: DataFrame, path: str, mode: str = "append",
                partition_by: list[str] | None = None) -> None:
    """Parquet tables, append-only by default."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def report_export(metrics: DataFrame) -> DataFrame:
    """The report CSV projection: Timestamp, CPU, Memory, Disk Write."""
    return metrics.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("Timestamp"),
        F.col("cpu_percent").alias("CPU"),
        F.col("memory_percent").alias("Memory"),
        F.col("disk_write_mbps").alias("Disk Write"),
    )
