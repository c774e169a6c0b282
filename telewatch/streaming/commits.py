"""Append-only sinks of a stream with one commit per micro-batch.

A batch writes its rows to a folder of its own per sink, named by query and
batch (a retried batch replaces them), and is committed by one marker file
after all sinks are written.  Readers take the batches up to the last commit,
so they see every sink at the same batch, and a batch in work changes nothing
they see.  A batch never reads what earlier batches wrote.

``compact`` merges runs of 16 committed batches, and runs of 16 such runs, so
a reader opens few folders and a row is rewritten once per level.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LIVE_LOG_COLUMNS

RUN = 16
TICK_KEYS = ["system_id", "id"]
#: The live log is CSV text: nine fixed columns, then the key and revision of the tick.
LOG_SCHEMA = ", ".join(f"{c} string" for c in LIVE_LOG_COLUMNS) + ", system_id string, id long, rev int"
REVISED = ("metrics", "predictions", "packets", "live_log")


def query_id(batch: DataFrame) -> str:
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "query"


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, place = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def _mark(spark: SparkSession, path: str) -> None:
    fs, place = _fs(spark, path)
    fs.create(place, True).close()


class Sinks:
    """The sinks of one query under ``out``."""

    def __init__(self, spark: SparkSession, out: str, query: str):
        self.spark, self.base = spark, os.path.join(out, f"query_id={query}")

    def _path(self, *parts: str) -> str:
        return os.path.join(self.base, *parts)

    def _write(self, df: DataFrame, path: str, csv: bool) -> None:
        w = df.write.mode("overwrite")
        (w.option("header", True).csv(path) if csv else w.parquet(path))

    def write(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        """Rows of a batch for one sink; read them back from the returned frame."""
        path = self._path(name, f"batch_id={batch_id}")
        self._write(df, path, name == "live_log")
        return self.spark.read.schema(df.schema).parquet(path) if name != "live_log" else df

    def commit(self, batch_id: int) -> None:
        """Make the batch visible in all sinks at once; call it last."""
        _mark(self.spark, self._path("commits", f"{batch_id:012d}"))

    def committed(self) -> int:
        """Batches committed so far (they count from 0)."""
        names = [n for n in _names(self.spark, self._path("commits")) if n.isdigit()]
        return int(names[-1]) + 1 if names else 0

    def _spans(self, batches: int) -> list[tuple[int, int]]:
        """``[from, to)`` of the merged runs that cover the first ``batches`` batches
        up to the last multiple of ``RUN``, longest first."""
        out, at, size = [], 0, RUN
        while size * RUN <= batches:
            size *= RUN
        while size >= RUN:
            while at + size <= batches:
                out.append((at, at + size))
                at += size
            size //= RUN
        return out

    def paths(self, name: str) -> list[str]:
        merged = [n for n in _names(self.spark, self._path("compactions")) if n.isdigit()]
        spans = self._spans(int(merged[-1])) if merged else []
        done = spans[-1][1] if spans else 0
        return [self._path(name, f"batches={a}-{b}") for a, b in spans] + [
            self._path(name, f"batch_id={b}") for b in range(done, self.committed())]

    def _load(self, name: str, paths: list[str]) -> DataFrame | None:
        paths = [p for p in paths if _fs(self.spark, p)[0].exists(_fs(self.spark, p)[1])]
        if not paths:
            return None
        if name == "live_log":
            return self.spark.read.option("header", True).schema(LOG_SCHEMA).csv(paths)
        return self.spark.read.parquet(*paths)

    def read(self, name: str) -> DataFrame | None:
        """All committed rows of a sink, revisions and retractions included."""
        return self._load(name, self.paths(name))

    def compact(self, names=("metrics", "predictions", "packets", "live_log", "alerts", "aside")) -> None:
        """Merge committed batches for readers; run it beside the stream or after it.

        Folders of merged batches stay (a reader may be in them); they can be
        deleted once no reader is older than the compaction.
        """
        total = self.committed() // RUN * RUN
        for size in (RUN ** k for k in range(1, 16) if RUN ** k <= total):
            for a in range(0, total - size + 1, size):
                child = size // RUN
                parts = [f"batch_id={b}" if child == 1 else f"batches={b}-{b + child}" for b in range(a, a + size, child)]
                for name in names:
                    target = self._path(name, f"batches={a}-{a + size}")
                    if "_SUCCESS" in _names(self.spark, target):
                        continue
                    rows = self._load(name, [self._path(name, p) for p in parts])
                    if rows is not None:
                        self._write(rows, target, name == "live_log")
        _mark(self.spark, self._path("compactions", f"{total:012d}"))


def queries_of(spark: SparkSession, out: str) -> list[str]:
    return [n.split("=", 1)[1] for n in _names(spark, out) if n.startswith("query_id=")]


def read_sink(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The current rows of a sink: of a tick its last revision, of an alert what
    was not taken back.  Nothing is shuffled but the revised keys."""
    found = [(q, Sinks(spark, out, q).read(name)) for q in queries_of(spark, out)]
    frames = [df.withColumn("_query", F.lit(q)) for q, df in found if df is not None]
    if not frames:
        raise FileNotFoundError(f"no committed batch of {name} under {out}")
    rows = reduce(DataFrame.unionByName, frames)
    if name == "alerts":
        keys = [c for c in rows.columns if c not in ("sign",)]
        return rows.groupBy(keys).agg(F.sum("sign").alias("_net")).where("_net > 0").drop("_net", "_query")
    if name not in REVISED:
        return rows.drop("_query")
    last = (rows.where("rev > 0").groupBy("_query", *TICK_KEYS).agg(F.max("rev").alias("_last"))
            .withColumnsRenamed({c: f"_{c}" for c in ("_query", *TICK_KEYS)}))
    same = F.lit(True)
    for c in ("_query", *TICK_KEYS):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    current = rows.join(last, same, "left").where(F.col("_last").isNull() | (F.col("rev") == F.col("_last")))
    return current.select(LIVE_LOG_COLUMNS if name == "live_log" else [c for c in rows.columns if c not in ("_query", "rev")])
