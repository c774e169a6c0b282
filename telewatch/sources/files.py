"""CSV sources (S1-S4) and the per-file schema guard.

Files are never schema-inferred and columns are never taken by position: the
first record of every file names its columns, which may differ in order and
number between files.  Records are read by byte range (``ranged``), quoted line
breaks included, and their fields are looked up through the header of their own
file.  The header index is written once (one row per file, a few KB read of
each); no file list comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import materialize
from ..schemas import CALIBRATION, FEATURES, LABEL_FOLDERS, MODERATE, TELEMETRY
from . import ranged


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def schema_guard(spark: SparkSession, paths: Sequence[str] | str,
                 required: Sequence[str] = FEATURES, nested: bool = False) -> DataFrame:
    """``file, size, columns, missing`` of every file, from its first record;
    ``missing`` holds the required columns it lacks (empty = accepted)."""
    req = F.array(*[F.lit(c) for c in required])
    found = ranged.headers(spark, ranged.csv_files(spark, paths, nested))
    return materialize(found.withColumn("missing", F.array_except(req, F.col("columns"))))


def read_by_name(spark: SparkSession, paths: Sequence[str] | str, schema: T.StructType,
                 guard: DataFrame | None = None) -> DataFrame:
    """Records of CSV files typed by ``schema`` by column name.

    A column that a file lacks, and a value that does not parse, is null; other
    columns of a file are ignored; of columns with one name the first counts.
    ``guard`` limits the read to its files; else all ``.csv`` files in and below
    ``paths`` are read.  Adds ``source_file`` and ``place``, the byte of the file
    a record starts at.  Quoted fields may hold commas, doubled quotes and line
    breaks.
    """
    known = schema_guard(spark, paths, (), nested=True) if guard is None else guard
    width = known.agg(F.max(F.size("columns"))).first()[0] or 1
    names = [f"c{i}" for i in range(width)]
    fields = F.from_csv("record", ", ".join(f"{n} string" for n in names), {"escape": '"'})
    rows = (ranged.csv_records(spark, known)
            .join(known.select(F.col("file").alias("source_file"), "columns"), "source_file")
            .withColumn("_f", fields)
            .withColumn("_v", F.array(*[F.col(f"_f.{n}") for n in names])))
    return rows.select(
        *[F.get("_v", F.array_position("columns", f.name).cast("int") - 1).try_cast(f.dataType).alias(f.name)
          for f in schema.fields], "source_file", "place")


def read_labelled(spark: SparkSession, base: str, folders: dict[str, str] = LABEL_FOLDERS,
                  required: Sequence[str] = FEATURES,
                  schema: T.StructType = TELEMETRY) -> tuple[DataFrame, DataFrame]:
    """S1 + D1-D4: labelled-folder scan.

    Returns ``(rows, rejected)``: the feature rows of every accepted file with
    ``label``, ``source_file`` and ``place`` (the byte a row starts at); and
    ``(file, missing)`` for skipped files.  The ``.csv`` files of the folders
    themselves are read, not those of folders inside them; missing folders are
    skipped.
    """
    present = [f"{base.rstrip('/')}/{folder}" for folder in folders
               if exists(spark, f"{base.rstrip('/')}/{folder}")]
    if not present:
        raise FileNotFoundError(f"no labelled folders under {base}")
    guard = schema_guard(spark, present, required)
    rejected = guard.filter(F.size("missing") > 0).select("file", "missing")
    wanted = T.StructType([f for f in schema.fields if f.name in required])
    rows = read_by_name(spark, present, wanted, guard.filter(F.size("missing") == 0))
    label_map = F.create_map(*[F.lit(x) for kv in folders.items() for x in kv])
    folder = F.regexp_extract("source_file", r"/([^/]+)/[^/]+$", 1)
    return (rows.select(*required, "source_file", "place", label_map[folder].alias("label")),
            rejected)


def read_telemetry_csv(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Collector CSV (24 columns) with its declared types, by name."""
    df = read_by_name(spark, paths, TELEMETRY).drop("source_file", "place")
    return df.withColumn("ts", F.to_timestamp_ntz("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")))


def read_moderate_csv(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """S3: moderate-session CSV (21 columns) with ISO-8601 timestamps, by name."""
    df = read_by_name(spark, paths, MODERATE).drop("source_file", "place")
    return df.withColumn("ts", F.to_timestamp_ntz("timestamp"))


def read_calibration_csv(spark: SparkSession, paths: Sequence[str] | str,
                         keys: Sequence[str] = ()) -> DataFrame:
    """The four calibration measures of a live-data CSV, declared types, by
    name; ``keys`` are read as text and other columns of the log ignored."""
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys] + CALIBRATION.fields)
    return read_by_name(spark, paths, schema).drop("source_file", "place")
