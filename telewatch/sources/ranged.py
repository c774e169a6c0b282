"""CSV records by byte range, with quoted line breaks, and the headers of files.

A file is cut into ranges of bytes; a record belongs to the range its first
byte is in, and the task of that range reads on to the record's end.  Whether a
line break ends a record depends on the quotes before it: files of more than
one range are first counted for quotes, range by range, and a prefix scan over
these counts (one row per range) says whether a range begins inside a quoted
field.  Files of one range are read once.  A record is placed by the byte it
starts at, so nothing depends on how a scan was cut.

Headers are read by opening each file and reading its first record only.
"""

from __future__ import annotations

import csv
import io
import os
import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import materialize

RANGE_BYTES_CONF = "telewatch.csv.rangeBytes"
RANGE_BYTES = 1 << 26
CHUNK = 1 << 22              # bytes held at once by a task, besides one record
HEAD = 1 << 12               # bytes read first for a header
PER_BATCH = 8_192            # records per Arrow batch
FILES_PER_TASK = 256         # headers, or ranges of small files, read by one task


def open_file(path: str):
    """A file by its Spark path, open for reads at any place.  Local paths are
    opened as they are, others through pyarrow (hdfs, s3, gs, abfs)."""
    if path.startswith("file:"):
        return open(re.sub(r"^file:/+", "/", path), "rb")
    from pyarrow.fs import FileSystem
    fs, name = FileSystem.from_uri(quote(path, safe=":/@"))
    return fs.open_input_file(name)


def csv_files(spark: SparkSession, paths: Sequence[str] | str, nested: bool = False) -> DataFrame:
    """``file, size`` of the ``.csv`` files in the folders (or below them, if
    ``nested``), or of the files themselves; names only, no content is read.

    A task lists the folders given, further ones the folders in them; names that
    Spark takes for hidden are left out, as are empty files.
    """
    found = []
    for path in [paths] if isinstance(paths, str) else paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        here = fs.globStatus(at)
        if not here:
            raise FileNotFoundError(path)
        found += [(s.getPath().toString(), FOLDER if s.isDirectory() else s.getLen()) for s in here]
    schema = "file string, size long"
    entries = spark.createDataFrame(found, schema).coalesce(1).mapInArrow(_listed(False), schema)
    if nested:
        entries = materialize(entries)
        folders = entries.where(F.col("size") == FOLDER)
        tasks = max(1, -(-folders.count() // FILES_PER_TASK))
        entries = entries.where(F.col("size") != FOLDER).unionByName(
            folders.repartition(tasks, "file").mapInArrow(_listed(True), schema))
    return entries.where((F.col("size") > 0) & F.col("file").endswith(".csv"))


FOLDER = -1                  # stands for the size of a folder


def _children(folder: str) -> Iterator[tuple[str, int]]:
    """``(path, size)`` of what a folder holds, hidden names left out."""
    if folder.startswith("file:"):
        with os.scandir(re.sub(r"^file:/+", "/", folder)) as held:
            found = [(e.name, FOLDER if e.is_dir() else e.stat().st_size) for e in held]
    else:
        from pyarrow.fs import FileSelector, FileSystem, FileType
        fs, base = FileSystem.from_uri(quote(folder, safe=":/@"))
        found = [(i.base_name, FOLDER if i.type == FileType.Directory else i.size) for i in fs.get_file_info(FileSelector(base))]
    for name, size in found:
        if not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")):
            yield f"{folder.rstrip('/')}/{name}", size


def _listed(nested: bool):
    def run(batches):
        out = []
        for batch in batches:
            todo = [(path, size, True) for path, size in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            while todo:
                path, size, into = todo.pop()
                if size == FOLDER and into:
                    todo += [(*child, nested) for child in _children(path)]
                else:
                    out.append((path, size))
                if len(out) >= PER_BATCH:
                    yield _entries(out)
                    out = []
        yield _entries(out)
    return run


def _entries(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())],
                                      names=["file", "size"])


def _ends(data: bytes, inside: bool):
    """Places behind the line breaks of ``data`` that end a record, and whether
    its end lies inside a quoted field."""
    import numpy as np
    raw = np.frombuffer(data, np.uint8)
    breaks = np.flatnonzero(raw == 10)
    marks = np.flatnonzero(raw == 34)
    odd = (np.searchsorted(marks, breaks) + inside) % 2 == 1
    return breaks[~odd] + 1, (len(marks) + inside) % 2 == 1


def records_of(f, start: int, stop: int, inside: bool) -> Iterator[tuple[int, bytes]]:
    """``(place, record)`` of the records that start in ``[start, stop)`` of an
    open file, without their line break; ``inside`` tells whether ``start`` is in
    a quoted field.  A record that began before ``start`` is passed over."""
    first = start == 0
    if not first:
        f.seek(start - 1)
        first = f.read(1) == b"\n" and not inside
    f.seek(start)
    at, held = start, b""
    while True:
        data = f.read(CHUNK)
        ends, inside = _ends(data, inside)
        done = 0
        for end in ends.tolist():
            if first:
                if at >= stop:
                    return
                yield at, (held + data[done:end]).rstrip(b"\r\n")
            at, first = at + len(held) + end - done, True
            held, done = b"", end
        held += data[done:]
        if first and at >= stop:
            return
        if len(data) < CHUNK:
            if first and held:
                yield at, held.rstrip(b"\r\n")
            return


def header_of(f) -> list[str]:
    """Column names of an open file: the fields of its first record."""
    data, size = b"", HEAD
    while True:
        more = f.read(size)
        data, size = data + more, size * 2
        ends, _ = _ends(data, False)
        if len(ends) or not more:
            break
    text = data[:ends[0]] if len(ends) else data
    fields = next(csv.reader(io.StringIO(text.decode("utf-8-sig", "replace"), newline="")), [])
    return [c.strip() for c in fields]


def headers(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``file, size, columns`` of the files: a few KB of each are read."""
    def read(batches):
        for batch in batches:
            names = []
            for path in batch.column(0).to_pylist():
                with open_file(path) as f:
                    names.append(header_of(f))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.list_(pa.string()))],
                                             names=["file", "size", "columns"])

    files = materialize(files)                     # listed once; a small file costs a task as much as a large one
    n = files.count()
    dealt = files.repartition(max(1, -(-n // FILES_PER_TASK)), "file")
    return dealt.mapInArrow(read, "file string, size long, columns array<string>")


def range_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get(RANGE_BYTES_CONF, None) or RANGE_BYTES)


def _with_quotes(spark: SparkSession, ranges: DataFrame, step: int) -> DataFrame:
    """``ranges`` with ``inside``: the quotes of the file before them, modulo 2."""
    def count(batches):
        for batch in batches:
            odd = []
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, left = 0, step
                with open_file(path) as f:
                    f.seek(at)
                    while left > 0 and (data := f.read(min(left, CHUNK))):
                        n, left = n + data.count(b'"'), left - len(data)
                odd.append(n % 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(odd, pa.int64())],
                                             names=["file", "at", "odd"])

    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counted = ranges.where(F.col("size") > step).select("file", "at").mapInArrow(count, "file string, at long, odd long")
    parity = counted.select("file", "at", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    return ranges.join(parity, ["file", "at"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def csv_records(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``source_file, place, record`` of every record behind the header of the
    files ``(file, size)``; ``place`` is the byte a record starts at.

    Blank records are left out.  A range is one task's work at most, whatever
    the size of its file; a task holds a few MB and one record.
    """
    step = range_bytes(spark)
    ranges = files.select("file", "size", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))).alias("at"))
    n, total = files.agg(F.sum(F.ceil(F.col("size") / step)), F.sum("size")).first()
    n, total = n or 1, total or 0
    # a range per task, or several where ranges are small
    tasks = min(n, max(spark.sparkContext.defaultParallelism, -(-total // RANGE_BYTES), -(-n // FILES_PER_TASK)))
    ranges = ranges.repartition(int(tasks), "file", "at")
    ranges = _with_quotes(spark, ranges, step)

    def read(batches):
        for batch in batches:
            for path, at, inside in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "inside")), strict=True):
                places, rows = [], []
                with open_file(path) as f:
                    for place, row in records_of(f, at, at + step, inside):
                        if place and row.strip():
                            places.append(place)
                            rows.append(row)
                        if len(rows) == PER_BATCH:
                            yield _batch(path, places, rows)
                            places, rows = [], []
                yield _batch(path, places, rows)

    raw = ranges.select("file", "at", "inside").mapInArrow(read, "source_file string, place long, record binary")
    return raw.withColumn("record", F.col("record").cast("string"))


def _batch(path: str, places: list[int], rows: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(places, pa.int64()),
                                       pa.array(rows, pa.binary())], names=["source_file", "place", "record"])
