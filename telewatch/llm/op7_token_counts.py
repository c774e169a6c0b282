"""Token counts of flat token files by a separator scan.

A flat token file is a sequence of fixed-width ids without any index; every
document ends with the separator id.  Files are read in blocks by range, a vectorised
search finds the separators of each block, and a prefix scan over the block
summaries (separators so far, position of the last one) stitches documents
that span blocks.

``write_token_files`` makes such files from documents with Spark's own text
writer: a row is the packed ids of a document and the line separator is the
separator id, so any file system that Spark can write works.
"""

from __future__ import annotations

import re
import uuid
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_table_dir
from .common import arrow_batches, stage, table
from .op2_packing import VOCABULARY, word_tokens

WIDTHS = {2: "<u2", 4: "<u4"}
BLOCK = 1 << 20              # bytes per block
RUN = 16                     # blocks read through one open file
PER_TASK = 1 << 26           # bytes per task aimed at
WHOLE = (1 << 31) - 64       # bytes of a file that Spark holds as one value
SEPARATOR = 0
ROWS_PER_FILE = 20_000
FILE_BYTES = 1 << 30         # most bytes of a written file


def write_token_files(docs: DataFrame, path: str, width: int = 2, vocabulary: str = VOCABULARY) -> None:
    """Write the token ids of every row of ``docs(text)`` to flat files.

    An id is stored plus one, so 0 is the separator and nothing else.  Rows
    keep their order inside a file; a null or empty text is a separator alone.
    A file has at most ``ROWS_PER_FILE`` rows, and fewer where rows of the
    longest text (an id per byte) would pass ``FILE_BYTES``.
    """
    arrow_batches(docs.sparkSession)
    longest = docs.agg(F.max(F.octet_length("text"))).first()[0] or 0
    per_file = max(1, min(ROWS_PER_FILE, FILE_BYTES // (width * (longest + 1))))

    def pack(batches):
        one = np.array(1, WIDTHS[width])
        tokens = word_tokens(vocabulary, WIDTHS[width])
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([(np.frombuffer(x, WIDTHS[width]) + one).tobytes() for x in tokens.packed(texts)],
                          pa.binary())], names=["ids"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(pack, "ids binary")
    (rows.select(F.col("ids").cast("string").alias("value")).write.mode("overwrite")
     .option("lineSep", "\u0000" * width).option("compression", "none")
     .option("maxRecordsPerFile", per_file).text(path))


def _open(file: str):
    """A file by its Spark path, open for reads at any place."""
    if file.startswith("file:"):
        return open(re.sub(r"^file:/+", "/", file), "rb")
    from pyarrow.fs import FileSystem
    fs, name = FileSystem.from_uri(quote(file, safe=":/@"))
    return fs.open_input_file(name)


def _ends(data, width: int, separator: int, at: int):
    return np.flatnonzero(np.frombuffer(data, WIDTHS[width]) == separator) + at // width


def _summary(file, size, at, ends) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(file, pa.string()), pa.array(size, pa.int64()), pa.array(at, pa.int64()),
         pa.array(ends, pa.list_(pa.int64())), pa.array([len(e) for e in ends], pa.int64()),
         pa.array([int(e[-1]) if len(e) else None for e in ends], pa.int64())],
        names=["file", "size", "at", "ends", "n", "last"])


def _scanned(spark: SparkSession, path: str, width: int, separator: int, block: int) -> DataFrame:
    """``file, size, at, ends, n, last``: a row per block with its separators."""
    schema = "file string, size long, at long, ends array<long>, n long, last long"
    whole = F.col("length") - F.col("length") % width
    source = spark.read.format("binaryFile").load(path)

    def starts(step: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))).alias("at")

    def ranged(files: DataFrame) -> DataFrame:
        sizes = files.select(F.col("path").alias("file"), whole.alias("size")).where(F.col("size") > 0)
        run = RUN * block
        n, total = sizes.agg(F.sum(F.ceil(F.col("size") / run)), F.sum("size")).first()
        tasks = min(n or 1, max(spark.sparkContext.defaultParallelism, -(-(total or 0) // PER_TASK)))
        runs = sizes.select("file", "size", starts(run)).repartition(int(tasks), "file", "at")

        def scan(batches):
            for batch in batches:
                for file, size, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    with _open(file) as f:
                        f.seek(at)
                        for place in range(at, min(at + run, size), block):
                            want = min(block, size - place)
                            data = f.read(want)
                            if len(data) != want:
                                raise OSError(f"{file} ends before its length of {size} bytes")
                            yield _summary([file], [size], [place], [_ends(data, width, separator, place)])

        return runs.mapInArrow(scan, schema)

    def by_spark(files: DataFrame) -> DataFrame:
        blocks = (files.select(F.col("path").alias("file"), whole.alias("size"), "content").where(F.col("size") > 0)
                  .select("file", "size", "content", starts(block))
                  .select("file", "size", "at", F.substring(
                      "content", (F.col("at") + 1).cast("int"),
                      F.least(F.lit(block).cast("long"), F.col("size") - F.col("at")).cast("int")).alias("bytes")))

        def scan(batches):
            for batch in batches:
                file, size, at, data = (c.to_pylist() for c in batch.columns)
                yield _summary(file, size, at, [_ends(d, width, separator, a) for a, d in zip(at, data, strict=True)])

        return blocks.mapInArrow(scan, schema)

    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
        return ranged(source)
    return by_spark(source.where(F.col("length") <= WHOLE)).unionByName(ranged(source.where(F.col("length") > WHOLE)))


def count_tokens(spark: SparkSession, path: str, width: int = 2, separator: int = SEPARATOR,
                 block: int = BLOCK) -> DataFrame:
    """``file, doc_no, start, n_tokens, terminated`` of every document under ``path``.

    ``doc_no`` counts from 0 in the file, ``start`` is the token position of
    its first token, ``n_tokens`` excludes the separator.  Ids after the last
    separator are a document that is not terminated; none follow if there are
    none.

    Shape: Spark lists the files; a task opens a file, seeks to its run of
    blocks and holds one block at a time, whatever the size of the file.  On a
    file system other than ``file:``, files below 2 GB are read by Spark, and
    larger ones by range through pyarrow (hdfs, s3, gs, abfs; others raise).
    The separator positions of a block are written (8 bytes per document); only
    one row of two numbers per block takes part in the prefix scan of its file.

    Edge cases: an empty file has no document; adjacent separators are
    documents without tokens; a file with a trailing partial id ignores it; a
    separator never spans blocks because a block holds whole ids; a file
    without a separator is one document that is not terminated.
    """
    arrow_batches(spark, 16)
    block -= block % width
    found = stage(_scanned(spark, path, width, separator, block))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select(
        "file", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("done"),
        (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("open"))
    stitched = found.join(carried, ["file", "at"])
    # the last block of a file closes what follows its last separator
    total = F.col("size") / width
    tail = F.coalesce(F.col("last") + 1, F.col("open"))
    last = (F.col("at") + block >= F.col("size")) & (tail < total)
    ends = F.when(last, F.concat("ends", F.array(total.cast("long")))).otherwise(F.col("ends"))
    spans = F.transform(ends, lambda e, i: F.struct(
        F.when(i == 0, F.col("open")).otherwise(F.get("ends", i - 1) + 1).alias("start"), e.alias("end"),
        (i < F.size("ends")).alias("terminated")))
    return (stitched.select("file", "done", F.posexplode(spans).alias("i", "s"))
            .select("file", (F.col("done") + F.col("i")).alias("doc_no"), F.col("s.start").alias("start"),
                    (F.col("s.end") - F.col("s.start")).alias("n_tokens"),
                    F.col("s.terminated").alias("terminated")))


def op7_token_counts(spark, sf_dir) -> DataFrame:
    path = scratch_table_dir(spark, f"tokens-{uuid.uuid4().hex}")
    write_token_files(table(spark, sf_dir, "documents"), path)
    part = F.regexp_extract("file", r"part-(\d+).*-c(\d+)", 0)
    name = F.concat(F.regexp_extract(part, r"part-(\d+)", 1), F.lit("-"), F.regexp_extract(part, r"-c(\d+)$", 1))
    return count_tokens(spark, path).select(name.alias("file"), "doc_no", "start", "n_tokens", "terminated")
