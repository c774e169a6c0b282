"""Binary token store with keyed access through minimal perfect hashing.

``write_store`` encodes documents and writes, under one folder,

* ``data/kind=ids/part=p/``: raw little-endian ids, nothing else; a document is
  its ids and the end id, documents follow each other in ascending ``doc_id``
  order through the shards (a shard is one file, by task and part);
* ``data/kind=entries/part=p/``: a record of fixed width per document
  (id, place in the shard, number of ids) beside every shard;
* ``shards``: one row per shard (name, file, ids, ids of all shards before it);
* ``index``: one row per bucket of keys with a minimal perfect hash of them: the
  bits of a cascade of hash levels, and for every slot the stored fingerprint
  of its key, the shard, the place in it and the number of ids;
* ``repeats``: the places of rows without an id, and of further rows of an id.

``lookup`` maps keys to places: one bucket, an expected constant number of
hash levels and one slot per key; a key that is not stored fails its
fingerprint (one in 2**32 foreign keys passes).  ``read_documents`` then seeks
to the place in the shard.

Files are written by Spark's own text writer (a row is the ids of a document,
the line separator is the end id), so any file system that Spark writes works
and a lost task repeats its own files only.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_table_dir
from .common import arrow_batches, mix, table
from .op2_packing import VOCABULARY, WordTokens
from .op7_token_counts import _open

END_ID = 1
WIDTHS = {2: "<u2", 4: "<u4"}
TASK_BYTES = 1 << 27         # text of a writing task aimed at
SHARD_BYTES = 1 << 28        # a shard ends with the document that passes this
SHARD_ROWS = 1 << 20         # or that has this place in it
OPEN_FILES = 2_048           # files a task may hold open: shards and entries
KEYS_PER_BUCKET = 4_096      # aimed at
RUN = 1 << 24                # bytes of a shard read through one open file
ROOM = 2                     # bits per key still to place at each level
LEVELS = 64
PARTS_CACHED = 300_000
PLACE = "doc_id long, shard string, start long, n long"
PLACES = {"doc_id": pa.int64(), "shard": pa.string(), "start": pa.int64(), "n": pa.int64()}
INDEX = ("bucket int, buckets int, n int, rooms array<int>, bits binary, prints binary, shards array<string>, shard binary, "
         "start binary, length binary, more binary")
ENTRY = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("start", "<i8"), ("n", "<i8")])


# ------------------------------------------------------------------ tokens

class PackedTokens(WordTokens):
    """``WordTokens`` with the packed form of every id at hand and a larger
    bounded cache of word parts, in two generations."""

    def __init__(self, vocabulary: str, dtype: str):
        super().__init__(vocabulary, dtype)
        self.last: dict[str, bytes] = {}
        size = np.dtype(dtype).itemsize
        self.pack = [i.to_bytes(size, "little") for i in range(self.model.get_vocab_size())]

    def _part(self, part: str) -> bytes:
        ids = self.last.get(part)
        if ids is None:
            pack = self.pack
            text = part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
            ids = b"".join([pack[t.id] for t in self.model.model.tokenize(text)])
        if len(self.parts) > PARTS_CACHED:
            self.last, self.parts = self.parts, {}
        self.parts[part] = ids
        return ids


_TOKENS: dict[tuple, PackedTokens] = {}


def _tokens(vocabulary: str, dtype: str) -> PackedTokens:
    key = (vocabulary, dtype)
    if key not in _TOKENS:
        _TOKENS[key] = PackedTokens(*key)
    return _TOKENS[key]


# ------------------------------------------------- minimal perfect hashing

def _level(keys, level: int, room: int):
    """Place of every key among ``room`` bits of a level."""
    seed = np.uint64((level * 2 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        return ((mix(keys ^ seed) >> np.uint64(32)) * np.uint64(room)) >> np.uint64(32)


def fingerprints(keys):
    """32 bits of a hash that the levels do not use."""
    with np.errstate(over="ignore"):
        return (mix(keys + np.uint64(0xD6E8FEB86659FD93)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def perfect_hash(keys) -> tuple[list[int], bytes]:
    """Minimal perfect hash of distinct 64-bit keys: ``(rooms, bits)``.

    At each level the keys left are hashed to ``ROOM`` bits each; a bit that one
    key alone meets is set and places that key, the others go to the next level.
    The slot of a key is the number of set bits before its own.
    """
    rooms, flags, left = [], [], np.asarray(keys, np.uint64)
    while len(left):
        if len(rooms) == LEVELS:
            raise ValueError(f"{len(left)} keys are left after {LEVELS} levels: are they distinct?")
        room = max(64, ROOM * len(left))
        at = _level(left, len(rooms), room).astype(np.int64)
        alone = np.bincount(at, minlength=room) == 1
        rooms.append(room)
        flags.append(alone)
        left = left[~alone[at]]
    bits = np.concatenate(flags) if flags else np.empty(0, bool)
    return rooms, np.packbits(bits, bitorder="little").tobytes()


def slots(keys, rooms, bits: bytes):
    """Slot of every key, -1 where no level holds it (a key never stored)."""
    keys = np.asarray(keys, np.uint64)
    flags = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
    rank = np.cumsum(flags, dtype=np.int64)
    out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, room in enumerate(rooms):
        at = _level(keys[left], level, room).astype(np.int64) + base
        hit = flags[at] == 1
        out[left[hit]] = rank[at[hit]] - 1
        left = left[~hit]
        base += room
    return out


# ------------------------------------------------------------------ writing

def _buckets(column: str, n: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(n)).cast("int")


def _write_data(docs: DataFrame, path: str, width: int, vocabulary: str, end_id: int) -> None:
    """Shards and their entries; see the module docstring."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def encode(batches):
        tokens = _tokens(vocabulary, WIDTHS[width])
        part, at, held = 0, 0, 0
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            packed = list(tokens.packed(texts))
            ids = batch.column(0).to_pylist()
            entries, parts = np.zeros(len(ids), ENTRY), np.zeros(len(ids), np.int32)
            for i, (doc_id, x) in enumerate(zip(ids, packed, strict=True)):
                if at * width >= SHARD_BYTES or held == SHARD_ROWS:
                    part, at, held = part + 1, 0, 0
                n = len(x) // width + 1
                held += 1
                entries[i] = (doc_id is not None, doc_id or 0, at, n)
                parts[i] = part
                at += n
            raw = entries.tobytes()
            step = ENTRY.itemsize
            records = [raw[i:i + step] for i in range(0, len(raw), step)]
            both = pa.array(np.concatenate([parts, parts]), pa.int32())
            kind = pa.array(["ids"] * len(ids) + ["entries"] * len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(packed + records, pa.binary()), kind, both],
                                             names=["value", "kind", "part"])

    # equal ids may be many: the hash of the text splits them between tasks
    order = [F.col("doc_id"), F.xxhash64("text")]
    laid = rows.repartitionByRange(int(tasks), *order).sortWithinPartitions(*order, "text")
    data = laid.mapInArrow(encode, "value binary, kind string, part int")
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    # rows keep their order only without the sort that one writer at a time needs
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", OPEN_FILES)
    try:
        (data.select(F.col("value").cast("string").alias("value"), "kind", "part").write.mode("overwrite")
         .partitionBy("kind", "part").option("lineSep", end_id.to_bytes(width, "little").decode("latin-1"))
         .option("compression", "none").text(path))
    finally:
        spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", before)


def _shard() -> F.Column:
    """Sortable shard name of a file: its task and its part."""
    file = F.col("path")
    return F.concat(F.lpad(F.regexp_extract(file, r"/part-(\d+)-", 1), 10, "0"), F.lit("/"),
                    F.lpad(F.regexp_extract(file, r"/part=(\d+)/", 1), 10, "0"))


def _entries(spark: SparkSession, path: str, width: int) -> DataFrame:
    """``shard, doc_id, start, n`` of every document, from the entry files."""
    record = np.dtype([("entry", ENTRY), ("end", f"V{width}")])

    def parse(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                e = np.frombuffer(content.as_py(), record)["entry"]
                ids = pa.array(np.ascontiguousarray(e["doc_id"]), pa.int64(), mask=e["known"] == 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(e)), ids, pa.array(np.ascontiguousarray(e["start"]), pa.int64()),
                     pa.array(np.ascontiguousarray(e["n"]), pa.int64())], names=["shard", "doc_id", "start", "n"])

    files = spark.read.format("binaryFile").load(f"{path}/kind=entries")
    return files.select(_shard().alias("shard"), "content").mapInArrow(
        parse, "shard string, doc_id long, start long, n long")


def write_store(docs: DataFrame, path: str, width: int = 2, vocabulary: str = VOCABULARY,
                end_id: int = END_ID) -> None:
    """Write the store of ``docs(doc_id, text)`` to ``path``.

    Shape: documents are range-partitioned by id (ties by a hash of the text)
    and sorted within the tasks; texts are encoded once, in order, while they
    are written.  A shard ends with the document that passes ``SHARD_BYTES``.
    The index is built from the entries (33 bytes a document): one shuffle by
    bucket, a bucket of about ``KEYS_PER_BUCKET`` keys per group.  One row per
    shard meets in one task for the ids before it.

    Edge cases: a null text is empty (its document is the end id alone); rows
    without an id come first and are not keyed (``repeats``); rows of one id
    follow each other in the order of a hash of their texts, the first one is
    keyed and the others are in ``repeats``; an empty table gives an empty store; a text
    of any length is one document; extra columns do not take part.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    _write_data(docs, f"{path}/data", width, vocabulary, end_id)
    schema = "shard string, file string, n_ids long, base long"
    if not _has(spark, f"{path}/data/kind=ids"):                # no documents
        spark.createDataFrame([], schema).write.parquet(f"{path}/shards")
        spark.createDataFrame([], INDEX).write.parquet(f"{path}/index")
        spark.createDataFrame([], PLACE).write.parquet(f"{path}/repeats")
        return
    files = spark.read.format("binaryFile").load(f"{path}/data/kind=ids")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    (files.select(_shard().alias("shard"), F.col("path").alias("file"),
                  F.floor(F.col("length") / width).alias("n_ids"))
     .withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
     .select("shard", "file", "n_ids", "base").write.parquet(f"{path}/shards"))

    entries = _entries(spark, f"{path}/data", width)
    place = F.struct("shard", "start", "n")
    first = (entries.where("doc_id IS NOT NULL").groupBy("doc_id")
             .agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("rows")))
    n = entries.agg(F.count("doc_id")).first()[0]
    buckets = max(1, -(-n // KEYS_PER_BUCKET))

    def build(rows: pa.Table) -> pa.Table:
        keys = rows.column("doc_id").to_numpy().astype(np.uint64)
        rooms, bits = perfect_hash(keys)
        order = np.argsort(slots(keys, rooms, bits))
        rows = rows.take(pa.array(order))
        names, shard = np.unique(np.array(rows.column("shard").to_pylist(), object), return_inverse=True)
        return pa.table({
            "bucket": pa.array([rows.column("bucket")[0].as_py()], pa.int32()),
            "buckets": pa.array([buckets], pa.int32()), "n": pa.array([len(keys)], pa.int32()),
            "rooms": pa.array([rooms], pa.list_(pa.int32())), "bits": pa.array([bits], pa.binary()),
            "prints": pa.array([fingerprints(keys[order]).tobytes()], pa.binary()),
            "shards": pa.array([names.tolist()], pa.list_(pa.string())),
            "shard": pa.array([shard.astype("<u4").tobytes()], pa.binary()),
            "start": pa.array([rows.column("start").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "length": pa.array([rows.column("n").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "more": pa.array([np.packbits(rows.column("rows").to_numpy() > 1, bitorder="little").tobytes()], pa.binary())})

    keyed = first.select("doc_id", "p.shard", "p.start", "p.n", "rows", _buckets("doc_id", buckets).alias("bucket"))
    keyed.groupBy("bucket").applyInArrow(build, INDEX).write.parquet(f"{path}/index")
    again = first.where("rows > 1").select("doc_id", F.col("p.shard").alias("_s"), F.col("p.start").alias("_a"))
    others = (entries.join(again, "doc_id").where((F.col("shard") != F.col("_s")) | (F.col("start") != F.col("_a")))
              .select("doc_id", "shard", "start", "n"))
    nameless = entries.where("doc_id IS NULL").select("doc_id", "shard", "start", "n")
    others.unionByName(nameless).write.parquet(f"{path}/repeats")


def _has(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


# ------------------------------------------------------------------ reading

def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """``doc_id, shard, start, n`` of every stored row of ``keys(doc_id)``.

    A null key asks for the rows without an id; keys that are not stored have
    no row; a key asked twice is answered once.  One shuffle of the keys by
    bucket; a bucket is read once for all its keys.
    """
    index, repeats = (spark.read.parquet(f"{path}/{t}") for t in ("index", "repeats"))
    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    further = repeats.join(asked, "doc_id").select("doc_id", "shard", "start", "n")
    if not asked.where("doc_id IS NULL").isEmpty():            # no join: they can be many
        further = further.unionByName(repeats.where("doc_id IS NULL"))
    buckets = index.agg(F.max("buckets")).first()[0]
    if buckets is None:
        return further
    dealt = asked.where("doc_id IS NOT NULL").withColumn("bucket", _buckets("doc_id", buckets))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], t) for c, t in PLACES.items()})
        ids, row = left.column("doc_id").to_numpy(), right.slice(0, 1).to_pylist()[0]
        at = slots(ids.astype(np.uint64), row["rooms"], row["bits"])
        ids, at = ids[at >= 0], at[at >= 0]
        ok = np.frombuffer(row["prints"], "<u4")[at] == fingerprints(ids.astype(np.uint64))
        ids, at = ids[ok], at[ok]
        names = np.array(row["shards"], object)
        return pa.table({"doc_id": pa.array(ids, pa.int64()),
                         "shard": pa.array(names[np.frombuffer(row["shard"], "<u4")[at]].tolist(), pa.string()),
                         "start": pa.array(np.frombuffer(row["start"], "<i8")[at], pa.int64()),
                         "n": pa.array(np.frombuffer(row["length"], "<i8")[at], pa.int64())})

    found = dealt.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(find, PLACE)
    return found.unionByName(further)


def read_documents(spark: SparkSession, path: str, keys: DataFrame, width: int = 2,
                   digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens`` and ``ids`` (packed bytes), or ``ids_crc32``
    with ``digest``, of the stored rows of ``keys(doc_id)``.

    ``start`` counts the ids of all rows before it in the store, ``n_tokens``
    includes the end id.  Places are grouped by runs of ``RUN`` bytes of a shard:
    a task opens the file once per run and seeks to each place, so a few keys
    read a few places and all keys read every shard once.
    """
    arrow_batches(spark)
    shards = spark.read.parquet(f"{path}/shards")
    run = F.floor(F.col("start") * width / RUN)
    places = (lookup(spark, path, keys).join(shards, "shard")
              .select("doc_id", "file", "start", "n", "base", run.alias("run")))
    last = ("ids_crc32", "long", pa.int64()) if digest else ("ids", "binary", pa.binary())

    def read(part: pa.Table) -> pa.Table:
        part = part.sort_by("start")
        out = []
        with _open(part.column("file")[0].as_py()) as f:
            for at, n in zip(part.column("start").to_pylist(), part.column("n").to_pylist(), strict=True):
                f.seek(at * width)
                data = f.read(n * width)
                if len(data) != n * width:
                    raise OSError(f"{part.column('file')[0]} ends inside a document")
                out.append(_crc(data, width) if digest else data)
        start = pa.array(part.column("start").to_numpy() + part.column("base").to_numpy(), pa.int64())
        return pa.table({"doc_id": part.column("doc_id"), "start": start, "n_tokens": part.column("n"),
                         last[0]: pa.array(out, last[2])})

    return places.groupBy("file", "run").applyInArrow(
        read, f"doc_id long, start long, n_tokens long, {last[0]} {last[1]}")


def _crc(data: bytes, width: int) -> int:
    return zlib.crc32(np.frombuffer(data, WIDTHS[width]).astype("<u4"))


def op12_token_store(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = scratch_table_dir(spark, f"store-{uuid.uuid4().hex}")
    write_store(docs, path)
    return read_documents(spark, path, docs, digest=True)
