"""Substring dedup by level-wise doubling.

A window of ``min_words`` consecutive words that also starts in a document
with a smaller id is removed.  Levels double up to the window length (13, 25,
50 words): windows repeated at one length alone are extended to the next one,
until no candidate survives.

* Level 1 takes anchors: in every ``min_words`` window the base window with
  the smallest hash is its anchor (winnowing).  Equal windows have equal
  anchors at equal offsets, so the anchor of a repeated window is repeated:
  nothing is lost, and a twentieth of the base windows is shuffled.
* Anchors repeated in two documents are extended to the next length and
  compared again.
* The full windows whose anchor survives are compared by a 128-bit hash.

Comparisons are exchanges of packed arrays: entries are dealt by their hash
into buckets of bounded size.  An entry that its own task already decides
(the same window in several documents of the task) sends one witness only, so
a passage shared by a third of all documents reaches its bucket once per task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, mix, stage, table, window_hashes, word_hashes

MIN_WORDS = 50
BASE_FLOOR = 12             # no level is shorter than this
FLUSH = 200_000             # entries gathered by a task before it deals them out
PER_BUCKET = 150_000        # entries aimed at per bucket
CHUNK = 1 << 20             # base windows compared at once in a very long text

NORMAL, WITNESS, KNOWN = 0, 1, 2
ENTRY = [("h", "<u8"), ("h2", "<u8"), ("next", "<u8"), ("doc", "<i8"), ("rk", "<u4"),
         ("pos", "<u4"), ("level", "<u4"), ("kind", "u1")]
FIELDS = {"anchor": ("h", "next", "doc", "rk", "pos", "level", "kind"),
          "window": ("h", "h2", "doc", "rk", "pos", "kind")}
TYPES = dict(ENTRY)


def level_lengths(min_words: int) -> list[int]:
    """Lengths of the levels (at most three), each at most twice the one before."""
    out = [min_words]
    while (out[0] + 1) // 2 >= max(BASE_FLOOR, min_words // 4):
        out.insert(0, (out[0] + 1) // 2)
    return out


def anchors(base_hashes, span: int):
    """For every run of ``span`` base windows the position of the smallest hash
    (the anchor of the full window that starts there)."""
    found = []
    low = np.uint64(CHUNK - 1)
    for start in range(0, len(base_hashes) - span + 1, CHUNK - span + 1):
        x = base_hashes[start:start + CHUNK]
        key = (x & ~low) | np.arange(len(x), dtype=np.uint64)
        pad = -len(key) % span
        grid = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, span)
        left = np.minimum.accumulate(grid, axis=1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(x) - span + 1
        found.append((np.minimum(right[:n], left[span - 1:span - 1 + n]) & low).astype(np.int64) + start)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _table(**cols):
    n = len(cols["doc"])
    return {k: np.asarray(v, TYPES[k]) if np.ndim(v) else np.full(n, v, TYPES[k])
            for k, v in cols.items()}


def _concat(parts: list[dict]) -> dict:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _groups(e: dict):
    """Entries sorted by hash: (order, group number, group starts)."""
    order = np.lexsort((e["h2"], e["h"])) if "h2" in e else np.argsort(e["h"], kind="stable")
    h = e["h"][order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if "h2" in e:
        h2 = e["h2"][order]
        new[1:] |= h2[1:] != h2[:-1]
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _local(e: dict, how: str, length: int) -> dict:
    """What a task can decide alone; at most one witness per hash goes on."""
    order, group, first = _groups(e)
    doc = e["doc"][order]
    low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
    kind = e["kind"].copy()
    if how == "window":                     # removed: a smaller document has it
        kind[order[doc > low[group]]] = KNOWN
        return {**e, "kind": kind}
    shared = low != high                    # anchors: found in two documents
    settled = order[shared[group]]
    kind[settled] = KNOWN
    level = e["level"].copy()
    if length:
        level[settled] = length
    lead = {k: v[order[first[shared]]] for k, v in e.items()}
    lead["kind"] = np.full(len(lead["doc"]), WITNESS, "u1")
    return _concat([{**e, "kind": kind, "level": level}, lead])


def _pack(e: dict, key, how: str, buckets: int) -> pa.RecordBatch:
    """One row per bucket of ``key``, with its entries as packed arrays."""
    bucket = (key >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
    return pa.RecordBatch.from_arrays(
        [pa.array([int(bucket[p[0]]) for p in parts], pa.int64()),
         pa.array([b"".join(e[f][p].tobytes() for f in FIELDS[how]) for p in parts], pa.binary())],
        names=["bucket", "payload"])


def _document_key(e: dict):
    return mix(e["doc"].view("<u8"))


def _deal(e: dict, how: str, buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    """Pack entries by bucket: by hash, or by document when nothing is open."""
    if len(e["doc"]) == 0:
        return
    undecided = e["kind"] != KNOWN
    open_part, known = ({k: v[m] for k, v in e.items()} for m in (undecided, ~undecided))
    if len(open_part["doc"]):
        open_part = _local(open_part, how, length)
    e = _concat([open_part, known])
    yield _pack(e, np.where(e["kind"] == KNOWN, _document_key(e), e["h"]), how, buckets)


def _unpack(payload: bytes, how: str) -> dict:
    sizes = [np.dtype(TYPES[f]).itemsize for f in FIELDS[how]]
    n = len(payload) // sum(sizes)
    out, at = {}, 0
    for f, size in zip(FIELDS[how], sizes, strict=True):
        out[f] = np.frombuffer(payload, TYPES[f], n, at)
        at += n * size
    return out


def _settle(parts: list[dict], how: str, length: int) -> dict:
    """Decide one bucket; the entries that survive (anchors: with their level)."""
    e = _concat(parts)
    done = e["kind"] == KNOWN
    known, rest = ({k: v[m] for k, v in e.items()} for m in (done, ~done))
    out = [known]
    if len(rest["doc"]):
        order, group, first = _groups(rest)
        doc = rest["doc"][order]
        low = np.minimum.reduceat(doc, first)
        if how == "window":
            out.append({k: v[order[doc > low[group]]] for k, v in rest.items()})
        else:
            high = np.maximum.reduceat(doc, first)
            told = np.maximum.reduceat(rest["kind"][order], first) == WITNESS
            ok = ((low != high) | told)[group]
            own = rest["kind"][order] == NORMAL
            if length:                      # a later level: the others keep their level
                keep, level = own, np.where(ok, length, rest["level"][order])
            else:
                keep, level = own & ok, rest["level"][order]
            picked = {k: v[order[keep]] for k, v in rest.items()}
            picked["level"] = level[keep].astype("<u4")
            out.append(picked)
    return _concat(out)


def _by_document(e: dict, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    if len(e["doc"]) == 0:
        return
    order = np.lexsort((e["pos"], e["rk"], e["doc"]))
    doc, rk = e["doc"][order], e["rk"][order]
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (rk[1:] != rk[:-1])) + 1
    parts = np.split(order, cut)
    lead = np.array([p[0] for p in parts])
    arrays = [pa.array(e["doc"][lead], pa.int64()), pa.array(e["rk"][lead].astype("i8"), pa.int64())]
    arrays += [pa.array([e[f][p].tobytes() for p in parts], pa.binary()) for f in names]
    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "rk", *names])


def _exchange(rows: DataFrame, entries, how: str, buckets: int, length: int = 0,
              out: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Deal the entries of ``rows`` into buckets by hash, settle each, then deal
    what survives by document: one row per document."""

    def scatter(batches):
        held, n = [], 0
        for batch in batches:
            for e in entries(batch):
                held.append(e)
                n += len(e["doc"])
                if n >= FLUSH:
                    yield from _deal(_concat(held), how, buckets, length)
                    held, n = [], 0
        if held:
            yield from _deal(_concat(held), how, buckets, length)

    def gather(t: pa.Table) -> pa.Table:
        e = _settle([_unpack(p.as_py(), how) for p in t.column("payload")], how, length)
        return pa.Table.from_batches([_pack(e, _document_key(e), how, buckets)])

    def collect(t: pa.Table) -> pa.Table:
        e = _concat([_unpack(p.as_py(), how) for p in t.column("payload")])
        schema = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), *((f, pa.binary()) for f in out)])
        return pa.Table.from_batches([b.cast(schema) for b in _by_document(e, out)], schema)

    packed = "bucket long, payload binary"
    return (rows.mapInArrow(scatter, packed).groupBy("bucket").applyInArrow(gather, packed)
            .groupBy("bucket").applyInArrow(
                collect, "doc_id long, rk long, " + ", ".join(f"{f} binary" for f in out)))


def _words(text) -> list:
    return text.split() if text else []


def _alive(found, levels: dict, lengths: list[int]):
    """Start positions of the full windows whose anchor survives every level
    that lies inside the window."""
    hit = np.minimum(np.searchsorted(levels["pos"], found), len(levels["pos"]) - 1)
    reached = np.where(levels["pos"][hit] == found, levels["level"][hit], 0)
    offset = found - np.arange(len(found))
    alive = np.ones(len(found), bool)
    for length in lengths[:-1]:
        alive &= (reached >= length) | (offset + length > lengths[-1])
    return np.flatnonzero(alive)


def _marks(groups, rk: int):
    """(whole copy?, surviving anchors) of the row with this text checksum."""
    pos, level = [], []
    for m in groups or ():
        if m["rk"] != rk:
            continue
        if m["pos"] is None:
            return True, None
        pos.append(np.frombuffer(m["pos"], "<u4"))
        level.append(np.frombuffer(m["level"], "<u4"))
    if not pos:
        return False, None
    pos, level = np.concatenate(pos).astype(np.int64), np.concatenate(level)
    order = np.argsort(pos, kind="stable")
    return False, {"pos": pos[order], "level": level[order]}


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS, with_text: bool = True) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: what is left without repeated windows.

    Returns ``doc_id, n_words, n_removed, spans`` (removed word ranges
    ``[start, end)``), ``kept_sha256`` (kept words joined by one space) and,
    with ``with_text``, ``kept_text``.  A word is removed when a window of
    ``min_words`` words covering it also starts in a document with a smaller
    doc_id; windows are judged on the input.

    Shape: the texts are read twice and shuffled once (by doc_id); anchors and
    candidate windows move as packed arrays dealt by hash.  Texts that equal
    an earlier one as a whole are decided by a checksum and send no windows.
    All intermediate tables are written to the shared folder.

    Edge cases: null or empty text has no words and keeps the empty text; a
    null doc_id is neither smaller nor larger than any other, so the row loses
    nothing and removes nothing elsewhere; rows with the same doc_id do not
    remove each other's windows (no smaller id), each is judged by its own
    text; texts shorter than ``min_words`` stay; very long texts are anchored
    in overlapping chunks; extra columns do not take part.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    lengths = level_lengths(min_words)
    base, span = lengths[0], min_words - lengths[0] + 1
    upper = lengths[1:-1]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    named = rows.where(F.col("doc_id").isNotNull())

    # whole copies: a smaller id with the same text
    sums = named.where(F.length("text") >= 2 * min_words - 1).select(
        "doc_id", F.unhex(F.md5("text")).alias("sum"), F.crc32("text").alias("rk"))
    # written, so that the join can split the rows of a hot sum
    lead = stage(sums.groupBy("sum").agg(F.min("doc_id").alias("lead")))
    copies = (sums.join(lead, "sum").where(F.col("doc_id") > F.col("lead"))
              .select("doc_id", "rk").distinct())

    size = named.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(8, int(size / 6 * 2 / (span + 1) / PER_BUCKET))

    def first_level(batch):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = _words(text)
            if len(words) < min_words:
                continue
            h = word_hashes(words)
            hb = window_hashes(h, base)
            p = np.unique(anchors(hb, span))
            nxt = np.zeros(len(p), np.uint64)
            if upper:
                hn = window_hashes(h, upper[0])
                inside = p < len(hn)
                nxt[inside] = hn[p[inside]] | np.uint64(1)     # 0: no such window here
            yield _table(h=hb[p], next=nxt, doc=np.full(len(p), doc, "<i8"),
                         rk=zlib.crc32(text), pos=p, level=base, kind=NORMAL)

    found = stage(_exchange(named, first_level, "anchor", buckets, 0, ("pos", "level", "next")))
    if upper:                   # extend what survives to the next length

        def next_level(batch):
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for doc, rk, pos, level, nxt in zip(*cols, strict=True):
                pos, nxt = np.frombuffer(pos, "<u4"), np.frombuffer(nxt, "<u8")
                yield _table(h=nxt, next=0, doc=np.full(len(pos), doc, "<i8"), rk=rk, pos=pos,
                             level=np.frombuffer(level, "<u4"),
                             kind=np.where(nxt == 0, KNOWN, NORMAL))

        found = stage(_exchange(found, next_level, "anchor", buckets, upper[0], ("pos", "level")))

    marks = (found.select("doc_id", "rk", "pos", "level")
             .unionByName(copies.select("doc_id", "rk", F.lit(None).cast("binary").alias("pos"),
                                        F.lit(None).cast("binary").alias("level")))
             .groupBy("doc_id").agg(F.collect_list(F.struct("rk", "pos", "level")).alias("marks")))
    used = [base, *upper, min_words]

    def visit(batches):
        for batch in batches:
            out = {k: [] for k in ("doc_id", "rk", "n_words", "n_removed", "kept_sha256", "body", "cand")}
            marked = batch.column(2).to_pylist()
            for doc, text, groups in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                         marked, strict=True):
                words = _words(text)
                rk = zlib.crc32(text or b"")
                copy, levels = _marks(groups, rk) if len(words) >= min_words else (False, None)
                cand = None
                if levels is not None:
                    p = anchors(window_hashes(word_hashes(words), base), span)
                    cand = _alive(p, levels, used)
                body = b" ".join(words)
                pending = cand is not None and len(cand) > 0
                out["doc_id"].append(doc)
                out["rk"].append(rk)
                out["n_words"].append(len(words))
                out["n_removed"].append(None if pending else len(words) if copy else 0)
                out["kept_sha256"].append(None if pending else
                                          hashlib.sha256(b"" if copy else body).hexdigest())
                out["body"].append(body if pending or (with_text and not copy) else None)
                out["cand"].append(cand.astype("<u4").tobytes() if pending else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["rk"], pa.int64()),
                 pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
                 pa.array(out["kept_sha256"], pa.string()), pa.array(out["body"], pa.binary()),
                 pa.array(out["cand"], pa.binary())], names=list(out))

    schema = ("doc_id long, rk long, n_words long, n_removed long, kept_sha256 string, "
              "body binary, cand binary")
    no_marks = F.lit(None).cast(marks.schema["marks"].dataType).alias("marks")
    seen = stage(named.join(marks, "doc_id", "left").mapInArrow(visit, schema).unionByName(
        rows.where(F.col("doc_id").isNull()).select("*", no_marks).mapInArrow(visit, schema)))
    open_rows = seen.where(F.col("cand").isNotNull())
    n_cand = open_rows.agg(F.sum(F.length("cand")) / 4).first()[0] or 0

    def full_windows(batch):
        cols = [batch.column(i).to_pylist() for i in range(4)]
        for doc, rk, body, cand in zip(*cols, strict=True):
            h, pos = word_hashes(_words(body)), np.frombuffer(cand, "<u4")
            yield _table(h=window_hashes(h, min_words)[pos], h2=window_hashes(h, min_words, 1)[pos],
                         doc=np.full(len(pos), doc, "<i8"), rk=rk, pos=pos, kind=NORMAL)

    hits = _exchange(open_rows.select("doc_id", "rk", "body", "cand"), full_windows, "window",
                     max(8, int(n_cand / PER_BUCKET)))
    hits = hits.groupBy("doc_id").agg(F.collect_list(F.struct("rk", "pos")).alias("hits"))

    def finish(batches):
        for batch in batches:
            out = {k: [] for k in ("doc_id", "n_words", "n_removed", "spans", "kept_sha256", "body")}
            for doc, rk, body, groups in zip(*[batch.column(i).to_pylist() for i in range(4)],
                                             strict=True):
                words = _words(body)
                edge = np.zeros(len(words) + 1, np.int64)
                for g in groups or ():
                    if g["rk"] == rk:
                        pos = np.frombuffer(g["pos"], "<u4").astype(np.int64)
                        np.add.at(edge, pos, 1)
                        np.add.at(edge, pos + min_words, -1)
                gone = np.cumsum(edge)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                out["doc_id"].append(doc)
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["spans"].append([{"start": int(a), "end": int(b)}
                                     for a, b in turn.reshape(-1, 2)])
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["body"].append(kept if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["n_words"], pa.int64()),
                 pa.array(out["n_removed"], pa.int64()),
                 pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(out["kept_sha256"], pa.string()), pa.array(out["body"], pa.binary())],
                names=list(out))

    final = "doc_id long, n_words long, n_removed long, spans array<struct<start:bigint,end:bigint>>, " \
            "kept_sha256 string, body binary"
    finished = (open_rows.select("doc_id", "rk", "body").join(hits, "doc_id", "left")
                .mapInArrow(finish, final))
    whole = F.when(F.col("n_removed") > 0, F.array(F.struct(
        F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))).otherwise(
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))
    decided = seen.where(F.col("cand").isNull()).select(
        "doc_id", "n_words", "n_removed", whole.alias("spans"), "kept_sha256", "body")
    out = decided.unionByName(finished)
    if with_text:
        return out.withColumn("kept_text", F.coalesce(F.col("body").cast("string"), F.lit(""))).drop("body")
    return out.drop("body")


def op1_substrings(spark, sf_dir) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"), MIN_WORDS, with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
win AS (
  SELECT rid, doc_id, i, md5(array_to_string(words[i:i+49], ' ')) AS m
  FROM w, LATERAL (SELECT unnest(range(1, len(words) - 48)) AS i) t WHERE len(words) >= 50),
hit AS (
  SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY m) AS lead FROM win)
  WHERE doc_id > lead),
gone AS (SELECT DISTINCT rid, i + k AS p FROM hit, (SELECT unnest(range(0, 50)) AS k) o),
per AS (SELECT rid, list(p) AS ps FROM gone GROUP BY rid),
cut AS (
  SELECT doc_id, words, coalesce(ps, []::BIGINT[]) AS ps FROM w LEFT JOIN per USING (rid))
SELECT doc_id, len(words)::BIGINT AS n_words, len(ps)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(words, lambda x, i: NOT list_contains(ps, i)), ' '), ''))
    AS kept_sha256
FROM cut
"""
