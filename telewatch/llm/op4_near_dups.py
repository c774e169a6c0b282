"""MinHash near-duplicates with sequential Bayesian verification.

Documents are sets of word shingles.  Equal sets are one class; classes get a
MinHash signature, and classes that share a band are candidates.  Candidates
are compared by batches of signature values: after each batch a pair is
dropped when the posterior probability that its similarity reaches the
threshold falls under the miss probability.  Survivors are confirmed on the
full sets, and the links are joined by a distributed union-find.

A bucket never emits all its pairs.  Every member is first compared with the
smallest member (a star); when all of them end up in one component the bucket
is finished.  In the buckets left open, members of different components meet
only through a prefix filter on their shingles, which is exact.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (arrow_batches, components, mix, pairs_apart, stage, table, window_hashes,
                     word_hashes)

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 75
BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS
BATCH = 16                   # signature values per Bayesian step
MISS = 1e-7                  # chance to drop a true link at one step

_MULTIPLIERS = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: bytes | None, size: int = SHINGLE_WORDS):
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = (text or b"").lower().split()         # bytes.lower changes A-Z only
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    if len(words) < size:                         # the whole sequence as one
        return mix(window_hashes(h, len(words)) ^ np.uint64(len(words)))
    return np.unique(window_hashes(h, size))


def signature(shingles):
    """MinHash values (16 bits of each minimum) of a non-empty set."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1024):
            part = shingles[at:at + 1024]
            np.minimum(low, (part[None, :] * _MULTIPLIERS[:, None]).min(axis=1), out=low)
    return (mix(low) >> np.uint64(48)).astype("<u2")


def bayes_minimum(n: int, threshold: float, miss: float = MISS) -> int:
    """Fewest matches among ``n`` values that keep a pair.

    With a uniform prior the posterior of the similarity is Beta(m+1, n-m+1),
    and P(similarity >= t) = P(Binomial(n+1, t) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def signatures(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, n_shingles, set_key`` (128-bit digest of the set) and ``sig``;
    null key and signature for an empty set."""
    arrow_batches(docs.sparkSession)

    def sign(batches):
        import xxhash
        for batch in batches:
            n, key, sig = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, shingle_words)
                n.append(len(s))
                if len(s) == 0:
                    key.append(None)
                    sig.append(None)
                    continue
                key.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                 pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("binary").alias("text")).mapInArrow(
        sign, "doc_id long, n_shingles long, set_key binary, sig binary")


def _band_rows(classes: DataFrame) -> DataFrame:
    """``(key, node)``: one row per class and band."""
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.substring("sig", 1 + width * b, width), F.lit(b))
                     for b in range(BANDS)])
    return classes.select("node", F.explode(keys).alias("key"))


def _bayes(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` that survive the size bound and the sequential test."""
    steps = list(range(BATCH, PERMUTATIONS + 1, BATCH))
    least = [bayes_minimum(n, percent / 100) for n in steps]

    def test(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, PERMUTATIONS)
                    for i in (2, 3))
            alive = np.arange(len(x))
            matches = np.zeros(len(x), np.int64)
            for n, minimum in zip(steps, least, strict=True):
                matches[alive] += (x[alive, n - BATCH:n] == y[alive, n - BATCH:n]).sum(axis=1)
                alive = alive[matches[alive] >= minimum]
                if not len(alive):
                    break
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(alive)) for i in (0, 1)],
                                             names=["a", "b"])

    sig = classes.select("node", "sig", "n_shingles")
    left = sig.select(F.col("node").alias("a"), F.col("sig").alias("x"), F.col("n_shingles").alias("na"))
    right = sig.select(F.col("node").alias("b"), F.col("sig").alias("y"), F.col("n_shingles").alias("nb"))
    joined = (pairs.join(left, "a").join(right, "b")
              .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    return joined.select("a", "b", "x", "y").mapInArrow(test, "a long, b long").distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold, as ``(src, dst)``."""

    def exact(batches):
        for batch in batches:
            src, dst = [], []
            for a, b, x, y in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    src.append(a)
                    dst.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())],
                                             names=["src", "dst"])

    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
            .select("a", "b", "x", "y").mapInArrow(exact, "src long, dst long"))


def _shingle_sets(docs: DataFrame, nodes: DataFrame, shingle_words: int) -> DataFrame:
    """Full sets of the documents named by ``nodes(node)``."""

    def build(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([shingle_set(t, shingle_words).tobytes()
                                            for t in batch.column(1).to_pylist()], pa.binary())],
                names=["node", "shingles"])

    return (docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary").alias("text"))
            .join(nodes, "node", "left_semi").mapInArrow(build, "node long, shingles binary")
            .where(F.length("shingles") > 0))


def _open_nodes(members: DataFrame, comp: DataFrame) -> DataFrame:
    """``(node, comp)`` of the members of buckets that hold several components."""
    placed = stage(members.join(comp, "node", "left")
                   .select("key", "node", F.coalesce("component", "node").alias("comp")))
    # a bucket of two is finished: its one pair was the star
    several = (placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"),
                                         F.count(F.lit(1)).alias("n"))
               .where((F.col("low") < F.col("high")) & (F.col("n") > 2)).select("key"))
    return stage(placed.join(several, "key").select("node", "comp").distinct())


def _apart(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of ``nodes(node, comp)`` that can still be similar."""

    def flatten(batches):
        for batch in batches:
            node, comp = (np.array(batch.column(i).to_pylist(), np.int64) for i in (0, 1))
            held = [np.frombuffer(x, "<i8") for x in batch.column(2).to_pylist()]
            n = np.array([len(x) for x in held], np.int64)
            values = np.concatenate(held) if held else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(node, n)), pa.array(np.repeat(comp, n)), pa.array(np.repeat(n, n)),
                 pa.array(values, pa.int64())], names=["node", "comp", "n", "s"])

    rows = nodes.join(sets, "node").select("node", "comp", "shingles").mapInArrow(
        flatten, "node long, comp long, n long, s long")
    return pairs_apart(rows, percent)


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD_PERCENT,
                    shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when their shingle sets have a Jaccard similarity of
    at least ``percent``; ``component_id`` is the smallest doc_id reachable and
    ``kept`` marks the document that carries it.

    Recall: a pair at the threshold shares none of the 32 bands of 4 values
    with probability 5e-6, and a Bayesian step drops it with 1e-7; every link
    given is confirmed on the full sets.

    Shape: one pass over the texts writes keys and signatures (260 bytes per
    document); band rows are shuffled twice (minimum per bucket, star join);
    the texts of documents in candidate pairs are fetched once by a semi join.
    Copies are collapsed first; hot buckets and hubs are split by adaptive
    execution, since their joins need no grouping.

    Edge cases: null or empty text has an empty set, is linked with nothing
    and keeps itself; fewer words than a shingle are one shingle; a null
    doc_id gets a null component and is kept; rows that repeat a doc_id are one
    document whose links are those of all its texts; an empty table gives an
    empty result; extra columns do not take part.
    """
    rows = stage(signatures(docs, shingle_words))
    named = rows.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    lead = stage(named.groupBy("set_key").agg(F.min("doc_id").alias("node")))
    classes = stage(named.join(lead, "set_key").where(F.col("doc_id") == F.col("node"))
                    .select("node", "n_shingles", "sig"))

    band = _band_rows(classes)
    hubs = (band.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top"))
            .where(F.col("hub") < F.col("top")).select("key", "hub"))
    members = stage(band.join(hubs, "key").where(F.col("node") != F.col("hub"))
                    .select("key", "hub", "node"))
    stars = stage(_bayes(members.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(),
                         classes, percent))

    # sets are needed for the pairs that survive, and for buckets of three or
    # more in which some pair did not (they may be compared further below)
    passed = stars.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.lit(1).alias("ok"))
    judged = members.join(passed, ["hub", "node"], "left")
    doubtful = (judged.groupBy("key", "hub").agg(F.count(F.lit(1)).alias("n"),
                                                 F.count("ok").alias("ok"))
                .where((F.col("n") > 1) & (F.col("ok") < F.col("n"))).select("key", "hub"))
    nodes = (stars.select(F.explode(F.array("a", "b")).alias("node"))
             .unionByName(members.select("key", "node").join(doubtful.select("key"), "key").select("node"))
             .distinct())
    sets = stage(_shingle_sets(docs, nodes, shingle_words))
    links = stage(_confirm(stars, sets, percent))
    comp = stage(components(links))

    # Buckets whose members are in several components stay open: what is apart
    # there is compared exactly, through the shingles that could link it.
    everyone = members.select("key", "node").unionByName(
        members.select("key", F.col("hub").alias("node")).distinct())
    nodes = _open_nodes(everyone, comp)
    if nodes.limit(1).count():
        last = _bayes(_apart(nodes, sets, percent), classes, percent)
        comp = components(stage(links.unionByName(_confirm(last, sets, percent))))

    own = (rows.select("doc_id", "n_shingles", "set_key").join(lead, "set_key", "left")
           .join(comp.select("node", "component"), "node", "left"))
    component = F.coalesce("component", "node", "doc_id")
    out = own.select("doc_id", "n_shingles",
                     F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_near_dups(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
sh AS (
  SELECT DISTINCT rid, doc_id, md5(array_to_string(words[i:i + 4], ' ')) AS s
  FROM w, LATERAL (SELECT unnest(range(1, greatest(2, len(words) - 3))) AS i) t WHERE len(words) > 0),
n AS (SELECT rid, doc_id, count(*) AS n FROM sh GROUP BY rid, doc_id),
linked AS (
  SELECT a.rid AS x, b.rid AS y
  FROM sh a JOIN sh b ON a.s = b.s AND a.rid <> b.rid
  GROUP BY a.rid, b.rid
  HAVING 100 * count(*) >= 75 * ((SELECT n FROM n WHERE rid = a.rid) + (SELECT n FROM n WHERE rid = b.rid) - count(*))),
reach(x, y) AS (
  SELECT rid, rid FROM w
  UNION
  SELECT reach.x, linked.y FROM reach JOIN linked ON reach.y = linked.x),
comp AS (SELECT reach.x AS rid, min(w.doc_id) AS component_id FROM reach JOIN w ON w.rid = reach.y GROUP BY reach.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (rid) JOIN comp USING (rid)
"""
