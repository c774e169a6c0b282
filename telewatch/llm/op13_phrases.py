"""Phrase collocations by SON partitioning.

The documents are cut into a few shards.  Every shard is mined completely for
phrases that reach the support lowered to the shard's share of the words; a
phrase that reaches the whole support reaches the lowered one in some shard, so
the union of the locally frequent phrases holds every frequent phrase.  A
second pass over all documents counts these candidates exactly, by their text.

Mining counts 64-bit hashes: two phrases that meet in one hash make a candidate
too many, never one too few, and the second pass counts texts.  The candidates
go to the second pass as a bit filter of bounded size; what it lets through by
mistake is counted too and falls to the support.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, mix, stage, table

SHARDS = 5                   # mined on their own; local support is about a fifth
SUPPORT = 10
MAX_WORDS = 3
KEEP_SHARE = 50              # per cent of a phrase that a longer one must cover to drop it
TOP = 2_000
SCALE = 1_000_000
NO_LANGUAGE = "und"
CHUNK = 1_000_000            # words (and four times the distinct words) held by a task
BUCKET_BYTES = 1 << 24       # text behind one bucket of phrase hashes
BITS_EACH = 16               # bits of the filter per candidate
MOST_BITS = 1 << 30          # 128 MB at most are broadcast
CUT = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
STEP = 0x9E3779B97F4A7C15


class _Vocabulary(dict):
    """Number of every word met, and their hashes in that order."""

    def __init__(self):
        self.words: list[bytes] = []

    def __missing__(self, word):
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


def _chunks(batches):
    """``(lang, vocabulary, ids, left)`` of bounded runs of documents: the word
    numbers in order, and how many words of its piece start at each of them."""
    held, size = {}, 0
    for batch in batches:
        texts: dict[str, list[bytes]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                texts.setdefault(lang, []).append(text)
        for lang, found in texts.items():
            words, ids, left = held.setdefault(lang, (_Vocabulary(), [], []))
            pieces = [p.split() for p in b"\n".join(found).lower().translate(CUT).split(b"\n")]
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            n, known = int(sizes.sum()), len(words)
            ids.append(np.fromiter(map(words.__getitem__, chain.from_iterable(pieces)), np.int64, n))
            left.append(np.repeat(np.cumsum(sizes), sizes) - np.arange(n))
            size += n + 4 * (len(words) - known)
        if size > CHUNK:
            for lang, (words, ids, left) in held.items():
                yield lang, words, np.concatenate(ids), np.concatenate(left)
            held, size = {}, 0
    for lang, (words, ids, left) in held.items():
        yield lang, words, np.concatenate(ids), np.concatenate(left)


def _hashes(lang: str, words: _Vocabulary, ids, left, longest: int):
    """``(size, places, hashes)`` of the phrases of every size up to ``longest``."""
    each = np.fromiter(map(xxhash.xxh64_intdigest, words.words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        h = mix(each ^ np.uint64(xxhash.xxh64_intdigest(lang.encode())))[ids]
        places, run = np.arange(len(ids)), h
        for size in range(1, longest + 1):
            if size > 1:
                go = left[places] >= size
                places, run = places[go], run[go]
                run = mix(run * np.uint64(STEP) + h[places + size - 1])
            yield size, places, run


def _counted(keys, counts):
    """Distinct keys in order and the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _bucket(keys, buckets: int):
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _places(keys, bits: int):
    """Two places of every key in a filter of ``bits`` (a power of two)."""
    low = np.uint64(bits - 1)
    return (keys & low).astype(np.int64), ((keys >> np.uint64(30)) & low).astype(np.int64)


def _locally_frequent(docs: DataFrame, buckets: int, shards: int, support: int, longest: int) -> DataFrame:
    """``bucket, lang, n, found, keys``: hashes of the phrases that are frequent
    in some shard, per bucket of hashes and language; ``n`` counts the words of
    the language.

    A shard is every ``shards``-th input partition.  A task counts its phrases
    first; a row per run of documents, bucket and language carries sorted
    distinct hashes, so one reducer holds one bucket of one language.
    """
    def count(batches):
        shard = TaskContext.get().partitionId() % shards
        for lang, words, ids, left in _chunks(batches):
            if not len(ids):
                continue
            keys, counts = np.unique(np.concatenate([h for _, _, h in _hashes(lang, words, ids, left, longest)]),
                                     return_counts=True)
            at = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1, dtype=np.uint64))
            cuts = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            counts = counts.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(buckets), pa.int32()), pa.array([lang] * buckets),
                 pa.array([shard] * buckets, pa.int32()), pa.array([len(ids)] * buckets, pa.int64()),
                 pa.array([keys[a:b].tobytes() for a, b in cuts], pa.binary()),
                 pa.array([counts[a:b].tobytes() for a, b in cuts], pa.binary())],
                names=["bucket", "lang", "shard", "words", "keys", "counts"])

    def mine(part: pa.Table) -> pa.Table:
        shard = part.column("shard").to_numpy()
        words = part.column("words").to_numpy()
        keys, counts = part.column("keys").to_pylist(), part.column("counts").to_pylist()
        n, frequent = int(words.sum()), []
        for s in np.unique(shard).tolist():
            rows = np.flatnonzero(shard == s)
            lowered = max(1, -(-support * int(words[rows].sum()) // n))
            k, c = _counted(np.frombuffer(b"".join([keys[i] for i in rows]), np.uint64),
                            np.frombuffer(b"".join([counts[i] for i in rows]), "<u4").astype(np.int64))
            frequent.append(k[c >= lowered])
        union = np.unique(np.concatenate(frequent))
        return pa.table({"bucket": pa.array([part.column("bucket")[0].as_py()], pa.int32()),
                         "lang": pa.array([part.column("lang")[0].as_py()]), "n": pa.array([n], pa.int64()),
                         "found": pa.array([len(union)], pa.int64()), "keys": pa.array([union.tobytes()], pa.binary())})

    counted = docs.mapInArrow(count, "bucket int, lang string, shard int, words long, keys binary, counts binary")
    return counted.groupBy("bucket", "lang").applyInArrow(
        mine, "bucket int, lang string, n long, found long, keys binary")


def _filter_bits(frequent: DataFrame, bits: int):
    """The bit filter of all candidates (``bits`` / 8 bytes), as a byte array.

    Every bucket of hashes sets its bits in pages of the filter, equal pages are
    joined by their reducers, and the driver receives ``bits`` / 8 bytes.
    """
    page = min(bits, 1 << 20)

    def mark(batches):
        for batch in batches:
            for keys in batch.column(0).to_pylist():
                at = np.unique(np.concatenate(_places(np.frombuffer(keys, np.uint64), bits)))
                cut = np.searchsorted(at, np.arange(0, bits + page, page))
                for p in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p], pa.int32()),
                         pa.array([(at[cut[p]:cut[p + 1]] - p * page).astype("<u4").tobytes()], pa.binary())],
                        names=["page", "at"])

    def join(part: pa.Table) -> pa.Table:
        flags = np.zeros(page, bool)
        for at in part.column("at").to_pylist():
            flags[np.frombuffer(at, "<u4")] = True
        return pa.table({"page": part.column("page").slice(0, 1),
                         "flags": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    pages = frequent.select("keys").mapInArrow(mark, "page int, at binary").groupBy("page").applyInArrow(
        join, "page int, flags binary")
    for row in pages.toLocalIterator():                       # at most MOST_BITS / 8 bytes in all
        out[row.page * page // 8:(row.page + 1) * page // 8] = np.frombuffer(row.flags, np.uint8)
    return out


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = MAX_WORDS,
                     shards: int = SHARDS) -> DataFrame:
    """``lang, phrase, size, f, n``: every phrase of up to ``longest`` words
    with at least ``support`` occurrences in its language, exactly counted.

    Words, pieces and languages are those of ``collocations``.

    Shape: one shuffle of sorted phrase hashes, counted within the tasks first;
    a reducer holds one bucket of one language, about ``BUCKET_BYTES`` of text
    whatever the size of the table.  The second pass shuffles the texts of the
    candidates only, counted within the tasks and again by partial aggregates.
    The filter has ``BITS_EACH`` bits per candidate and ``MOST_BITS`` at most;
    with more candidates it lets more phrases through, and the result is the
    same.
    """
    spark = docs.sparkSession
    arrow_batches(spark, 1024)
    texts = docs.select(F.col("text").cast("binary").alias("text"),
                        F.coalesce(F.col("lang"), F.lit(NO_LANGUAGE)).alias("lang"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    frequent = stage(_locally_frequent(texts, buckets, shards, support, longest))
    found = frequent.agg(F.sum("found")).first()[0] or 0
    bits = min(MOST_BITS, 1 << max(20, (BITS_EACH * found).bit_length()))
    sieve = spark.sparkContext.broadcast(_filter_bits(frequent, bits).tobytes())

    def count(batches):
        flags = np.frombuffer(sieve.value, np.uint8)

        def is_set(at):
            return (flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

        for lang, words, ids, left in _chunks(batches):
            for size, places, h in _hashes(lang, words, ids, left, longest):
                one, two = _places(h, bits)
                places = places[is_set(one) & is_set(two)]
                if not len(places):
                    continue
                # equal phrases have equal word numbers: counted by them, not by hashes
                rows = np.stack([ids[places + i] for i in range(size)])
                order = np.lexsort(rows[::-1])
                rows = rows[:, order]
                first = np.flatnonzero(np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)])
                counts = np.diff(np.r_[first, rows.shape[1]])
                for at in range(0, len(first), 65_536):
                    part = rows[:, first[at:at + 65_536]].T.tolist()
                    text = [b" ".join([words.words[i] for i in row]) for row in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(text)), pa.array(text, pa.binary()),
                         pa.array([size] * len(text), pa.int32()), pa.array(counts[at:at + 65_536], pa.int64())],
                        names=["lang", "phrase", "size", "f"])

    counted = texts.mapInArrow(count, "lang string, phrase binary, size int, f long")
    whole = (counted.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "size")
             .agg(F.sum("f").alias("f")).where(F.col("f") >= support))
    per_language = frequent.where("bucket = 0").select("lang", "n")
    return whole.join(per_language, "lang")


def _part(start, length) -> F.Column:
    return F.array_join(F.slice("w", start, length), " ")


def score(a: str, left: str, right: str) -> F.Column:
    """``floor(10**6 a a / (l r))`` of three columns of longs, in decimals."""
    return F.expr(f"(cast({a} AS decimal(19,0)) * cast({a} AS decimal(19,0)) * {SCALE}bd) "
                  f"div (cast({left} AS decimal(19,0)) * cast({right} AS decimal(19,0)))")


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = MAX_WORDS, top: int = TOP,
                 keep_share: int = KEEP_SHARE, shards: int = SHARDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of two to
    ``longest`` words of every language.

    Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and
    into words at spaces and tabs.  ``a`` counts the phrase within pieces,
    ``l`` and ``r`` the two sides of its lowest-scoring cut (the first such),
    ``n`` the words of the language; the score is ``floor(10**6 a a / (l r))``
    in decimals of 38 digits.  Phrases inside a longer candidate with at least
    ``keep_share`` per cent of their count are dropped.

    Edge cases: a null text is empty; a null language is ``und``; empty tables,
    and texts without words, give no rows; every row counts, equal ids and
    repeated rows included; very long texts are taken whole; ties go to the
    larger count, then to the phrase in byte order; extra columns do not take
    part.
    """
    known = stage(frequent_phrases(docs, support, longest, shards))
    longer = known.where(F.col("size") >= 2).withColumn("w", F.split("phrase", " ", -1))
    cuts = longer.select(
        "lang", "phrase", "size", "n", F.col("f").alias("a"), "w",
        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "size", "n", "a", "k", _part(F.lit(1), F.col("k")).alias("left"),
        _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    side = known.select("lang", "phrase", "f")
    scored = (cuts.join(side.withColumnsRenamed({"phrase": "left", "f": "l"}), ["lang", "left"])
              .join(side.withColumnsRenamed({"phrase": "right", "f": "r"}), ["lang", "right"]))
    best = scored.withColumn("score", score("a", "l", "r")).groupBy("lang", "phrase", "size", "n", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # pairs (first word, words) of the parts of a longer phrase that are candidates themselves
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.struct(i.alias("i"), m.alias("m")))))
    inside = (longer.where(F.col("size") > 2).select("lang", "f", "w", F.explode(spans).alias("s"))
              .groupBy("lang", _part(F.col("s.i"), F.col("s.m")).alias("phrase"))
              .agg(F.max("f").alias("around")))
    kept = (best.join(inside, ["lang", "phrase"], "left")
            .where(F.col("around").isNull() | (100 * F.col("around") < keep_share * F.col("a"))))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    return (kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
                    F.col("cut.score").cast("long").alias("score")))


def op13_phrases(spark, sf_dir) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM w
  UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS (SELECT lang, size, phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size >= 2),
cuts AS (
  SELECT lang, phrase, size, f AS a, 1 AS k, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM c
  UNION ALL
  SELECT lang, phrase, size, f, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE size = 3),
s AS (
  SELECT cuts.*, p.f AS l, q.f AS r,
         (1000000::HUGEINT * a * a) // (p.f::HUGEINT * q.f) AS score
  FROM cuts JOIN f p ON p.lang = cuts.lang AND p.phrase = x JOIN f q ON q.lang = cuts.lang AND q.phrase = y),
best AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, f FROM c WHERE size = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], f FROM c WHERE size = 3) GROUP BY 1, 2),
kept AS (
  SELECT best.* FROM best LEFT JOIN around o ON o.lang = best.lang AND o.phrase = best.phrase
  WHERE o.f IS NULL OR 100 * o.f < 50 * best.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""
