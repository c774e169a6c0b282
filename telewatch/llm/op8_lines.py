"""Fuzzy line dedup by MinHash, in DataFrame functions only.

Lines of all documents are compared; of every group of similar lines one is
kept.  Equal lines are one class.  A line is the set of its character
shingles; candidates share a band of minima, are verified by the exact Jaccard
similarity of their shingle sets, and the links are joined by a distributed
union-find.

* Shingles are 12 characters, started at every word and every 10 characters
  inside longer words, so all characters count and a line has few of them.
* Minima: the shingle hashes lie on a circle, and the first hashes after a
  fixed point are the smallest ones of the set in a rotated order.  The first
  three after each of ten points are the bands.
* A bucket emits a star: all its members against one of them.  What stays apart
  in a bucket after that meets through an exact prefix filter.
* Before the wide rows are shuffled a second time, a bit filter of fixed size
  (broadcast, at most 2**18 words) drops most of those that cannot meet a
  partner; the exact join follows, so the filter only saves work.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, components, components_with, pairs_apart, stage, table

SHINGLE = r"(?s)(?=(.{1,12}))[^ ]{1,10}+ *+"
SPACES = " \t\n\x0b\x0c\r"     # the characters of SPACE_CLASS
PERCENT = 80
POINTS = [k * (1 << 64) // 10 - (1 << 63) for k in range(10)]    # on the circle of 64-bit hashes
FILTER_WORDS = 1 << 18       # of 64 bits: the size of the broadcast filter


def text_lines(text: Column) -> Column:
    """Lines of a text, in order (a null text has none)."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """What is compared: the line with runs of white space as one space."""
    runs = reduce(or_, [F.contains(line, F.lit(c)) for c in ["  ", *SPACES[1:]]])
    return F.trim(F.when(runs, F.regexp_replace(line, SPACE_CLASS + "+", " ")).otherwise(line))


def blank(line: Column) -> Column:
    """Whether nothing of the line is compared."""
    return F.ltrim(line, F.lit(SPACES)) == ""


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id, rk, line_no, line`` of every line that is not blank."""
    # beside the generator the checksum would be taken of the whole text for every line
    texts = docs.select("doc_id", F.crc32("text").alias("rk"), text_lines(F.col("text")).alias("_lines"))
    return (texts.select("doc_id", "rk", F.posexplode("_lines").alias("line_no", "line")).where(~blank(F.col("line")))
            .withColumn("line", line_key(F.col("line"))))


def _hashes(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit(SHINGLE), F.lit(1)), lambda s: F.xxhash64(s))


def shingles(line: Column) -> Column:
    """Distinct shingle hashes, sorted."""
    return F.sort_array(F.array_distinct(_hashes(line)))


def signed_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, rk, line_no, node, h, keys`` of every line that is not blank:
    128-bit digest, 64-bit hash and band keys (no text)."""
    lines = _rows(docs).select("doc_id", "rk", "line_no", F.unhex(F.md5("line")).alias("node"),
                               F.xxhash64("line").alias("h"), "line").withColumn("sh", shingles(F.col("line")))
    return _with_bands(lines).select("doc_id", "rk", "line_no", "node", "h", "keys")


def _with_bands(rows: DataFrame) -> DataFrame:
    """Adds ``keys``: one per band.  Needs ``sh`` (``shingles``) as a column."""
    # sorted among the hashes, a point has the hashes and points below it before it
    laid = rows.withColumn("_laid", F.sort_array(F.concat("sh", F.array(*map(F.lit, POINTS)))))
    laid = laid.withColumn("_ring", F.concat("sh", "sh", "sh", "sh"))
    keys = [F.xxhash64(F.lit(k), F.slice("_ring", (F.array_position("_laid", F.lit(p)) - k).cast("int"), 3))
            for k, p in enumerate(POINTS)]
    return laid.withColumn("keys", F.array(*keys)).drop("_laid", "_ring")


def _maybe_in(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``column`` (a hash) may be in ``wanted``; none that is gets lost."""
    word = F.shiftright(F.col(column), 6).bitwiseAND(F.lit(FILTER_WORDS - 1))
    bits = (wanted.select(word.alias("_word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("_bit"))
            .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    return (rows.withColumn("_word", word).join(F.broadcast(bits), "_word")
            .where(F.expr(f"(shiftrightunsigned(_bits, cast({column} & 63 as int)) & 1) = 1"))
            .drop("_word", "_bits"))


def _similar(x: Column, y: Column, percent: int) -> Column:
    common = F.size(F.array_intersect(x, y))
    return 100 * common >= percent * (F.size(x) + F.size(y) - common)


def similar_lines(docs: DataFrame, signed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(node, component)`` of the lines with a similar line; a node is the
    128-bit digest of the compared line.  ``signed`` is ``signed_lines(docs)``,
    written."""
    band = signed.select("h", F.explode_outer("keys").alias("key"))
    hubs = stage(band.groupBy("key").agg(F.min("h").alias("hub"), F.max("h").alias("top"))
                 .where(F.col("hub") < F.col("top")).select("key", "hub"))
    members = stage(_maybe_in(band, "key", hubs).join(hubs, "key").where(F.col("h") != F.col("hub"))
                    .select("key", "hub", "h").distinct())
    wanted = stage(members.select(F.explode(F.array("hub", "h")).alias("h")).distinct())
    lines = _rows(docs).select("line").withColumn("h", F.xxhash64("line"))
    # no semi join: Spark would move it below the bit filter, and all lines would be shuffled
    sets = stage(_maybe_in(lines, "h", wanted).select("h", F.unhex(F.md5("line")).alias("node"), "line")
                 .dropDuplicates(["h", "node"]).join(wanted, "h")
                 .select("h", "node", shingles(F.col("line")).alias("sh")))

    def verify(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("h").alias("a"), F.col("node").alias("src"), F.col("sh").alias("x"))
        b = sets.select(F.col("h").alias("b"), F.col("node").alias("dst"), F.col("sh").alias("y"))
        return (pairs.join(a, "a").join(b, "b").where(_similar(F.col("x"), F.col("y"), percent))
                .select("src", "dst"))

    links = stage(verify(members.select(F.col("hub").alias("a"), F.col("h").alias("b")).distinct()))
    comp = stage(components(links))
    # What is still apart in a bucket is compared exactly, through the shingles
    # that could link it.
    everyone = members.select("key", "h").unionByName(members.select("key", F.col("hub").alias("h")).distinct())
    rest = _open(everyone, sets, comp)
    rows = rest.join(sets.select("h", "sh"), "h").select(
        F.col("h").alias("node"), "comp", F.size("sh").alias("n"), F.explode_outer("sh").alias("s"))
    return components_with(comp, stage(verify(pairs_apart(rows, percent))))


def _open(members: DataFrame, sets: DataFrame, comp: DataFrame) -> DataFrame:
    """``(h, comp)`` of the lines in buckets with several components.  A bucket
    of two is finished: its one pair was the star."""
    place = (sets.select("h", "node").join(comp, "node", "left")
             .groupBy("h").agg(F.min(F.coalesce("component", "node")).alias("comp")))
    placed = stage(members.join(place, "h"))
    several = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where(
        (F.col("low") < F.col("high")) & (F.col("n") > 2))
    return placed.join(several.select("key"), "key").select("h", "comp").distinct()


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with only the first line of every group of similar lines.

    ``text`` keeps blank lines and the lines that stay, joined by ``\\n``;
    ``n_lines`` and ``n_removed`` (long) are added.  Lines are similar when the
    Jaccard similarity of their shingle sets is at least ``percent``; groups
    are connected components, and the line with the smallest (doc_id, line
    number) of a group stays.

    Recall: a pair of long lines with similarity s shares none of the ten bands
    of three minima with probability (1 - s**3)**10 (0.1 % at 0.8; simulated
    for 5 to 400 shingles: at most 0.2 %, at nine shingles); links given are
    exact.

    Shape: one pass over the texts writes digests and band keys (about 110 bytes
    per line); equal lines meet in a partial aggregate on the digest, band rows
    in a partial minimum and a star join on the band key that adaptive
    execution can split; the texts of candidates are fetched behind the bit
    filter, and all texts are shuffled once by document at the end.  No line,
    bucket or group is gathered.

    Edge cases: null text counts as '' and stays null; blank lines are never
    removed; a null doc_id comes after every id; rows equal in doc_id and text
    are judged alike (all keep the same lines); a document may lose all its
    lines and keeps its row; an empty table gives an empty result; extra
    columns are kept (``n_lines`` and ``n_removed`` are replaced).
    """
    signed = stage(signed_lines(docs))
    comp = similar_lines(docs, signed, percent)
    first = (signed.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "rk",
                                                 "line_no")).alias("first")))
    placed = first.join(comp, "node", "left")
    alone = placed.where(F.col("component").isNull()).select("first")
    groups = placed.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("first").alias("first"))
    kept = (alone.unionByName(groups.select("first"))
            .groupBy(F.col("first.doc_id").alias("_doc"), F.col("first.rk").alias("_rk"))
            .agg(F.collect_list("first.line_no").alias("_kept")))
    base = docs.drop("n_lines", "n_removed").withColumn("_crc", F.crc32("text"))
    joined = base.join(kept, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_crc") == F.col("_rk")), "left")
    joined = joined.withColumn("_lines", text_lines(F.col("text")))
    blanks = F.filter(F.transform("_lines", lambda s, i: F.when(blank(s), i)), lambda i: i.isNotNull())
    joined = joined.withColumn("_stay", F.sort_array(F.array_union(blanks, F.coalesce(
        "_kept", F.expr("cast(array() as array<int>)")))))
    return (joined.withColumn("n_lines", F.size("_lines").cast("long"))
            .withColumn("n_removed", (F.size("_lines") - F.size("_stay")).cast("long"))
            .withColumn("text", F.when(F.col("text").isNotNull(), F.array_join(
                F.transform("_stay", lambda i: F.get("_lines", i)), "\n")))
            .drop("_doc", "_rk", "_kept", "_crc", "_lines", "_stay"))


def op8_lines(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


SQL = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, rid, unnest(lines) AS raw, unnest(range(0, len(lines))) AS line_no
  FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (
  SELECT doc_id, rid, raw, line_no, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM l),
d AS (SELECT line, row_number() OVER () AS n FROM (SELECT DISTINCT line FROM k WHERE line <> '')),
chunk AS (
  SELECT n, line, regexp_extract_all(line, '[^ ]{1,10} *') AS parts FROM d),
sh AS (
  SELECT DISTINCT n, substr(line, 1 + coalesce(list_sum(list_transform(parts[1:i - 1], lambda p: length(p))), 0)::BIGINT, 12) AS s
  FROM chunk, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) t),
c AS (SELECT n, count(*) AS c FROM sh GROUP BY n),
linked AS (
  SELECT a.n AS x, b.n AS y FROM sh a JOIN sh b ON a.s = b.s AND a.n <> b.n
  GROUP BY a.n, b.n
  HAVING 100 * count(*) >= 80 * ((SELECT c FROM c WHERE n = a.n) + (SELECT c FROM c WHERE n = b.n) - count(*))),
reach(x, y) AS (SELECT n, n FROM d UNION SELECT reach.x, linked.y FROM reach JOIN linked ON reach.y = linked.x),
comp AS (SELECT x AS n, min(y) AS comp FROM reach GROUP BY x),
first AS (
  SELECT comp, min((doc_id, line_no)) AS f FROM k JOIN d USING (line) JOIN comp USING (n) GROUP BY comp),
stay AS (
  SELECT k.rid, k.doc_id, k.line_no, raw, line = '' OR (k.doc_id, k.line_no) = f AS stays
  FROM k LEFT JOIN d USING (line) LEFT JOIN comp USING (n) LEFT JOIN first USING (comp))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE NOT stays)::BIGINT AS n_removed,
  coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (WHERE stays), '') AS text
FROM stay GROUP BY rid, doc_id
"""
