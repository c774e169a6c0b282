"""Shared helpers of the training-data operators.

* ``table`` / ``stage``: read a driver table; write an intermediate table to
  the shared folder named by ``spark.checkpoint.dir`` and read it back, so a
  lost executor never loses a stage.
* ``components``: connected components by alternating star contraction in
  plain DataFrame operations (distributed union-find; no collect, no RDD).
* ``word_hashes`` / ``window_hashes``: numpy helpers used inside tasks.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import materialize
from ..session import shuffles_dropped

# A word is a maximal run of characters other than space and \x09-\x0D; for
# bytes this is exactly what bytes.split() cuts.
WORD_PATTERN = r"([^\x20\x09-\x0D]+)"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    return materialize(df)


def arrow_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows per Arrow batch: documents can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _fingerprint(edges: DataFrame) -> tuple:
    with shuffles_dropped(edges.sparkSession):
        row = edges.agg(F.count(F.lit(1)).alias("n"),
                        F.bit_xor(F.xxhash64("src", "dst")).alias("x"),
                        F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("s")).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(src, dst)``.

    Returns ``(node, component)`` for every node that occurs in a link;
    ``component`` is the smallest node reachable.  Each round contracts every
    neighbourhood onto its minimum (large star, then small star), so the
    number of rounds is logarithmic in the longest chain.  Minima are partial
    aggregates and the joins carry one row per edge: a hub with many
    neighbours is split by adaptive execution, never gathered.  Node ids must
    be orderable and not null; self links are ignored.
    """
    edges = stage(links.select(F.greatest("src", "dst").alias("src"),
                               F.least("src", "dst").alias("dst"))
                  .where(F.col("src") != F.col("dst")).distinct())
    state = _fingerprint(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = (both.groupBy("src").agg(F.min("dst").alias("m"))
               .withColumn("m", F.least("m", "src")))
        large = (both.join(low, "src").where(F.col("dst") > F.col("src"))
                 .select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct())
        large = stage(large)
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = (large.join(low, "src").where(F.col("dst") != F.col("m"))
                 .select(F.col("dst").alias("src"), F.col("m").alias("dst"))
                 .unionByName(low.select("src", F.col("m").alias("dst"))).distinct())
        edges = stage(small)
        new = _fingerprint(edges)
        if new == state:
            break
        state = new
    return (edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
            .unionByName(edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")))
            .distinct())


def components_with(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links behind ``comp`` (written) and of further
    ``links``: only what the new links join is contracted again."""
    new = stage(links.join(comp.toDF("src", "_a"), "src", "left").join(comp.toDF("dst", "_b"), "dst", "left")
                .select(F.coalesce("_a", "src").alias("src"), F.coalesce("_b", "dst").alias("dst"))
                .where(F.col("src") != F.col("dst")).distinct())
    top = stage(components(new).toDF("_node", "_top"))
    moved = (comp.join(top, F.col("component") == F.col("_node"), "left")
             .select("node", F.coalesce("_top", "component").alias("component")))
    fresh = top.join(comp, F.col("_node") == F.col("node"), "left_anti").toDF("node", "component")
    return moved.unionByName(fresh)


BITMAP = 8                  # words of 64 bits


def pairs_apart(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of nodes of different components that can still be similar.

    ``rows(node, comp, n, s)`` has a row per element ``s`` of every set, ``n``
    its size.  An exact prefix filter for a Jaccard similarity of ``percent``:
    with the elements of every set in one order (rarest first), two similar
    sets share one among the first ``n - ceil(t n) + 1``, and the first one
    they share leaves enough behind it in both.  Members of the largest
    component at an element are not compared with each other there, so a large
    group of similar sets costs one row per member, not a row per pair.  A
    bitmap of ``64 * BITMAP`` bits per set goes along: every bit that only one of two sets
    has stands for an element that the other lacks, so sets with more such bits
    than a similar pair has elements apart make no row.
    """
    seen = rows.groupBy("s").agg(F.count(F.lit(1)).alias("f"))
    order = Window.partitionBy("node").orderBy("f", "s")
    first = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    whole = Window.partitionBy("node")

    def bits(part: int) -> Column:
        mine = F.when(F.pmod("s", F.lit(BITMAP)) == part, F.expr(f"shiftleft(1L, cast((s >> {BITMAP.bit_length() - 1}) & 63 AS int))"))
        return F.coalesce(F.bit_or(mine).over(whole), F.lit(0).cast("long"))
    maps = [f"_b{k}" for k in range(BITMAP)]
    prefix = stage(rows.join(seen, "s").withColumns({"i": F.row_number().over(order)} | {m: bits(k) for k, m in enumerate(maps)})
                   .where((F.col("i") <= first) & (F.col("f") > 1)).drop("f"))
    top = stage(prefix.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("c"))
                .groupBy("s").agg(F.max_by("comp", F.struct("c", "comp")).alias("top")))
    few = prefix.join(top, "s").where(F.col("comp") != F.col("top"))
    a, b = few.alias("a"), prefix.alias("b")
    behind = 1 + F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i"))
    unlike = sum(F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in maps)
    pairs = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.comp") != F.col("b.comp"))
                   & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n"))
                   & ((100 + percent) * behind >= percent * (F.col("a.n") + F.col("b.n")))
                   & ((100 + percent) * unlike <= (100 - percent) * (F.col("a.n") + F.col("b.n"))))
    return pairs.select(F.least("a.node", "b.node").alias("a"),
                        F.greatest("a.node", "b.node").alias("b")).distinct()


# ---------------------------------------------------------------- numpy side

@lru_cache(maxsize=16)
def _powers(n: int, base: int):
    import numpy as np
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    b = np.uint64(base)
    with np.errstate(over="ignore"):
        step = b
        while filled < n:                      # doubling: out[f:2f] = out[:f] * base**f
            m = min(filled, n - filled)
            out[filled:filled + m] = out[:m] * step
            filled += m
            step = step * step
    return out


BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x):
    """Finalizer of a 64-bit hash (avalanche), vectorised."""
    import numpy as np
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(words: list):
    """One 64-bit hash per word (bytes)."""
    import numpy as np
    import xxhash
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(h, length: int, which: int = 0):
    """Hash of every window of ``length`` consecutive word hashes.

    Polynomial hash modulo 2**64 by prefix sums (the base is odd, so its
    inverse shifts every window to power 0), then mixed; ``which`` picks one
    of two independent hashes.
    """
    import numpy as np
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    size = 1 << max(10, int(len(h)).bit_length())
    p = _powers(size, BASES[which])
    back = _powers(size, pow(BASES[which], -1, 1 << 64))
    with np.errstate(over="ignore"):
        v = mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) if which else h
        s = np.empty(len(h) + 1, np.uint64)
        s[0] = 0
        np.cumsum(v * p[:len(h)], out=s[1:])
        return mix((s[length:] - s[:n]) * back[:n])
