"""Hard negatives of anchors through bounds along spanning trees of anchors.

Anchors that lie close together share a minimum spanning tree.  Against a block
of candidates the root of a tree is scored exactly; from there every child takes
its parent's scores, plus or minus the length of the edge times the norm of the
candidate, as bounds of its own (Cauchy-Schwarz).  Only candidates whose bounds
can still reach the best positives, or overlap the window of scores a positive
opens, are scored again.  The result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, stage, table

SCALE = 256
ANCHOR_EVERY = 100
SHIFT_EVERY, LABELS = 7, 10  # labels of these ids move on by one
POSITIVES = 5
NEGATIVES = 5
LEAST = 80                   # per cent of the positive's score that a negative reaches
PIVOTS = 64                  # bounded sample that orders the blocks; no result depends on it
PER_TREE = 256               # anchors per tree aimed at
TREES = 8                    # trees compared with a block by one task
PER_BLOCK = 8_192            # candidates per block aimed at
SLACK = 1e-9                 # relative room for rounding in the bounds
TOP = (1 << 63) - 1


def _matrix(column, dim: int):
    """A list column as float64 rows, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(column) * dim:
        size = column.value_lengths().to_numpy(zero_copy_only=False) if len(column) else np.empty(0)
        if (size == dim).all():
            return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column.to_pylist()):
        out[i, :len(v)] = v
    return out


def _lists(m) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def _distances(a, b):
    sq = (a ** 2).sum(axis=1)[:, None] + (b ** 2).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, sq))


def spanning_tree(m):
    """``(order, parent, edge)`` of a minimum spanning tree of the rows of ``m``:
    rows in an order in which parents come first, the row of each parent
    (-1 for the root), and the distance to it."""
    n = len(m)
    order, parent, edge = [0], np.full(n, -1), np.zeros(n)
    near, best = np.zeros(n, np.int64), np.sqrt(((m - m[0]) ** 2).sum(axis=1))
    best[0] = np.inf
    for _ in range(n - 1):
        i = int(best.argmin())
        order.append(i)
        parent[i], edge[i] = near[i], best[i]
        d = np.sqrt(((m - m[i]) ** 2).sum(axis=1))
        closer = d < best
        closer[order] = False
        near[closer], best[closer] = i, d[closer]
        best[i] = np.inf
    return order, parent, edge


class Candidates:
    """A block of candidates: exact scores as longs, whatever the components."""

    def __init__(self, ids, labels, m):
        self.ids, self.labels, self.m = ids, labels, m
        self.norm = np.sqrt((m ** 2).sum(axis=1))
        self.peak = np.abs(m).max(axis=1, initial=0.0)

    def scores(self, anchor, rows):
        """Inner products of an anchor and some rows, and two marks of each.

        A product from 0 to ``TOP`` is exact; a larger one is ``TOP`` and marked
        beyond; where components are wide, a negative one may be -1.  The second
        mark tells both: the number given is not the product.
        """
        if np.abs(anchor).max(initial=0.0) * self.peak[rows].max(initial=0.0) * len(anchor) < 1 << 53:
            exact = np.zeros(len(rows), bool)
            return (self.m[rows] @ anchor).astype(np.int64), exact, exact
        wide = np.abs(anchor).max() * self.peak[rows] * len(anchor) >= 1 << 53
        out, beyond, clipped = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool), np.zeros(len(rows), bool)
        out[~wide] = (self.m[rows[~wide]] @ anchor).astype(np.int64)
        a = [int(x) for x in anchor.tolist()]
        for i in np.flatnonzero(wide).tolist():
            s = sum(p * int(q) for p, q in zip(a, self.m[rows[i]].tolist(), strict=True) if p and q)
            out[i], beyond[i], clipped[i] = max(-1, min(s, TOP)), s > TOP, not 0 <= s <= TOP
        return out, beyond, clipped


def _kth_largest(x, k: int) -> float:
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else -np.inf


def walk(tree, cand: Candidates, want):
    """Bounds and exact scores along one tree.

    ``tree`` has ``ids, m, parent, edge`` in an order with parents first;
    ``want(i, low, high)`` gives the rows of anchor ``i`` to score exactly, and
    this yields ``(i, rows, scores, beyond)``.
    """
    norms = np.sqrt((tree["m"] ** 2).sum(axis=1))
    low, high = (np.empty((len(tree["ids"]), len(cand.ids))) for _ in range(2))
    every = np.arange(len(cand.ids))
    for i, parent in enumerate(tree["parent"]):
        room = SLACK * norms[i] * cand.norm + 1
        if parent < 0:
            rows = every
        else:
            reach = tree["edge"][i] * (1 + SLACK) * cand.norm + room
            low[i], high[i] = low[parent] - reach, high[parent] + reach
            rows = want(i, low[i], high[i])
        scores, beyond, clipped = cand.scores(tree["m"][i], rows)
        low[i, rows], high[i, rows] = scores - room[rows], scores + room[rows]
        if clipped.any():                          # what was clipped bounds nothing: the norms do
            far = rows[clipped]
            most = norms[i] * cand.norm[far] * (1 + SLACK) + 1
            low[i, far], high[i, far] = -most, most
        yield i, rows, scores, beyond


def best_positives(tree, cand: Candidates, k: int):
    """``anchor_id, vec_id, score`` of the k best same-label rows in the block
    (scores below 0 open no window and are left out)."""
    def same(i):
        return (cand.labels == tree["labels"][i]) & (cand.ids != tree["ids"][i])

    def want(i, low, high):
        rows = np.flatnonzero(same(i) & (high >= 0))
        return rows[high[rows] >= _kth_largest(low[rows], k)]

    for i, rows, scores, beyond in walk(tree, cand, want):
        ok = same(i)[rows] & (scores >= 0)
        rows, scores, beyond = rows[ok], scores[ok], beyond[ok]
        best = np.lexsort((cand.ids[rows], -scores))[:k]
        if beyond[best].any():
            raise OverflowError(f"the score of anchor {tree['ids'][i]} and vector {cand.ids[rows[best[0]]]} "
                                "does not fit a long")
        for j in best.tolist():
            yield int(tree["ids"][i]), int(cand.ids[rows[j]]), int(scores[j])


def window_negatives(tree, cand: Candidates, k: int, least: int):
    """``anchor_id, place, vec_id, score`` of the k best rows of another label in
    the window of every positive; ``tree["wins"][i]`` lists (place, score)."""
    def other(i):
        return cand.labels != tree["labels"][i]

    def window(score):
        return -(-least * score // 100), score

    def want(i, low, high):
        ok, chosen = other(i), np.zeros(len(low), bool)
        for _, score in tree["wins"][i]:
            a, b = window(score)
            inside = ok & (high >= a) & (low <= b)
            sure = low[inside & (low >= a) & (high <= b)]
            chosen |= inside & (high >= _kth_largest(sure, k))
        return np.flatnonzero(chosen)

    for i, rows, scores, beyond in walk(tree, cand, want):
        ok = other(i)[rows] & ~beyond
        for place, score in tree["wins"][i]:
            a, b = window(score)
            hit = np.flatnonzero(ok & (scores >= a) & (scores <= b))
            for j in hit[np.lexsort((cand.ids[rows[hit]], -scores[hit]))[:k]].tolist():
                yield int(tree["ids"][i]), place, int(cand.ids[rows[j]]), int(scores[j])


def labelled(vectors: DataFrame, shift_every: int = SHIFT_EVERY, labels: int = LABELS) -> DataFrame:
    """``vec_id, label, embedding`` (doubles) of the rows that take part."""
    v = F.col("embedding")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                  & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    label = F.col("label").cast("long")
    return (vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(ok)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.when(F.col("vec_id") % shift_every == 0, (label + 1) % labels).otherwise(label).alias("label"),
                    v.cast("array<double>").alias("embedding")))


def _keyed(rows: DataFrame, dim: int, scale: int, centre) -> DataFrame:
    """Integer components, nearest pivot and the distance to it."""
    def key(batches):
        for batch in batches:
            m = np.floor(_matrix(batch.column(2), dim) * scale)
            if not np.isfinite(m).all():
                raise OverflowError("a component is too large to be scaled")
            d = _distances(m, centre)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _lists(m), pa.array(near, pa.int32()),
                 pa.array(d[np.arange(len(d)), near])], names=["vec_id", "label", "v", "pivot", "r"])

    return rows.mapInArrow(key, "vec_id long, label long, v array<double>, pivot int, r double")


def _trees(anchors: DataFrame, dim: int) -> DataFrame:
    """A row per anchor with its tree: group of trees, place in the tree
    (parents first), place of the parent, and length of the edge."""
    def span(part: pa.Table) -> pa.Table:
        part = part.sort_by("vec_id")
        m = _matrix(part.column("v"), dim)
        order, parent, edge = spanning_tree(m)
        place = np.empty(len(m), np.int64)
        place[order] = np.arange(len(m))
        up = np.where(parent < 0, -1, place[parent])
        return pa.table({"grp": pa.array(part.column("tree").to_numpy() // TREES, pa.int32()), "tree": part.column("tree"),
                         "place": pa.array(place, pa.int32()), "parent": pa.array(up, pa.int32()), "edge": pa.array(edge),
                         "anchor_id": part.column("vec_id"), "label": part.column("label"), "v": part.column("v")})

    return anchors.groupBy("tree").applyInArrow(
        span, "grp int, tree int, place int, parent int, edge double, anchor_id long, label long, v array<double>")


def _split(left: pa.Table, dim: int):
    """The trees of a group."""
    left = left.sort_by([("tree", "ascending"), ("place", "ascending")])
    tree = left.column("tree").to_numpy()
    m = _matrix(left.column("v"), dim)
    columns = {c: left.column(c).to_numpy() for c in ("anchor_id", "label", "parent", "edge")}
    wins = left.column("wins").to_pylist() if "wins" in left.column_names else None
    cut = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1], True]) if len(tree) else []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        out = {"ids": columns["anchor_id"][a:b], "labels": columns["label"][a:b], "m": m[a:b],
               "parent": columns["parent"][a:b], "edge": columns["edge"][a:b]}
        if wins is not None:
            out["wins"] = [[(w["place"], w["score"]) for w in row or []] for row in wins[a:b]]
        yield out


def _visit(pairs: DataFrame, trees: DataFrame, blocks: DataFrame, dim: int, work, names, kinds) -> DataFrame:
    """``work(tree, candidates)`` over every (grp, block) of ``pairs``."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            cand = Candidates(right.column("vec_id").to_numpy(), right.column("label").to_numpy(),
                              _matrix(right.column("v"), dim))
            for tree in _split(left, dim):
                rows.extend(work(tree, cand))
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    pairs = stage(pairs)                                          # a row per group and block
    asked = trees.join(pairs, "grp")
    held = blocks.join(pairs, "block").select(
        F.col("grp").alias("grp"), F.col("block").alias("block"), "vec_id", "label", "v")
    return asked.groupBy("grp", "block").cogroup(held.groupBy("grp", "block")).applyInArrow(run, kinds)


def hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST,
                   anchor_every: int = ANCHOR_EVERY, scale: int = SCALE, per_tree: int = PER_TREE,
                   per_block: int = PER_BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``: for every anchor (``vec_id`` divisible by ``anchor_every``)
    and each of its ``positives`` best rows of the same label, the ``negatives``
    best rows of another label that score from ``least`` to 100 per cent of it.

    Shape: candidates are written in blocks of bounded size, sorted by label and
    nearest pivot; anchors in trees of bounded size in the same order.  Groups
    of trees meet blocks (rows per pair of group and block, not of anchor and
    candidate): the positives only those blocks that hold a label of theirs.  A
    task gives the best few rows per anchor (and window) of its block; the last
    choice is a window over those.

    Edge cases: rows with a null id, label or vector or a null or non-finite
    component take no part; rows with the id of an anchor are its own; an anchor
    id that occurs twice is asked once (its smallest label and vector); other
    repeated rows count each; shorter vectors count as filled with zeros; a
    positive below 0 has an empty window; scores are exact at any size, and a
    positive whose score does not fit a long raises; fewer rows than asked for
    give fewer; empty tables give an empty result; extra columns do not take part.
    """
    spark = vectors.sparkSession
    arrow_batches(spark, 4096)
    rows = labelled(vectors)
    is_anchor = F.col("vec_id") % anchor_every == 0
    n, n_anchors, dim = rows.agg(F.count(F.lit(1)), F.count_if(is_anchor), F.max(F.size("embedding"))).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors or not dim:
        return spark.createDataFrame([], out)
    sample = rows.where(is_anchor).orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(PIVOTS).select("embedding")
    centre = np.zeros((PIVOTS, dim))
    for i, r in enumerate(sample.collect()):                      # at most PIVOTS vectors
        centre[i, :len(r.embedding)] = np.floor(np.array(r.embedding) * scale)
    keyed = stage(_keyed(rows, dim, scale, centre))
    n_blocks = max(8, -(-n // per_block))
    blocks = stage(keyed.repartitionByRange(n_blocks, "label", "pivot", "r", "vec_id")
                   .withColumn("block", F.spark_partition_id()))
    single = (keyed.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v", "pivot", "r")).alias("a"))
              .select("vec_id", "a.*"))
    laid = stage(single.repartitionByRange(max(1, -(-n_anchors // per_tree)), "label", "pivot", "r", "vec_id")
                 .withColumn("tree", F.spark_partition_id()))
    trees = stage(_trees(laid, dim))

    holds = stage(blocks.select("block", "label").distinct())
    asks = trees.select("grp", "label").distinct()
    near = _visit(asks.join(holds, "label").select("grp", "block").distinct(), trees, blocks, dim,
                  lambda tree, cand: best_positives(tree, cand, positives),
                  ["anchor_id", "positive_id", "score"], "anchor_id long, positive_id long, score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    chosen = stage(near.withColumn("place", F.row_number().over(first).cast("long")).where(F.col("place") <= positives))
    wins = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("wins"))

    groups = trees.select("grp").distinct()
    pairs = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    found = _visit(pairs, trees.join(wins, "anchor_id", "left"), blocks, dim,
                   lambda tree, cand: window_negatives(tree, cand, negatives, least),
                   ["anchor_id", "place", "negative_id", "negative_score"],
                   "anchor_id long, place long, negative_id long, negative_score long")
    last = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= negatives)
    return (ranked.join(chosen, ["anchor_id", "place"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                    F.col("score").alias("positive_score"), "negative_score"))


def op11_hard_negatives(spark, sf_dir) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_dot_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
       AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
