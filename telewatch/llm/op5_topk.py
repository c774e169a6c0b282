"""Exact top-k inner products through a pivot-distance index.

Vectors are lifted to a sphere (one more coordinate makes all norms equal), so
the largest inner product is the smallest distance.  Every vector is keyed by
its nearest pivot and the distance to it; sorted by that key, the table is cut
into annuli of bounded size.  A query first visits its most promising annulus;
the k-th score found there and the triangle inequality then exclude every
annulus that cannot hold a better one, and the rest are visited in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, stage, table

SCALE = 256
K = 5
QUERY_EVERY = 50
PIVOTS = 64                  # bounded sample that fits the index
PER_CELL = 4_096             # vectors per annulus aimed at
PER_BLOCK = 1_024            # queries visited together
LIMIT = 1 << 63              # a scaled component from here on does not fit a long itself
SLACK = 1e-6                 # relative room for rounding in the bounds


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` (long components ``floor(scale * x)``, x as double) of the
    rows that take part: id and vector not null, every component finite and a
    long when scaled."""
    v = F.col("embedding")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                  & (F.abs(x.cast("double") * scale) < F.lit(float(LIMIT))))
    return (vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(ok)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v")))


def _matrix(lists, dim: int):
    out = np.zeros((len(lists), dim), np.int64)
    for i, v in enumerate(lists):
        out[i, :len(v)] = v
    return out


def _peak(m) -> int:
    return max(int(m.max()), -int(m.min()))


def _dot(a, b):
    """Exact integer products, and a matrix of -1, 0 or 1: below, inside or
    above what a long holds (None when all are inside); by BLAS while doubles
    hold every sum."""
    if not a.size or not b.size:
        return a @ b.T, None
    most = _peak(a) * _peak(b) * a.shape[1]
    x, y = a.astype(np.float64), b.astype(np.float64)
    if most < 1 << 53:
        return (x @ y.T).astype(np.int64), None
    low = a @ b.T                                      # exact modulo 2**64
    if most < 1 << 63:
        return low, None
    # a double sum tells the multiple of 2**64 where its error is far below one
    high = np.rint((x @ y.T - low) / 2.0 ** 64)
    error = (np.abs(x) @ np.abs(y).T) * ((a.shape[1] + 4) * 2.0 ** -52)
    for i, j in np.argwhere(error >= 2.0 ** 61).tolist():
        high[i, j] = sum(p * q for p, q in zip(a[i].tolist(), b[j].tolist(), strict=True)) + (1 << 63) >> 64
    return low, np.sign(high).astype(np.int8)


def _lift(m, top: float):
    norm = (m.astype(np.float64) ** 2).sum(axis=1)
    return np.hstack([m.astype(np.float64), np.sqrt(np.maximum(0.0, top - norm))[:, None]])


def _distances(a, b):
    """Distances between the rows of two float matrices."""
    sq = (a ** 2).sum(axis=1)[:, None] + (b ** 2).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, sq))


def _visit(pairs: DataFrame, queries: DataFrame, cells: DataFrame, dim: int, k: int) -> DataFrame:
    """Exact scores of ``pairs(query_id, cell)``: at most k per pair, null if too low for a long."""
    asked = pairs.join(queries, "query_id").select("cell", "block", "query_id", "q")
    visited = asked.select("cell", F.col("block").alias("to")).distinct()
    held = cells.join(visited, "cell").select("cell", F.col("to").alias("block"), "vec_id", "v")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = np.array(left.column("query_id").to_pylist(), np.int64)
        q = _matrix(left.column("q").to_pylist(), dim)
        vec = np.array(right.column("vec_id").to_pylist(), np.int64)
        order = np.argsort(vec, kind="stable")         # ties go to the smaller id
        vec, v = vec[order], _matrix(right.column("v").to_pylist(), dim)[order]
        out = ([], [], [])
        for at in range(0, len(ids), PER_BLOCK):       # a repeated pair cannot widen the matrix
            s, beyond = _dot(q[at:at + PER_BLOCK], v)
            own = ids[at:at + PER_BLOCK, None] == vec[None, :]
            low = None if beyond is None else beyond < 0
            if beyond is not None and (over := (beyond > 0) & ~own).any():
                i, j = np.argwhere(over)[0]
                raise OverflowError(f"the score of query {ids[at + i]} and vector {vec[j]} does not fit a long")
            for i, (row, qid, mine) in enumerate(zip(s, ids[at:at + PER_BLOCK].tolist(), own, strict=True)):
                cand = np.flatnonzero(~mine if low is None else ~(mine | low[i]))
                if low is not None and len(cand) < k:  # below every long: after all others
                    under = np.flatnonzero(low[i] & ~mine)[:k - len(cand)]
                    out[0].extend([qid] * len(under))
                    out[1].extend(vec[under].tolist())
                    out[2].extend([None] * len(under))
                if len(cand) > 4 * k:
                    floor = np.partition(row[cand], len(cand) - k)[len(cand) - k]
                    cand = cand[row[cand] >= floor]
                best = cand[np.lexsort((vec[cand], -row[cand]))[:k]]
                out[0].extend([qid] * len(best))
                out[1].extend(vec[best].tolist())
                out[2].extend(row[best].tolist())
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    return (asked.groupBy("cell", "block").cogroup(held.groupBy("cell", "block"))
            .applyInArrow(score, "query_id long, vec_id long, score long"))


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, scale: int = SCALE,
          pivots: int = PIVOTS, per_cell: int = PER_CELL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest integer inner products
    of every query (``vec_id`` divisible by ``query_every``) over all rows but
    its own, ties to the smaller vec_id.

    Shape: the index is one range exchange by (pivot, distance, id); annuli
    have bounded size whatever repeats.  A query is compared with the directory
    of annuli (a row per annulus), then only with the annuli its bound leaves.
    Queries are visited in blocks of bounded size.  The pivots are a sample
    bounded by ``pivots``; every row is indexed and the result is exact.

    Edge cases: rows with a null id, a null vector or a null or non-finite
    component take no part, nor do rows with a scaled component of 2**63 or
    more (it is no long itself); products and sums are exact at any size, and
    a result with a score that does not fit a long raises; vectors that are
    much longer than the others loosen the bound for all, so more annuli are
    visited; shorter vectors count as filled with zeros; rows with the id of
    the query are its own; a query id that occurs twice is asked once; fewer
    than k candidates give fewer rows; empty tables give an empty result;
    extra columns do not take part.
    """
    spark = vectors.sparkSession
    arrow_batches(spark, 4096)
    rows = stage(scaled(vectors, scale))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, dim, top = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").collect()
    centre = _lift(_matrix([r.v for r in sample], dim), top)      # at most ``pivots`` vectors

    def key(batches):
        for batch in batches:
            d = _distances(_lift(_matrix(batch.column(1).to_pylist(), dim), top), centre)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(near, pa.int32()),
                 pa.array(d[np.arange(len(d)), near], pa.float64())], names=["vec_id", "v", "pivot", "r"])

    keyed = rows.mapInArrow(key, "vec_id long, v array<long>, pivot int, r double")
    cells = stage(keyed.repartitionByRange(max(8, -(-n // per_cell)), "pivot", "r", "vec_id")
                  .withColumn("cell", F.spark_partition_id()))
    directory = stage(cells.groupBy("cell", "pivot").agg(F.min("r").alias("lo"), F.max("r").alias("hi")))
    asked = rows.where(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id"]).select(
        F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    n_queries = asked.count()
    blocks = max(1, -(-n_queries // PER_BLOCK))
    queries = stage(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))))

    def reach(batches):
        for batch in batches:
            m = _matrix(batch.column(1).to_pylist(), dim).astype(np.float64)
            lifted = np.hstack([m, np.zeros((len(m), 1))])
            d = _distances(lifted, centre)
            sq = (m ** 2).sum(axis=1) + top
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(batch.column(0).to_pylist(), np.int64), d.shape[1]), pa.int64()),
                 pa.array(np.tile(np.arange(d.shape[1]), len(m)), pa.int32()),
                 pa.array(d.ravel(), pa.float64()), pa.array(np.repeat(sq, d.shape[1]), pa.float64())],
                names=["query_id", "pivot", "d", "sq"])

    far = queries.select("query_id", "q").mapInArrow(reach, "query_id long, pivot int, d double, sq double")
    gap = F.greatest(F.lit(0.0), F.col("d") - F.col("hi"), F.col("lo") - F.col("d"))
    # score <= (|q|^2 + top - gap^2) / 2, with room for rounding on the safe side
    bound = (F.col("sq") * (1 + SLACK) - gap * gap * (1 - SLACK)) / 2 + 1
    options = stage(far.join(directory, "pivot").groupBy("query_id", "cell")
                    .agg(F.max(bound).alias("bound")))
    first = options.groupBy("query_id").agg(
        F.max_by("cell", F.struct("bound", "cell")).alias("cell"))
    near = stage(_best(_visit(first, queries, cells, dim, k), k))
    floor = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = (options.join(floor, "query_id", "left")
            .where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
            .join(first, ["query_id", "cell"], "left_anti").select("query_id", "cell"))
    found = near.select("query_id", "vec_id", "score").unionByName(
        _visit(rest, queries, cells, dim, k))
    fits = F.coalesce("score", F.raise_error(F.lit("a score among the results does not fit a long")).cast("long"))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id",
                                  fits.alias("score"))


def op5_topk(spark, sf_dir) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
