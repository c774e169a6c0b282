"""Gradient-boosted trees with a softmax objective (M6), data-parallel on Spark.

One round grows a tree per class, level by level, from second-order gradients
of the multinomial log loss.  Features are binned once by approximate quantiles
(Spark's sketch); a level is one job: the tasks add up gradients and Hessians
per (class, node, feature, bin), and the driver takes the best split of every
node from classes x nodes x features x bins sums at most.  Of two siblings only
the one with fewer rows is added up, the other is what is left of the parent.
Rows stay in a written table of the shared folder, in blocks of arrays, and their
gradients are worked out once per round.  A task passes its blocks on one after
the other, so the memory of an executor does not grow with the rows.

Gradients are rounded to multiples of 2**-32 and added as integers, so a fit
does not depend on how rows are spread over partitions.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml.base import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BATCH_BYTES, conf_set, drop_table
from .ordered import written

# Defaults of the reference's booster.
ETA = 0.3
DEPTH = 6
ROUNDS = 100
L2 = 1.0
MIN_CHILD_WEIGHT = 1.0
BINS = 256
BASE_SCORE = 0.5

UNIT = float(1 << 32)
LOSS_UNIT = float(1 << 20)
WHOLE = 100_000              # rows that one task takes
BLOCK = 32_768               # training rows held as one row of arrays
BLOCKS_PER_TASK = 32
COUNTED = 8                  # one of so many rows is counted, to tell the smaller of two siblings
DRIVER_TASKS = 32            # tasks whose sums the driver adds itself
BATCH = 4 << 20              # bytes of blocks that go to a Python worker at once
# Blocks are few and large: without these the writer holds 100 of them, and the
# reader all that are in one row group.  Random doubles do not get smaller.
TABLE = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false",
         "compression": "none"}
SKETCH_ERROR = 1e-4
LEAST_HESSIAN = 1e-16


# ------------------------------------------------------------------- numpy

def softmax(margin):
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margin, y):
    """First and second derivatives of the log loss by class, as integers of ``UNIT``."""
    p = softmax(margin)
    g = p.copy()
    g[np.arange(len(y)), y] -= 1.0
    h = np.maximum(2.0 * p * (1.0 - p), LEAST_HESSIAN)
    return np.rint(g * UNIT).astype(np.int64), np.rint(h * UNIT).astype(np.int64)


def leaves(tree, bins, wanted=None):
    """``(leaf, its rows)`` of a tree (also one in the making), of the wanted leaves
    if given; ``bins`` is [feature, row]."""
    feature, cut, left = tree["feature"], tree["bin"], tree["left"]
    todo = [(0, np.arange(bins.shape[1]))]
    while todo:
        node, rows = todo.pop()
        f, first = feature[node], left[node]
        if f < 0:
            if wanted is None or node in wanted:
                yield node, rows
            continue
        right = bins[f][rows] > cut[node]
        for child, side in ((first, ~right), (first + 1, right)):
            if wanted is None or feature[child] >= 0 or child in wanted:
                todo.append((child, rows[side]))


def add_block(sums, bins, gh, trees, wanted) -> None:
    """Add the rows of a block to ``sums[class]``, arrays [3, wanted node, feature,
    bin] of gradients, Hessians and every ``COUNTED``-th row; sums of a block are
    exact in doubles."""
    for c, (tree, nodes) in enumerate(zip(trees, wanted, strict=True)):
        if not nodes:
            continue
        slot = {node: i for i, node in enumerate(nodes)}
        found = [(slot[node], rows) for node, rows in leaves(tree, bins, slot)]
        rows = np.concatenate([r for _, r in found])
        base, size = np.repeat([i * BINS for i, _ in found], [len(r) for _, r in found]), len(nodes) * BINS
        g, h, counted = gh[0, c][rows], gh[1, c][rows], np.flatnonzero(rows % COUNTED == 0)
        for f in range(len(bins)):
            key = base + bins[f][rows]
            for part, values in ((0, g), (1, h)):
                sums[c][part, :, f] += np.bincount(key, values, size).astype(np.int64).reshape(-1, BINS)
            sums[c][2, :, f] += np.bincount(key[counted], minlength=size).reshape(-1, BINS)


def no_sums(wanted, n_features: int) -> list:
    return [np.zeros((3, len(nodes), n_features, BINS), np.int64) for nodes in wanted]


def best_split(g, h, l2: float, min_child: float):
    """``(gain, feature, bin)`` of the best split of a node from its sums by
    (feature, bin); gain 0 or less means none.  First of equal gains counts."""
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    all_g, all_h = g[0].sum(), h[0].sum()
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = (left_g ** 2 / (left_h + l2) + right_g ** 2 / (right_h + l2) - all_g ** 2 / (all_h + l2))
    gain = np.where((left_h >= min_child) & (right_h >= min_child), gain, 0.0)
    f, b = divmod(int(gain.argmax()), gain.shape[1])
    return float(gain[f, b]), f, b


def new_tree() -> dict:
    return {"feature": [-1], "bin": [0], "left": [0], "value": [0.0]}


def grow(trees, level, sums, settings) -> tuple[list, list]:
    """Split the open nodes of every class by the sums of a level.

    Returns the splits of every class, ``(slot of the node, its left child)``,
    and per class the child of each split with fewer rows, as counted."""
    splits, wanted = [], []
    for tree, open_nodes, found in zip(trees, level, sums, strict=True):
        made, fewer = [], []
        for slot, node in enumerate(open_nodes):
            g, h = found[0, slot] / UNIT, found[1, slot] / UNIT
            gain, f, b = best_split(g, h, settings["l2"], settings["min_child"])
            tree["value"][node] = -settings["eta"] * g[0].sum() / (h[0].sum() + settings["l2"])
            if gain > 1e-6:
                first = len(tree["feature"])
                tree["feature"][node], tree["bin"][node], tree["left"][node] = f, b, first
                for side_g, side_h in ((g[f, :b + 1].sum(), h[f, :b + 1].sum()), (g[f, b + 1:].sum(), h[f, b + 1:].sum())):
                    tree["feature"].append(-1)
                    tree["bin"].append(0)
                    tree["left"].append(0)
                    tree["value"].append(-settings["eta"] * side_g / (side_h + settings["l2"]))
                rows = found[2, slot, f]
                made.append((slot, first))
                fewer.append(first + int(rows[:b + 1].sum() > rows[b + 1:].sum()))
        splits.append(made)
        wanted.append(fewer)
    return splits, wanted


def both_children(above, splits, wanted, found) -> tuple[list, list]:
    """``(level, sums)`` of all children: those of the child that was added up, and
    of its sibling what is left of the parent's."""
    level, sums = [], []
    for parent, made, fewer, part in zip(above, splits, wanted, found, strict=True):
        out = np.zeros((3, 2 * len(made), *part.shape[2:]), np.int64)
        for i, ((slot, first), node) in enumerate(zip(made, fewer, strict=True)):
            out[:, 2 * i + node - first] = part[:, i]
            out[:, 2 * i + 1 - (node - first)] = parent[:, slot] - part[:, i]
        level.append([n for _, first in made for n in (first, first + 1)])
        sums.append(out)
    return level, sums


def grow_trees(added, k: int, n_features: int, depth: int, settings) -> list:
    """The trees of a round, level by level; ``added(trees, wanted)`` gives the sums
    of the wanted nodes over all rows.  Of two siblings only one is wanted."""
    trees, wanted = [new_tree() for _ in range(k)], [[0] for _ in range(k)]
    level, sums = wanted, added(trees, wanted)
    for d in range(depth):
        splits, wanted = grow(trees, level, sums, settings)
        if d + 1 == depth or not any(wanted):
            break
        level, sums = both_children(sums, splits, wanted, added(trees, wanted))
    return trees


def summed_loss(margin, y) -> int:
    """Summed log loss as an integer of ``LOSS_UNIT``."""
    p = np.maximum(softmax(margin)[np.arange(len(y)), y], 1e-300)
    return -int(np.rint(np.log(p) * LOSS_UNIT).sum())


def both_derivatives(margin, y):
    """``gradients`` as doubles (whole numbers), [2, class, row]."""
    return np.stack([a.T.astype(np.float64) for a in gradients(margin, y)])


def fit_rows(y, bins, margin, rounds: int, depth: int, settings):
    """``(trees, losses)`` of rows that are all at hand: the same steps as the jobs."""
    trees, losses, k = [], [], margin.shape[1]
    for _ in range(rounds):
        losses.append(summed_loss(margin, y) / LOSS_UNIT / max(len(y), 1))
        gh = both_derivatives(margin, y)

        def added(new, wanted, gh=gh):
            sums = no_sums(wanted, len(bins))
            for at in range(0, len(y), BLOCK):
                add_block(sums, bins[:, at:at + BLOCK], gh[:, :, at:at + BLOCK], new, wanted)
            return sums
        trees.append(grow_trees(added, k, len(bins), depth, settings))
        add_trees(margin, bins, trees[-1])
    return trees, losses


def add_trees(margin, bins, trees):
    for c, tree in enumerate(trees):
        for leaf, rows in leaves(tree, bins):
            margin[rows, c] += tree["value"][leaf]
    return margin


def binned(features, cuts):
    """Bin of every value, [feature, row]: the number of cut points below it; NaN counts as largest."""
    out = np.empty(features.shape[::-1], np.uint8)
    for f, points in enumerate(cuts):
        out[f] = np.searchsorted(np.asarray(points), features[:, f], side="left")
    return out


# ------------------------------------------------------------------- Spark

def _vectors(column, n: int):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _quantile_cuts(rows: DataFrame, n: int, bins: int) -> list[list[float]]:
    """Up to ``bins`` - 1 cut points per feature from a quantile sketch; a value
    on a cut point lies left of the split there."""
    asked = [i / bins for i in range(1, bins)]
    wide = rows.select(*[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(n)])
    found = wide.approxQuantile([f"f{i}" for i in range(n)], asked, SKETCH_ERROR)
    return [sorted({float(x) for x in points if x == x}) for points in found]


class _BoostingParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    rounds = Param(Params._dummy(), "rounds", "boosting rounds", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "levels of a tree", TypeConverters.toInt)
    eta = Param(Params._dummy(), "eta", "step", TypeConverters.toFloat)
    l2 = Param(Params._dummy(), "l2", "weight of squared leaf values", TypeConverters.toFloat)
    minChild = Param(Params._dummy(), "minChild", "least sum of Hessians of a child", TypeConverters.toFloat)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction",
                         probabilityCol="probability", rounds=ROUNDS, depth=DEPTH, eta=ETA, l2=L2,
                         minChild=MIN_CHILD_WEIGHT, classes=3)


class SoftmaxBoosting(Estimator, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator: ``rounds`` rounds of one tree per class with softmax gradients."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", rounds=ROUNDS, depth=DEPTH, eta=ETA, l2=L2,
                 minChild=MIN_CHILD_WEIGHT, classes=3):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> SoftmaxBoostingModel:
        """One job per level and one written table of margins per round, which takes
        the place of the one before.  Up to ``WHOLE`` rows, no more than one task
        takes anyway, are one job that does all rounds by the same steps; the
        trees are the same.

        ``losses`` of the model is the mean log loss before each round.  Rows
        with a null label or vector take no part; an empty frame gives a model
        without trees.
        """
        k, names = self.getOrDefault("classes"), ("rounds", "depth", "eta", "l2", "minChild")
        rounds, depth, eta, l2, min_child = (self.getOrDefault(n) for n in names)
        settings = {"eta": eta, "l2": l2, "min_child": min_child}
        rows = df.where(F.col(self.getLabelCol()).isNotNull() & F.col(self.getFeaturesCol()).isNotNull()).select(
            F.col(self.getLabelCol()).cast("int").alias("y"), vector_to_array(self.getFeaturesCol()).alias("features"))
        n_features, n = rows.agg(F.max(F.size("features")), F.count(F.lit(1))).first()
        if not n_features:
            return self._copyValues(SoftmaxBoostingModel(cuts=[], trees=[], losses=[]))
        tasks = max(spark_tasks(df), -(-n // (BLOCK * BLOCKS_PER_TASK)))
        cuts = _quantile_cuts(rows.coalesce(tasks), n_features, BINS)      # a sketch per task is merged

        def start(batches):
            held, n_held = [], 0

            def block():
                y, bins = (np.concatenate(a, axis=-1) for a in zip(*held, strict=True))
                return _block(y, bins, np.full((len(y), k), BASE_SCORE))
            for batch in batches:
                y, bins = batch.column(0).to_numpy(), binned(_vectors(batch.column(1), n_features), cuts)
                for at in range(0, len(y), BLOCK):
                    part = y[at:at + BLOCK]
                    if n_held + len(part) > BLOCK:
                        yield block()
                        held, n_held = [], 0
                    held.append((part, bins[:, at:at + BLOCK]))
                    n_held += len(part)
            if n_held:
                yield block()

        if n <= WHOLE:
            trees, losses = _in_one_task(rows.coalesce(1).mapInArrow(start, STATE), n_features, k, rounds, depth, settings)
            return self._copyValues(SoftmaxBoostingModel(cuts=cuts, trees=trees, losses=losses))
        trees, losses, spark = [], [], df.sparkSession
        state, path = written(rows.mapInArrow(start, STATE), **TABLE)
        with conf_set(spark, BATCH_BYTES, str(BATCH)):
            for done in range(rounds):
                loss = []

                def added(new, wanted, at=state.coalesce(tasks), loss=loss):
                    sums, total = _level(at, tasks, new, wanted, n_features, k)
                    loss.append(total)
                    return sums
                trees.append(grow_trees(added, k, n_features, depth, settings))
                losses.append(loss[0] / LOSS_UNIT / n)
                before = path
                if done + 1 < rounds:
                    state, path = written(_moved(state.coalesce(tasks), trees[-1], n_features, k), **TABLE)
                drop_table(spark, before)
        return self._copyValues(SoftmaxBoostingModel(cuts=cuts, trees=trees, losses=losses))


def spark_tasks(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def _in_one_task(state: DataFrame, n_features: int, k: int, rounds: int, depth: int, settings):
    def fit(batches):
        parts = [_parsed(row, n_features, k) for b in batches for row in b.to_pylist()]
        y, bins, margin = (np.concatenate(a, axis=x) for a, x in zip(zip(*parts, strict=True), (0, 1, 0), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(fit_rows(y, bins, margin, rounds, depth, settings))])],
                                         names=["fitted"])

    return tuple(json.loads(state.mapInArrow(fit, "fitted string").first()[0]))


# a row is a block of up to ``BLOCK`` training rows: arrays of their classes, bins,
# margins and derivatives, and their summed loss
STATE = "y binary, bins binary, margin binary, gh binary, loss long"


def _block(y, bins, margin) -> pa.RecordBatch:
    y = y.astype(np.int32)
    arrays = [np.ascontiguousarray(a).tobytes() for a in (y, bins, margin, both_derivatives(margin, y))]
    return pa.RecordBatch.from_arrays([*(pa.array([a], pa.binary()) for a in arrays), pa.array([summed_loss(margin, y)], pa.int64())],
                                      names=["y", "bins", "margin", "gh", "loss"])


def _parsed(row: dict, n_features: int, k: int):
    return (np.frombuffer(row["y"], np.int32), np.frombuffer(row["bins"], np.uint8).reshape(n_features, -1),
            np.frombuffer(row["margin"], np.float64).reshape(-1, k).copy())


def _moved(state: DataFrame, trees, n_features: int, k: int) -> DataFrame:
    def move(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                y, bins, margin = _parsed(batch.slice(i, 1).to_pylist()[0], n_features, k)
                yield _block(y, bins, add_trees(margin, bins, trees))
    return state.select("y", "bins", "margin").mapInArrow(move, STATE)


def _level(state: DataFrame, tasks: int, trees, wanted, n_features: int, k: int) -> tuple[list, int]:
    """Sums of the wanted nodes (see ``add_block``), and the summed loss.

    Every task adds up its blocks; up to ``DRIVER_TASKS`` such sums go to the
    driver, more are merged by a shuffle.
    """
    def add(batches):
        sums, loss = no_sums(wanted, n_features), 0
        for batch in batches:
            for i in range(batch.num_rows):
                loss += batch.column(2)[i].as_py()
                bins, gh = (batch.column(c)[i].as_buffer() for c in (0, 1))
                add_block(sums, np.frombuffer(bins, np.uint8).reshape(n_features, -1),
                          np.frombuffer(gh, np.float64).reshape(2, k, -1), trees, wanted)
        flat = np.concatenate([s.reshape(3, -1) for s in sums], axis=1)
        key = np.flatnonzero(flat.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, key], pa.int64()), *(pa.array(np.r_[first, flat[i, key]], pa.int64())
                                                                                  for i, first in enumerate((loss, 0, 0)))],
                                         names=["key", "g", "h", "n"])

    parts = state.select("bins", "gh", "loss").mapInArrow(add, "key long, g long, h long, n long")
    if tasks > DRIVER_TASKS:
        parts = parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
    found = parts.toArrow()                        # classes x wanted nodes x features x BINS rows per task at most
    sizes = [len(nodes) * n_features * BINS for nodes in wanted]
    flat = np.zeros((3, sum(sizes)), np.int64)
    key, *parts = (found.column(i).to_numpy() for i in range(4))
    inner = key >= 0
    for i in range(3):
        np.add.at(flat[i], key[inner], parts[i][inner])
    cut = np.cumsum([0, *sizes])
    return [flat[:, a:b].reshape(3, len(nodes), n_features, BINS)
            for a, b, nodes in zip(cut[:-1], cut[1:], wanted, strict=True)], int(parts[0][~inner].sum())


class SoftmaxBoostingModel(Model, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees; ``transform`` adds class probabilities (a vector) and the
    most probable class.  The trees are a parameter, so the usual writers of
    Spark ML save and load them."""

    fitted = Param(Params._dummy(), "fitted", "cut points, trees and losses as JSON", TypeConverters.toString)

    def __init__(self, cuts=None, trees=None, losses=None):
        super().__init__()
        self._set(fitted=json.dumps({"cuts": cuts or [], "trees": trees or [], "losses": losses or []}))

    @property
    def losses(self) -> list[float]:
        return json.loads(self.getOrDefault("fitted"))["losses"]

    @property
    def trees(self) -> list:
        return json.loads(self.getOrDefault("fitted"))["trees"]

    def _transform(self, df: DataFrame) -> DataFrame:
        """A null vector has null results; a row never sees another one."""
        k, fitted = self.getOrDefault("classes"), self.getOrDefault("fitted")
        cache: dict = {}

        @F.pandas_udf("array<double>")
        def probabilities(features: pd.Series) -> pd.Series:
            if not cache:
                cache.update(json.loads(fitted))
            known = features.notna().to_numpy()
            out = pd.Series([None] * len(features), dtype=object)
            if known.any():
                x = np.stack(features[known].to_list())
                margin = np.full((len(x), k), BASE_SCORE)
                if cache["trees"]:
                    bins = binned(x, cache["cuts"])
                    for trees in cache["trees"]:
                        add_trees(margin, bins, trees)
                out[known] = pd.Series(list(softmax(margin)), index=out.index[known])
            return out

        p = F.col("_p")
        best = F.array_position(p, F.array_max(p)) - 1
        return (df.withColumn("_p", probabilities(vector_to_array(self.getFeaturesCol())))
                .withColumn(self.getProbabilityCol(), F.when(p.isNotNull(), array_to_vector(p)))
                .withColumn(self.getPredictionCol(), best.cast("double")).drop("_p"))
