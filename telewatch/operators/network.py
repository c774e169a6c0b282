"""Feed-forward network with ReLU layers and Adam (M7), data-parallel on Spark.

Every job starts all partitions from the same weights and moments; each runs
mini-batch Adam over its own rows for a few epochs, in an order drawn from the
seed, and the results are averaged by rows.  With one partition this is plain
mini-batch Adam.  What is averaged is one number per weight, merged by partial
aggregates; the driver holds the weights and nothing that grows with the data.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, keyword_only
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Settings of the reference's network (its library's defaults beside the layers).
HIDDEN = [64, 32]
MAX_EPOCHS = 500
BATCH = 200
STEP = 1e-3
ALPHA = 1e-4
TOLERANCE = 1e-4
PATIENCE = 10
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8

EPOCHS_PER_JOB = 5
UNIT = float(1 << 32)


# ------------------------------------------------------------------- numpy

def layer_sizes(n_features: int, hidden, classes: int) -> list[tuple[int, int]]:
    sizes = [n_features, *hidden, classes]
    return list(zip(sizes[:-1], sizes[1:], strict=True))


def initial_weights(shapes, seed: int):
    """Uniform weights and biases within sqrt(6 / (fan in + fan out))."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-b, b, (i + 1) * o) for i, o in shapes for b in [np.sqrt(6.0 / (i + o))]])


def unpack(flat, shapes):
    """``[(weights, bias)]`` as views of the flat array."""
    out, at = [], 0
    for i, o in shapes:
        out.append((flat[at:at + i * o].reshape(i, o), flat[at + i * o:at + (i + 1) * o]))
        at += (i + 1) * o
    return out


def forward(flat, shapes, x):
    """Activations of every layer; the last are class probabilities."""
    acts, layers = [x], unpack(flat, shapes)
    for n, (w, b) in enumerate(layers):
        z = acts[-1] @ w + b
        if n < len(layers) - 1:
            z = np.maximum(z, 0.0)
        else:
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
        acts.append(z)
    return acts


def loss_and_gradient(flat, shapes, x, y, alpha: float):
    """Mean log loss plus ``alpha`` / 2 squared weights per row, and its gradient."""
    acts, layers, n = forward(flat, shapes, x), unpack(flat, shapes), len(x)
    p = acts[-1]
    loss = -np.log(np.maximum(p[np.arange(n), y], 1e-300)).mean() + 0.5 * alpha * sum((w ** 2).sum() for w, _ in layers) / n
    grad = np.empty_like(flat)
    parts = unpack(grad, shapes)
    delta = p.copy()
    delta[np.arange(n), y] -= 1.0
    for k in range(len(layers) - 1, -1, -1):
        w, _ = layers[k]
        parts[k][0][:] = (acts[k].T @ delta + alpha * w) / n
        parts[k][1][:] = delta.mean(axis=0)
        if k:
            delta = (delta @ w.T) * (acts[k] > 0)
    return float(loss), grad


def run_epochs(state, steps: int, shapes, x, y, settings, rng):
    """Mini-batch Adam over the rows; ``(state, steps, losses by epoch)``."""
    w, m, v = (a.copy() for a in state)
    size, losses = min(settings["batch"], len(x)), []
    for _ in range(settings["epochs"]):
        order, total = rng.permutation(len(x)), 0.0
        for at in range(0, len(x), size):
            rows = order[at:at + size]
            loss, g = loss_and_gradient(w, shapes, x[rows], y[rows], settings["alpha"])
            total += loss * len(rows)
            steps += 1
            m += (1 - BETA1) * (g - m)
            v += (1 - BETA2) * (g * g - v)
            rate = settings["step"] * np.sqrt(1 - BETA2 ** steps) / (1 - BETA1 ** steps)
            w -= rate * m / (np.sqrt(v) + EPSILON)
        losses.append(total / len(x))
    return (w, m, v), steps, losses


def fixed(values):
    """Whole parts and what is left in units of ``1 / UNIT``, as integers: rows
    times steps in one integer of units pass 64 bits within some 10,000 steps."""
    whole = np.floor(values)
    if not (np.abs(whole) < 2.0 ** 63).all():
        raise ArithmeticError("the network diverged: a weight, moment or loss has no finite value")
    return whole.astype(np.int64), np.rint((values - whole) * UNIT).astype(np.int64)


# ------------------------------------------------------------------- Spark

class _NetworkParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed):
    hidden = Param(Params._dummy(), "hidden", "sizes of the hidden layers", TypeConverters.toListInt)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    maxEpochs = Param(Params._dummy(), "maxEpochs", "most epochs", TypeConverters.toInt)
    batch = Param(Params._dummy(), "batch", "rows per step", TypeConverters.toInt)
    step = Param(Params._dummy(), "step", "step size of Adam", TypeConverters.toFloat)
    alpha = Param(Params._dummy(), "alpha", "weight of squared weights", TypeConverters.toFloat)
    tolerance = Param(Params._dummy(), "tolerance", "least gain in loss that counts", TypeConverters.toFloat)
    patience = Param(Params._dummy(), "patience", "epochs without such a gain before the end", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction",
                         probabilityCol="probability", seed=42, hidden=HIDDEN, classes=3, maxEpochs=MAX_EPOCHS,
                         batch=BATCH, step=STEP, alpha=ALPHA, tolerance=TOLERANCE, patience=PATIENCE)


class ReluNetwork(Estimator, _NetworkParams, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator: hidden ReLU layers, softmax output, Adam, early stop on the training loss."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", hidden=None, classes=3, maxEpochs=MAX_EPOCHS,
                 batch=BATCH, step=STEP, alpha=ALPHA, tolerance=TOLERANCE, patience=PATIENCE, seed=42):
        super().__init__()
        kwargs = self._input_kwargs
        self._set(**{k: v for k, v in kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> ReluNetworkModel:
        """A job per ``EPOCHS_PER_JOB`` epochs; a task holds the rows of its
        partition, so partitions must be of bounded size.  Rows with a null
        label or vector take no part; an empty frame keeps the first weights.
        """
        get = {p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)}
        rows = df.where(F.col(self.getLabelCol()).isNotNull() & F.col(self.getFeaturesCol()).isNotNull()).select(
            F.col(self.getLabelCol()).cast("int").alias("y"), vector_to_array(self.getFeaturesCol()).alias("x")).persist(StorageLevel.DISK_ONLY)
        n_features, total = rows.agg(F.max(F.size("x")), F.count(F.lit(1))).first()
        shapes = layer_sizes(n_features or 0, get["hidden"], get["classes"])
        weights = initial_weights(shapes, get["seed"])
        state, steps = (weights, np.zeros_like(weights), np.zeros_like(weights)), 0
        losses, best, stale = [], np.inf, 0
        while total and len(losses) < get["maxEpochs"] and stale <= get["patience"]:
            epochs = min(EPOCHS_PER_JOB, get["maxEpochs"] - len(losses))
            state, steps, more = _one_job(rows, state, steps, shapes, n_features, {**get, "epochs": epochs}, len(losses))
            for loss in more:
                losses.append(loss)
                stale = stale + 1 if loss > best - get["tolerance"] else 0
                best = min(best, loss)
                if stale > get["patience"]:
                    break
        rows.unpersist()
        return self._copyValues(ReluNetworkModel(weights=state[0].tolist(), shapes=shapes, losses=losses))


def _one_job(rows: DataFrame, state, steps: int, shapes, n_features: int, settings, epoch: int):
    """Epochs of all partitions from one state; their states averaged by rows."""
    size = len(state[0])

    def train(batches):
        ys, xs = [], []
        for batch in batches:
            ys.append(batch.column(0).to_numpy())
            xs.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features))
        y, x = (np.concatenate(a) if a else np.empty(0) for a in (ys, xs))
        if not len(y):
            return
        rng = np.random.default_rng([settings["seed"], epoch, TaskContext.get().partitionId()])
        new, done, losses = run_epochs(state, steps, shapes, x, y, settings, rng)
        whole, part = fixed(np.concatenate([*new, losses, [done, 1.0]]) * len(y))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole)), pa.int32()), pa.array(whole), pa.array(part)],
                                         names=["i", "whole", "part"])

    merged = rows.mapInArrow(train, "i int, whole long, part long").groupBy("i").agg(
        *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("whole", "part")])
    out = np.zeros(3 * size + settings["epochs"] + 2)
    for r in merged.collect():                     # one row per weight and moment
        out[r.i] = float(int(r.whole) * int(UNIT) + int(r.part))
    out /= out[-1]
    new = tuple(out[k * size:(k + 1) * size] for k in range(3))
    return (new[0], new[1], np.maximum(new[2], 0.0)), int(round(out[-2])), out[3 * size:-2].tolist()


class ReluNetworkModel(Model, _NetworkParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted weights; ``transform`` adds class probabilities and the most
    probable class.  The weights are a parameter, saved with the others."""

    fitted = Param(Params._dummy(), "fitted", "weights, shapes and losses as JSON", TypeConverters.toString)

    def __init__(self, weights=None, shapes=None, losses=None):
        super().__init__()
        self._set(fitted=json.dumps({"weights": weights or [], "shapes": shapes or [], "losses": losses or []}))

    @property
    def losses(self) -> list[float]:
        return json.loads(self.getOrDefault("fitted"))["losses"]

    def _transform(self, df: DataFrame) -> DataFrame:
        """A null vector has null results."""
        fitted = self.getOrDefault("fitted")
        cache: dict = {}

        @F.pandas_udf("array<double>")
        def probabilities(features: pd.Series) -> pd.Series:
            if not cache:
                cache.update(json.loads(fitted))
                cache["flat"] = np.array(cache["weights"])
            known = features.notna().to_numpy()
            out = pd.Series([None] * len(features), dtype=object)
            if known.any():
                p = forward(cache["flat"], cache["shapes"], np.stack(features[known].to_list()))[-1]
                out[known] = pd.Series(list(p), index=out.index[known])
            return out

        p = F.col("_p")
        best = F.array_position(p, F.array_max(p)) - 1
        return (df.withColumn("_p", probabilities(vector_to_array(self.getFeaturesCol())))
                .withColumn(self.getProbabilityCol(), F.when(p.isNotNull(), array_to_vector(p)))
                .withColumn(self.getPredictionCol(), best.cast("double")).drop("_p"))
