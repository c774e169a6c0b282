"""Softmax boosting and the ReLU network against plain versions."""

import glob
import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.ml.functions import array_to_vector

from telewatch.operators import boosting as B
from telewatch.operators import network as N
from telewatch.session import scratch_table_dir


def _data(seed, n=600, features=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, features)), 2)
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(int) + ((x[:, 2] > 0.4) & (x[:, 0] < 0.3))
    return x, y


def _frame(spark, x, y, parts=3):
    rows = [(int(b), [float(v) for v in a]) for a, b in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "label int, f array<double>").repartition(parts).select(
        "label", array_to_vector("f").alias("features"))


def _plain_tree(x, g, h, eta, depth, cuts):
    """Exact greedy tree over the cut points, grown by recursion; values by row."""
    out = np.zeros(len(x))

    def split(rows, level):
        G, H = g[rows].sum(), h[rows].sum()
        out[rows] = -eta * G / (H + 1.0)
        best = (1e-6, None)
        if level < depth:
            for f, points in enumerate(cuts):
                for p in points:
                    left = x[rows, f] <= p
                    hl, hr = h[rows[left]].sum(), h[rows[~left]].sum()
                    if hl >= 1.0 and hr >= 1.0:
                        gl, gr = g[rows[left]].sum(), g[rows[~left]].sum()
                        gain = gl * gl / (hl + 1) + gr * gr / (hr + 1) - G * G / (H + 1)
                        if gain > best[0] + 1e-9:
                            best = (gain, left)
        if best[1] is not None:
            split(rows[best[1]], level + 1)
            split(rows[~best[1]], level + 1)
    split(np.arange(len(x)), 0)
    return out


def _plain_margins(x, y, cuts, rounds, depth, eta=0.3, classes=3):
    margin, losses = np.full((len(x), classes), 0.5), []
    for _ in range(rounds):
        p = B.softmax(margin)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean())
        step = np.zeros_like(margin)
        for c in range(classes):
            g, h = p[:, c] - (y == c), 2 * p[:, c] * (1 - p[:, c])
            step[:, c] = _plain_tree(x, g, h, eta, depth, cuts)
        margin += step
    return margin, losses


@pytest.mark.parametrize("whole", [0, 1000])
def test_boosting_equals_a_plain_version(spark, monkeypatch, whole):
    """By a job per level as well as in one task."""
    monkeypatch.setattr(B, "WHOLE", whole)
    x, y = _data(1)
    df = _frame(spark, x, y)
    model = B.SoftmaxBoosting(featuresCol="features", labelCol="label", rounds=4, depth=3).fit(df)
    cuts = json.loads(model.getOrDefault("fitted"))["cuts"]
    margin, losses = _plain_margins(x, y, cuts, 4, 3)
    assert model.losses == pytest.approx(losses, abs=1e-5)
    got = {tuple(r.f): list(r.p) for r in model.transform(df).select(
        B.vector_to_array("features").alias("f"), B.vector_to_array("probability").alias("p")).collect()}
    want = B.softmax(margin)
    for row, p in zip(x, want, strict=True):
        assert got[tuple(row)] == pytest.approx(p.tolist(), abs=1e-6)


def test_boosting_loss_falls_and_probabilities_sum_to_one(spark):
    x, y = _data(2)
    df = _frame(spark, x, y)
    model = B.SoftmaxBoosting(featuresCol="features", labelCol="label", rounds=12, depth=4).fit(df)
    assert len(model.losses) == 12 and all(b < a for a, b in zip(model.losses, model.losses[1:], strict=False))
    rows = model.transform(df).select("label", "prediction", B.vector_to_array("probability").alias("p")).collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 and r.p[int(r.prediction)] == max(r.p) for r in rows)
    assert sum(r.label == r.prediction for r in rows) / len(rows) > 0.95


def test_boosting_does_not_depend_on_partitions(spark, monkeypatch):
    """One partition, five, five merged by a shuffle, and one task: the same trees."""
    x, y = _data(3, 200)
    fitted = []
    for parts, whole, tasks in ((1, 0, 32), (5, 0, 32), (5, 0, 0), (5, 1000, 32)):
        monkeypatch.setattr(B, "WHOLE", whole)
        monkeypatch.setattr(B, "DRIVER_TASKS", tasks)
        fitted.append(B.SoftmaxBoosting(featuresCol="features", labelCol="label", rounds=3, depth=3)
                      .fit(_frame(spark, x, y, parts)))
    assert all(f.trees == fitted[0].trees and f.losses == fitted[0].losses for f in fitted)


def test_of_two_siblings_one_is_added_up():
    """Sums of both children from one of them equal those of all rows; the smaller one is taken."""
    rng = np.random.default_rng(8)
    bins, y, margin = rng.integers(0, 256, (5, 3000)).astype(np.uint8), rng.integers(0, 3, 3000), rng.normal(size=(3000, 3))
    gh, asked = B.both_derivatives(margin, y), []

    def full(trees, nodes):
        sums = B.no_sums(nodes, 5)
        B.add_block(sums, bins, gh, trees, nodes)
        return sums
    trees = [B.new_tree() for _ in range(3)]
    level, sums = [[0]] * 3, full(trees, [[0]] * 3)
    for _ in range(4):
        splits, wanted = B.grow(trees, level, sums, {"l2": 1.0, "min_child": 1.0, "eta": 0.3})
        level, sums = B.both_children(sums, splits, wanted, full(trees, wanted))
        assert all((a == b).all() for a, b in zip(sums, full(trees, level), strict=True))
        rows = [dict(B.leaves(t, bins)) for t in trees]
        asked.append(sum(len(r[n]) for r, w in zip(rows, wanted, strict=True) for n in w))
        assert [2 * len(w) for w in wanted] == [len(nodes) for nodes in level]
    assert max(asked) <= 0.6 * 3 * 3000


def test_boosting_without_rows_or_vectors(spark):
    empty = spark.createDataFrame([], "label int, f array<double>").select(
        "label", array_to_vector("f").alias("features"))
    model = B.SoftmaxBoosting(featuresCol="features", labelCol="label", rounds=2).fit(empty)
    x, y = _data(4, 3)
    rows = model.transform(_frame(spark, x, y)).select(B.vector_to_array("probability").alias("p")).collect()
    assert [r.p for r in rows] == [pytest.approx([1 / 3] * 3)] * 3


def test_network_gradient_equals_finite_differences():
    rng = np.random.default_rng(0)
    shapes = N.layer_sizes(4, [6, 5], 3)
    w = N.initial_weights(shapes, 1)
    x, y = rng.normal(size=(20, 4)), rng.integers(0, 3, 20)
    _, grad = N.loss_and_gradient(w, shapes, x, y, 0.01)
    for i in rng.choice(len(w), 60, replace=False):
        d = np.zeros_like(w)
        d[i] = 1e-6
        up, down = (N.loss_and_gradient(w + s * d, shapes, x, y, 0.01)[0] for s in (1, -1))
        assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_network_with_one_partition_is_plain_adam(spark):
    x, y = _data(5, 300)
    df = _frame(spark, x, y, 1)
    model = N.ReluNetwork(featuresCol="features", labelCol="label", hidden=[8], maxEpochs=6, batch=50).fit(df)
    got = np.array(json.loads(model.getOrDefault("fitted"))["weights"])
    held = df.select("label", N.vector_to_array("features").alias("x")).collect()       # the order of the partition
    xs, ys = np.array([r.x for r in held]), np.array([r.label for r in held])
    shapes = N.layer_sizes(4, [8], 3)
    w = N.initial_weights(shapes, 42)
    state, steps, losses = (w, np.zeros_like(w), np.zeros_like(w)), 0, []
    for epoch, epochs in ((0, 5), (5, 1)):
        settings = {"batch": 50, "step": 1e-3, "alpha": 1e-4, "epochs": epochs}
        state, steps, more = N.run_epochs(state, steps, shapes, xs, ys, settings, np.random.default_rng([42, epoch, 0]))
        losses += more
    assert got == pytest.approx(state[0], abs=1e-7)
    assert model.losses == pytest.approx(losses, abs=1e-7)


def test_network_states_add_up_after_many_steps(spark):
    """Rows times steps pass 64 bits when they are counted in units of 2**-32."""
    x, y = _data(7, 2000)
    rows = _frame(spark, x, y, 2).select(N.F.col("label").alias("y"), N.vector_to_array("features").alias("x"))
    shapes, steps = N.layer_sizes(4, [3], 3), 3_000_000
    w = N.initial_weights(shapes, 1)
    settings = {"batch": 200, "step": 1e-3, "alpha": 1e-4, "epochs": 1, "seed": 42}
    state, done, losses = N._one_job(rows, (w, np.zeros_like(w), np.zeros_like(w)), steps, shapes, 4, settings, 0)
    assert steps < done <= steps + 10 and np.isfinite(state[0]).all() and np.isfinite(losses).all()


def test_a_diverged_network_is_an_error():
    whole, part = N.fixed(np.array([-1.25, 3e9, 2.0 ** 40 + 0.5]))
    assert (whole + part / N.UNIT).tolist() == [-1.25, 3e9, 2.0 ** 40 + 0.5]
    for bad in (np.nan, np.inf, 1e30):
        with pytest.raises(ArithmeticError):
            N.fixed(np.array([0.0, bad]))


def test_network_learns_stops_and_round_trips(spark, tmp_path):
    x, y = _data(6, 900)
    df = _frame(spark, x, y, 2)
    model = N.ReluNetwork(featuresCol="features", labelCol="label", hidden=[32, 16], step=0.01).fit(df)
    assert model.losses[-1] < 0.5 * model.losses[0] and len(model.losses) < N.MAX_EPOCHS
    rows = model.transform(df).select("label", "prediction", N.vector_to_array("probability").alias("p")).collect()
    assert sum(r.label == r.prediction for r in rows) / len(rows) > 0.93
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in rows)
    model.write().overwrite().save(str(tmp_path / "net"))
    again = N.ReluNetworkModel.load(str(tmp_path / "net"))
    assert again.transform(df).exceptAll(model.transform(df)).count() == 0


def test_blocks_go_one_after_the_other(spark):
    """Neither the table of blocks nor a batch for a Python worker holds all blocks of a task."""
    def blocks(batches):
        for _ in batches:
            for i in range(24):
                rng = np.random.default_rng(i)
                yield B._block(rng.integers(0, 3, B.BLOCK), rng.integers(0, 256, (10, B.BLOCK)).astype(np.uint8),
                               rng.normal(size=(B.BLOCK, 3)))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])
    state, path = B.written(spark.range(1).coalesce(1).mapInArrow(blocks, B.STATE), **B.TABLE)
    file, = glob.glob(path.removeprefix("file:") + "/*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) <= 8 << 20
    before = spark.conf.get(B.BATCH_BYTES)
    with B.conf_set(spark, B.BATCH_BYTES, str(B.BATCH)):
        got = state.coalesce(1).mapInArrow(sizes, "n long, bytes long").collect()
    assert spark.conf.get(B.BATCH_BYTES) == before
    assert sum(r.n for r in got) == 24 and max(r.bytes for r in got) <= 2 * B.BATCH
    B.drop_table(spark, path)


def test_boosting_leaves_no_table_behind(spark, monkeypatch):
    """Tables of margins go when the next one is written, and the last with the fit."""
    monkeypatch.setattr(B, "WHOLE", 0)
    x, y = _data(9, 300)
    root = scratch_table_dir(spark, "").removeprefix("file:")
    before = set(glob.glob(f"{root}/*"))
    model = B.SoftmaxBoosting(featuresCol="features", labelCol="label", rounds=12, depth=2).fit(_frame(spark, x, y))
    assert len(model.losses) == 12 and set(glob.glob(f"{root}/*")) == before


def test_sketches_to_merge_do_not_grow_with_the_partitions(spark, monkeypatch):
    x, y = _data(10, 400)
    parts, cuts = [], B._quantile_cuts

    def counted(rows, *rest):
        parts.append(rows.rdd.getNumPartitions())
        return cuts(rows, *rest)
    monkeypatch.setattr(B, "_quantile_cuts", counted)
    B.SoftmaxBoosting(featuresCol="features", labelCol="label", rounds=1, depth=1).fit(_frame(spark, x, y, 40))
    assert parts == [B.spark_tasks(spark.range(1))]
