"""Properties of ids, balancing and the stratified split."""

import pytest
from pyspark.sql import functions as F

from telewatch.operators import prep as P
from telewatch.sources import readings as RD

from .conftest import SF001


def training(spark):
    return RD.with_process_ids(RD.training_rows(spark, SF001))


def test_ids_are_1_to_n(spark):
    t = training(spark)
    ids = sorted(r[0] for r in t.select("process_id").collect())
    assert ids == list(range(1, len(ids) + 1))


def test_balance_exact_per_label(spark):
    t = training(spark)
    counts = {r["label"]: r["count"] for r in t.groupBy("label").count().collect()}
    n = sorted(counts.values())[1]  # middle class: one label each way
    b = P.balance(t, n)
    got = {r["label"]: r["count"] for r in b.groupBy("label").count().collect()}
    assert got == {k: n for k in counts}
    for label, cnt in counts.items():
        ids = b.filter(F.col("label") == label).select("process_id")
        distinct = ids.distinct().count()
        if cnt >= n:
            assert distinct == n          # no repeats
        else:
            assert distinct <= cnt        # drawn with replacement from the label's rows
    # deterministic: same rows on a second run
    assert b.exceptAll(P.balance(t, n)).count() == 0


def test_split_disjoint_and_covering(spark):
    t = training(spark)
    s = P.stratified_split(t)
    assert s.count() == t.count()
    assert s.select("process_id").distinct().count() == t.count()
    per = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    for label in {k[0] for k in per}:
        total = per.get((label, "train"), 0) + per.get((label, "test"), 0)
        assert per.get((label, "train"), 0) == int(total * 0.8)


def test_label_encoding_alphabetical(spark):
    t = P.label_index(RD.training_rows(spark, SF001))
    got = {r["label"]: r["label_idx"] for r in t.select("label", "label_idx").distinct().collect()}
    assert got == {"High": 0.0, "Moderate": 1.0, "Normal": 2.0}


def _labelled(spark, n=4000):
    rows = [(i // 2 * 2, ["a", "b", None, "c"][i % 7 % 4] if i % 50 else "rare", i) for i in range(n)]   # ids occur twice
    return spark.createDataFrame(rows, "process_id long, label string, x int").repartition(5)


def _ranked(spark, df):
    """Plain version: rows by label in the order of (hash, id)."""
    rows = df.withColumn("h", P.hash_rank_key(F.col("process_id"), F.lit(P.SEED))).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.h, r.process_id)):
        out.setdefault(r.label, []).append(r.process_id)
    return out


@pytest.mark.parametrize("bits", [1, 4, 16])
@pytest.mark.parametrize("wanted", [0, 1, 60, 500, 10 ** 6])
def test_selection_equals_a_plain_sort(spark, monkeypatch, bits, wanted):
    """Also with a null label, repeated ids, and more or fewer rows than wanted."""
    monkeypatch.setattr(P, "SELECT_BITS", bits)
    df = _labelled(spark)
    got = {}
    for r in P.pick_smallest(df, F.lit(wanted)).where("_picked").collect():
        got.setdefault(r.label, []).append(r.process_id)
    want = {k: v[:wanted] for k, v in _ranked(spark, df).items() if wanted}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("segment", [None, 100])
def test_balance_with_a_null_label(spark, segment):
    df = _labelled(spark)
    if segment:
        spark.conf.set("telewatch.ordered.rowsPerSegment", segment)
    try:
        rows = P.balance(df, 700).collect()
    finally:
        spark.conf.unset("telewatch.ordered.rowsPerSegment")
    per = {}
    for r in rows:
        per.setdefault(r.label, []).append(r.x)
    assert {k: len(v) for k, v in per.items()} == {k: 700 for k in ("a", "b", "c", None, "rare")}
    counts = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    assert all(len(set(v)) == 700 for k, v in per.items() if counts[k] >= 700)


def test_split_with_a_null_label(spark):
    df = _labelled(spark)
    got = {(r["label"], r["split"]): r["count"] for r in P.stratified_split(df).groupBy("label", "split").count().collect()}
    for r in df.groupBy("label").count().collect():
        assert got[r["label"], "train"] == int(r["count"] * 0.8)
        assert got[r["label"], "train"] + got[r["label"], "test"] == r["count"]
