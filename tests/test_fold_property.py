"""The distributed cooldown fold equals a brute-force sequential fold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from telewatch.operators.alerts import cooldown_fires
from telewatch.operators.ordered import SEG, ordered_scan, segments

T0 = dt.datetime(2024, 1, 1)


def brute_force(rows, gaps, strict):
    """rows: (key, id, t_seconds, cls, candidate); gaps: per class seconds."""
    fired = set()
    last = {}
    for key, rid, t, cls, cand in sorted(rows, key=lambda r: (r[0] or '', r[2], r[1])):
        if not cand:
            continue
        g = gaps[cls]
        prev = last.get(key)
        ok = prev is None or ((t - prev) > g if strict else (t - prev) >= g)
        if ok:
            fired.add((key, rid))
            last[key] = t
    return fired


def make_rows(seed):
    rng = random.Random(seed)
    rows, rid = [], 0
    # one hot key with a long run of close candidates, plus small keys
    for key, n in [("hot", 1500)] + [(f"k{i}", rng.randint(1, 40)) for i in range(20)]:
        t = 0
        for _ in range(n):
            t += rng.choice([0, 1, 2, 3, 5, 8, 13, 40])
            rid += 1
            rows.append((key, rid, t, rng.randint(0, 1), rng.random() < 0.8))
    rows += [(None, 100_000 + i, 3 * i, i % 2, True) for i in range(200)]     # the null key
    return rows


@pytest.mark.parametrize("seed,strict", [(1, True), (2, False), (3, True)])
def test_fold_matches_brute_force(spark, seed, strict):
    rows = make_rows(seed)
    gaps = {0: 7.0, 1: 20.0}
    df = spark.createDataFrame(
        [(k, i, T0 + dt.timedelta(seconds=t), c, cand) for k, i, t, c, cand in rows],
        "system_id string, id long, ts timestamp_ntz, cls int, cand boolean")
    spark.conf.set("telewatch.ordered.rowsPerSegment", "64")   # force many segments
    try:
        got = cooldown_fires(df, "system_id", F.col("cand"),
                             [(F.col("cls") == 0, gaps[0]), (F.lit(True), gaps[1])],
                             strict=strict)
        got_set = {(r["system_id"], r["id"]) for r in got.collect()}
    finally:
        spark.conf.unset("telewatch.ordered.rowsPerSegment")
    assert got_set == brute_force(rows, gaps, strict)


def test_hot_key_is_split_into_bounded_segments(spark):
    rows = [("hot", i, T0 + dt.timedelta(seconds=i)) for i in range(5000)]
    rows += [(f"k{j}", 10_000 + j * 10 + i, T0 + dt.timedelta(seconds=i))
             for j in range(50) for i in range(10)]
    df = spark.createDataFrame(rows, "system_id string, id long, ts timestamp_ntz")
    seg = segments(df, ["system_id"], ["ts", "id"], per_segment=200)
    assert seg.filter("system_id = 'hot'").select(SEG).distinct().count() >= 20
    assert seg.groupBy(SEG).count().agg(F.max("count")).first()[0] <= 2 * 200
    scanned = ordered_scan(df, ["system_id"], ["ts", "id"], per_segment=200, row_number="rn")
    assert scanned.filter("system_id = 'hot'").agg(F.max("rn")).first()[0] == 5000
