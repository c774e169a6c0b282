"""Cooldown, streak, burst and banner goldens (FIXTURES.md §3)."""

import datetime as dt

from telewatch.operators import alerts as A

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def frame(spark, rows):
    data = [("S", i + 1, T0 + dt.timedelta(seconds=s), r) for i, (s, r) in enumerate(rows)]
    return spark.createDataFrame(data, "system_id string, id long, ts timestamp_ntz, risk_score double")


def fired_seconds(df):
    return sorted(int((r["ts"] - T0).total_seconds()) for r in df.collect())


def test_cooldown_golden(spark):
    # t = 0*, 100, 300, 301*, 601, 602*; rows at 0.3 / 0.8 never fire nor reset
    rows = [(0, 0.5), (50, 0.3), (100, 0.5), (150, 0.8), (300, 0.5), (301, 0.5),
            (601, 0.5), (602, 0.5)]
    out = A.moderate_cooldown(frame(spark, rows), 300)
    assert fired_seconds(out) == [0, 301, 602]


def test_min_gap_thinning_is_inclusive(spark):
    rows = [(0, 0.1), (5, 0.1), (10, 0.1), (19, 0.1), (20, 0.1)]
    df = frame(spark, rows).withColumnRenamed("system_id", "session_id")
    assert fired_seconds(A.thin_min_gap(df, 10)) == [0, 10, 20]


def test_two_band_shared_clock(spark):
    # high needs > 30 s, moderate > 300 s since the last toast of either kind
    # (420 s is high but only 20 s after the moderate toast at 400 s: no toast)
    rows = [(0, 0.8), (20, 0.8), (31, 0.8), (100, 0.5), (400, 0.5), (420, 0.9), (431, 0.9)]
    out = A.two_band_cooldown(frame(spark, rows), 30, 300)
    assert fired_seconds(out) == [0, 31, 400, 431]


def test_sustained_high(spark):
    pattern = "HHHHLHHHHHH"
    rows = [(i, 0.8 if c == "H" else 0.2) for i, c in enumerate(pattern)]
    out = A.sustained_high(frame(spark, rows), 3)
    assert sorted(r["id"] for r in out.collect()) == [3, 8, 11]


def test_burst(spark):
    fires = spark.createDataFrame([("S", 1, dt.datetime(2024, 1, 1, 0, 0, 10))],
                                  "system_id string, id long, ts timestamp_ntz")
    got = [r["notice_ts"].strftime("%H:%M:%S") for r in A.burst(fires).orderBy("notice").collect()]
    assert got == ["00:00:10", "00:00:12", "00:00:14"]


def test_banner_changes(spark):
    rows = [(0, 0.2), (1, 0.8), (2, 0.9), (3, 0.1)]
    out = A.banner_changes(frame(spark, rows)).filter("changed").orderBy("id")
    assert [(r["id"], r["banner"]) for r in out.collect()] == [(1, False), (2, True), (4, False)]


def test_resolution_time(spark):
    rows = [(0, 0.5), (10, 0.9), (20, 0.1), (30, 0.5)]
    out = A.with_resolution(frame(spark, rows)).orderBy("id").collect()
    res = [None if r["resolved_at"] is None else int((r["resolved_at"] - T0).total_seconds())
           for r in out]
    assert res == [20, 20, 20, None]


def test_cooldown_edge_cases(spark):
    # no candidates at all
    none = frame(spark, [(0, 0.1), (10, 0.2)])
    assert A.moderate_cooldown(none, 300).count() == 0
    # a single candidate fires
    one = frame(spark, [(0, 0.1), (10, 0.5)])
    assert fired_seconds(A.moderate_cooldown(one, 300)) == [10]
    # a key whose only row is not a candidate, next to a key with fires
    mixed = spark.createDataFrame(
        [("A", 1, T0, 0.1), ("B", 2, T0, 0.5), ("B", 3, T0 + dt.timedelta(seconds=400), 0.5)],
        "system_id string, id long, ts timestamp_ntz, risk_score double")
    assert sorted(r["id"] for r in A.moderate_cooldown(mixed, 300).collect()) == [2, 3]
