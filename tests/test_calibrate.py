"""Calibration goldens and the inverse check."""

import numpy as np

from telewatch.operators import calibrate as B

ROWS = [(10.0, 50.0, 8000.0, 1.0), (20.0, 52.0, 7900.0, 0.5), (30.0, 49.0, 8100.0, 2.0),
        (40.0, 55.0, 7800.0, 0.25)]
SCHEMA = ("system_id string, cpu_percent double, memory_percent double, "
          "memory_available_mb double, disk_write_mbps double")


def test_stats_golden(spark):
    df = spark.createDataFrame([("s", *r) for r in ROWS], SCHEMA)
    r = B.calibrate(df, min_samples=4).collect()[0]
    assert r["status"] == "calibrated"
    assert abs(r["cpu_mean"] - 25) < 1e-9 and abs(r["mem_mean"] - 51.5) < 1e-9
    assert abs(r["cpu_std"] - 12.909944) < 1e-6 and abs(r["avail_std"] - 129.099445) < 1e-6
    assert abs(r["cov_cpu_mem"] - 20) < 1e-9
    assert abs(r["cov_cpu_avail"] + 666.6667) < 1e-4
    assert abs(r["cov_mem_disk"] + 1.7917) < 1e-4
    assert abs(r["cov_avail_disk"] - 95.8333) < 1e-4


def test_guard_and_null_pairs(spark):
    df = spark.createDataFrame([("s", *r) for r in ROWS], SCHEMA)
    r = B.calibrate(df).collect()[0]
    assert r["status"].endswith("Currently have 4.") and r["cpu_mean"] is None
    pairs = [(1.0, 2.0), (2.0, None), (3.0, 5.0), (None, 7.0)]
    d2 = spark.createDataFrame([("s", a, b, 1.0, 1.0) for a, b in pairs], SCHEMA)
    assert abs(B.baseline_stats(d2).collect()[0]["cov_cpu_mem"] - 3.0) < 1e-12


def test_inverse_times_covariance_is_identity(spark):
    rng = np.random.default_rng(42)
    data = rng.normal(size=(200, 4)) * [10, 5, 100, 1] + [50, 50, 8000, 2]
    df = spark.createDataFrame([("s", *map(float, r)) for r in data], SCHEMA)
    m = B.matrices(B.calibrate(df)).collect()[0]
    cov, inv = np.array(m["covariance"]), np.array(m["inverse_covariance"])
    assert np.allclose(cov, cov.T)
    assert np.allclose(cov @ inv, np.eye(4), atol=1e-8)
    assert np.allclose(cov, np.cov(data.T), rtol=1e-9)
