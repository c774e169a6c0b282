"""Golden rows for the row classification rules (FIXTURES.md §3)."""

from telewatch.functions import risk as R
from telewatch.operators.classify import contribution

GOLDEN = [
    # cpu, mem, risk, vote, stored, band, health, anomaly, fault, severity
    (0, 0, 0.0, 0, "NORMAL", "NORMAL", 100, "Normal", "Normal", "LOW"),
    (10, 30, 0.22, 0, "NORMAL", "NORMAL", 100, "Normal", "Normal", "LOW"),
    (40, 40, 0.4, 0, "NORMAL", "MODERATE", 100, "Normal", "Normal", "LOW"),
    (60, 60, 0.6, 0, "NORMAL", "MODERATE", 100, "Normal", "Normal", "LOW"),
    (61, 60, 0.604, 1, "HIGH", "MODERATE", 100, "Normal", "Normal", "LOW"),
    (20, 90, 0.62, 1, "HIGH", "MODERATE", 100, "Anomaly Detected", "Memory", "MEDIUM"),
    (85, 50, 0.64, 1, "HIGH", "MODERATE", 100, "Anomaly Detected", "CPU", "HIGH"),
    (50, 80, 0.68, 1, "HIGH", "MODERATE", 100, "Normal", "Normal", "LOW"),
    (70, 70, 0.7, 1, "HIGH", "HIGH", 30, "Normal", "Normal", "LOW"),
    (90, 95, 0.93, 1, "HIGH", "HIGH", 7, "Anomaly Detected", "CPU", "HIGH"),
    (100, 100, 1.0, 1, "HIGH", "HIGH", 0, "Anomaly Detected", "CPU", "HIGH"),
]


def test_golden_rows(spark):
    df = spark.createDataFrame([(float(g[0]), float(g[1])) for g in GOLDEN],
                               "cpu_percent double, memory_percent double")
    risk = R.risk_score()
    out = df.select(risk.alias("risk"), R.vote(risk).alias("vote"),
                    R.stored_level(risk).alias("stored"), R.band(risk).alias("band"),
                    R.health_percent(risk).alias("health"), R.anomaly_label().alias("anomaly"),
                    R.row_fault().alias("fault"), R.row_severity().alias("severity")).collect()
    for row, g in zip(out, GOLDEN):
        assert abs(row["risk"] - g[2]) < 1e-9
        assert (row["vote"], row["stored"], row["band"], row["health"], row["anomaly"],
                row["fault"], row["severity"]) == g[3:]


def test_failure_window_and_recommendation(spark):
    df = spark.createDataFrame([(39.9,), (40.0,), (60.0,), (80.0,)], "p double")
    out = df.select(R.failure_window("p").alias("w"), R.warning_flag("p").alias("warn"),
                    R.recommendation("p").alias("rec")).collect()
    assert [r["w"] for r in out] == ["7+ Days", "3–7 Days", "1–3 Days", "Within 24 Hours"]
    assert [r["warn"] for r in out] == [False, False, True, True]
    assert out[0]["rec"] == "Continue monitoring."


def test_health_status_and_cause(spark):
    df = spark.createDataFrame([(49, "CPU"), (50, "MEMORY"), (75, "DISK"), (74, "X")],
                               "h int, f string")
    out = df.select(R.health_status("h").alias("s"), R.cause_text("f").alias("c")).collect()
    assert [r["s"] for r in out] == ["Critical", "Warning", "Healthy", "Warning"]
    assert out[3]["c"] == "No significant anomaly detected."
    assert out[1]["c"].startswith("Memory pressure")


def test_contribution(spark):
    df = spark.createDataFrame([("s", 50.0, 70.0, 30.0), ("t", None, None, None)],
                               "system_id string, cpu_percent double, memory_percent double, "
                               "disk_write_mbps double")
    got = {(r["system_id"], r["component"]): r["contribution"] for r in contribution(df).collect()}
    assert [got[("s", c)] for c in ("CPU", "Memory", "Disk", "Other")] == [50, 70, 100, 40]
    assert [got[("t", c)] for c in ("CPU", "Memory", "Disk", "Other")] == [0, 0, 0, 100]
