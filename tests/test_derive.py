"""Derivation goldens: counter rates, SMART text, top process, sessions."""

import datetime as dt

from pyspark.sql import functions as F

from telewatch.functions.smart import smart_fields
from telewatch.operators import derive as D
from telewatch.operators import serving as Q

T0 = dt.datetime(2024, 1, 1)


def test_counter_rate(spark):
    rows = [("h", T0, 1, 0), ("h", T0 + dt.timedelta(seconds=2), 2, 10485760),
            ("h", T0 + dt.timedelta(seconds=2, microseconds=500), 3, 20971520),
            ("h", T0 + dt.timedelta(seconds=4), 4, 0)]
    df = spark.createDataFrame(rows, "hostname string, ts timestamp_ntz, id long, write_bytes long")
    out = D.counter_rates(df, ["write_bytes"]).orderBy("id").collect()
    rates = [r["write_bytes_mbps"] for r in out]
    assert rates[0] == 0.0 and rates[1] == 5.0 and rates[2] == 0.0 and rates[3] < 0


SMART = ("Model Number:   X Y\nSMART overall-health self-assessment test result: PASSED\n"
         "Percentage Used:   3%\nAvailable Spare:   100%\nTemperature:   41 Celsius\n"
         "Data Units Written:   12,345,678 [6.32 TB]\nPower On Hours:   1,234\n"
         "Media and Data Integrity Errors:   0\n")


def test_smart_fields(spark):
    texts = [SMART, SMART.replace("[6.32 TB]", "[512 GB]"), SMART.replace("[6.32 TB]", "[2 PB]"),
             SMART.replace("[6.32 TB]", "[9 MB]"), ""]
    df = spark.createDataFrame([(t,) for t in texts], "report string")
    out = df.select(*smart_fields(F.col("report"))).collect()
    assert tuple(out[0]) == ("X Y", "PASSED", 3, 100, 41, 6.32, 1234, 0)
    assert [r["ssd_data_written_tb"] for r in out[1:4]] == [0.5, 2048.0, None]
    assert all(v is None for v in out[4])


def test_top_process(spark):
    procs = spark.createDataFrame(
        [("h", T0, 3, "a", 5.0, None), ("h", T0, 1, "b", None, None), ("h", T0, 2, "c", 5.0, None)],
        "hostname string, ts timestamp_ntz, pid int, name string, cpu_percent double, "
        "memory_percent double")
    snaps = spark.createDataFrame([("h", T0), ("h", T0 + dt.timedelta(seconds=1))],
                                  "hostname string, ts timestamp_ntz")
    out = D.top_processes(procs, snaps).orderBy("ts").collect()
    assert (out[0]["top_cpu_process"], out[0]["top_cpu_pid"]) == ("c", 2)
    assert (out[0]["top_mem_process"], out[0]["top_mem_pid"]) == ("b", 1)
    assert (out[1]["top_cpu_process"], out[1]["top_cpu_pid"], out[1]["process_count"]) == \
        ("unknown", 0, 0)


def test_state_distribution_zero_fill(spark):
    df = spark.createDataFrame([("s", "Moderate")] * 4, "session_id string, load_state string")
    r = D.state_distribution(df).collect()[0]
    assert (r["normal_count"], r["moderate_count"], r["high_count"]) == (0, 4, 0)
    assert (r["normal_pct"], r["moderate_pct"], r["high_pct"]) == (0.0, 100.0, 0.0)


def test_report_and_pages(spark):
    rows = [("s", i, T0 + dt.timedelta(hours=i), c, 10.0, 1.0)
            for i, c in enumerate([90.0, 10.0, 20.0, 30.0])]
    df = spark.createDataFrame(rows, "system_id string, id long, ts timestamp_ntz, "
                                     "cpu_percent double, memory_percent double, "
                                     "disk_write_mbps double")
    r = Q.report(df).collect()[0]
    assert (r["total"], r["anomalies"], r["healthy"], r["healthy_pct"]) == (4, 1, 3, 75.0)
    empty = Q.report(df.filter("false"), key=None).collect()[0]
    assert (empty["total"], empty["healthy_pct"], empty["avg_cpu"]) == (0, 0.0, 0.0)
    many = spark.range(21).selectExpr("'s' AS system_id", "id",
                                      "timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,0,id) AS ts")
    pages = Q.paginate(many).collect()
    assert {r["pages"] for r in pages} == {2}
    assert sum(1 for r in pages if r["page"] == 2) == 1


def test_completeness_and_clock(spark):
    rows = [("s", i, T0 + dt.timedelta(seconds=i)) for i in range(3)]
    df = spark.createDataFrame(rows, "session_id string, id long, ts timestamp_ntz")
    c = D.completeness(df, 10, 1).collect()[0]
    assert (c["expected"], c["actual"], c["progress_pct"], c["remaining"]) == \
        (10, 3, 30.0, "00h 00m 07s")
    clk = D.sample_numbers(D.session_clock(df)).orderBy("id").collect()
    assert [r["sample_number"] for r in clk] == [1, 2, 3]
    assert [r["elapsed_seconds"] for r in clk] == [0.0, 1.0, 2.0]
