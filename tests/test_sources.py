"""CSV sources and sinks: labelled folders, schema guard, collector / moderate layouts."""

import contextlib
import csv
import io
import os
import random
import tempfile

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telewatch.schemas import FEATURES, TELEMETRY
from telewatch.sources import ranged
from telewatch.sources.files import (read_by_name, read_calibration_csv, read_labelled, read_moderate_csv,
                                     read_telemetry_csv, schema_guard)
from telewatch.sources.sinks import write_collection_files, write_session_files


def _write(path, header, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join(str(x) for x in r) + "\n")


def test_labelled_scan_guard_and_column_order(spark):
    base = tempfile.mkdtemp(prefix="telewatch-labelled-")
    feats = list(FEATURES)
    row = [float(i + 1) for i in range(9)] + [7]
    _write(f"{base}/normal/a.csv", ["timestamp", *feats], [["2024-01-01 00:00:00", *row]])
    # same columns in another order: read by name
    rev = list(reversed(feats))
    _write(f"{base}/moderate/b.csv", rev, [list(reversed(row))])
    # missing a feature: skipped and reported
    _write(f"{base}/high/c.csv", feats[:-1], [row[:-1]])
    _write(f"{base}/high_load/d.csv", feats, [row, row])
    _write(f"{base}/high_load/notes.txt", ["x"], [])          # not a CSV: ignored
    rows, rejected = read_labelled(spark, base)            # 'normal'..'high_load' only
    got = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    assert got == {"Normal": 1, "Moderate": 1, "High": 2}
    assert rows.filter(F.col("label") == "Moderate").first()["cpu_percent"] == 1.0
    rej = rejected.collect()
    assert len(rej) == 1 and rej[0]["file"].endswith("/high/c.csv")
    assert rej[0]["missing"] == ["process_count"]


def test_missing_folders_are_skipped(spark):
    base = tempfile.mkdtemp(prefix="telewatch-labelled-")
    _write(f"{base}/normal/a.csv", list(FEATURES), [[1.0] * 9 + [1]])
    rows, _ = read_labelled(spark, base)
    assert rows.count() == 1
    guard = schema_guard(spark, [f"{base}/normal"]).collect()
    assert guard[0]["missing"] == []


def test_session_files_round_trip(spark):
    base = tempfile.mkdtemp(prefix="telewatch-sessions-")
    df = spark.createDataFrame(
        [("2024-01-01 10:00:00", "h1", 12.5, "s1"), ("2024-01-01 10:00:01", "h1", 13.5, "s1"),
         ("2024-01-01 11:00:00", "h2", 50.0, "s2")],
        "timestamp string, hostname string, cpu_percent double, session_id string")
    write_session_files(df, base)
    assert os.path.isdir(os.path.join(base, "host=h1", "session=s1"))
    back = read_telemetry_csv(spark, base)
    got = {r["hostname"]: r["count"] for r in back.groupBy("hostname").count().collect()}
    assert got == {"h1": 2, "h2": 1}
    first = back.filter("hostname = 'h2'").first()
    assert first["cpu_percent"] == 50.0 and str(first["ts"]) == "2024-01-01 11:00:00"
    assert first["ssd_model"] is None


def test_session_files_are_written_in_place(spark, monkeypatch):
    """By as many tasks as there are partitions, not by Spark's partitioned
    writer; the same folders and the same records as that one writes."""
    rows = [("2024-01-01 10:00:00", "a:b/c%", "", None, "s=1"), ("2024-01-01 10:00:02", "a:b/c%", 'q"x,\ny', 1.0, "s=1"),
            ("2024-01-01 10:00:01", None, "z", 0.1, ""), *[(f"2024-01-01 11:{i:02d}:00", f"h{i}", "t", 2.0, "s") for i in range(40)]]
    df = spark.createDataFrame(rows, "timestamp string, hostname string, top_cpu_process string, cpu_percent double, session_id string")
    base, plain = (tempfile.mkdtemp(prefix="telewatch-sessions-") for _ in range(2))
    (df.withColumnRenamed("session_id", "session").selectExpr("*", "hostname AS host").coalesce(1).sortWithinPartitions(
        "host", "session", "timestamp").write.mode("overwrite").option("header", True).partitionBy("host", "session").csv(plain))
    monkeypatch.setattr(DataFrameWriter, "partitionBy", None)
    write_session_files(df, base)

    def held(folder):
        out = {}
        for at, _, names in os.walk(folder):
            for name in sorted(n for n in names if n.endswith(".csv")):
                with open(os.path.join(at, name), newline="") as f:
                    out.setdefault(os.path.relpath(at, folder), []).append(f.read())
        return out
    assert held(base) == held(plain) and "_SUCCESS" in os.listdir(base)
    tasks = {n.split("-")[1] for _, _, names in os.walk(base) for n in names if n.endswith(".csv")}
    assert len(tasks) > 1
    with pytest.raises(FileExistsError):
        write_session_files(df, base, mode="error")
    write_session_files(df, base, mode="append")
    assert all(len(files) == 2 for files in held(base).values())


def test_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The files that Spark's reader finds, without its listing."""
    for name in ("a.csv", "b.txt", "_c.csv", ".d.csv", "e%3A é.csv", "x/f.csv", "x/y/g.csv", "x/_h/i.csv", "x/.l/m.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("a,b\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    want = {}
    for nested in (False, True):
        want[nested] = {(r.path, r.length) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option(
            "recursiveFileLookup", nested).load(str(tmp_path)).where("length > 0").select("path", "length").collect()}
    one = str(tmp_path / "x/f.csv")
    monkeypatch.setattr(type(spark), "read", None)
    monkeypatch.setattr(ranged, "materialize", lambda df: df)
    for nested in (False, True):
        assert {tuple(r) for r in ranged.csv_files(spark, str(tmp_path), nested).collect()} == want[nested]
    assert [r.size for r in ranged.csv_files(spark, one).collect()] == [8]
    with pytest.raises(FileNotFoundError):
        ranged.csv_files(spark, str(tmp_path / "none"))


def test_moderate_and_calibration_csv(spark):
    base = tempfile.mkdtemp(prefix="telewatch-moderate-")
    from telewatch.schemas import MODERATE
    names = [f.name for f in MODERATE.fields]
    vals = ["2024-01-01T10:00:00.500000"] + ["1.5"] * 14 + ["Moderate"] + ["2.0"] * 3 + ["1", "1704103200.5"]
    vals[14] = "42"  # process_count
    _write(f"{base}/m.csv", names, [vals])
    m = read_moderate_csv(spark, base).first()
    assert m["process_count"] == 42 and m["load_state"] == "Moderate"
    assert str(m["ts"]) == "2024-01-01 10:00:00.500000"
    cal = tempfile.mkdtemp(prefix="telewatch-cal-")
    _write(f"{cal}/live.csv", ["cpu_percent", "extra", "memory_percent", "memory_available_mb",
                               "disk_write_mbps"], [[1, "x", 2, 3, 4], [5, "y", 6, "bad", 8]])
    c = read_calibration_csv(spark, cal).orderBy("cpu_percent").collect()
    assert [tuple(r) for r in c] == [(1.0, 2.0, 3.0, 4.0), (5.0, 6.0, None, 8.0)]


def test_all_files_rejected(spark):
    base = tempfile.mkdtemp(prefix="telewatch-labelled-")
    _write(f"{base}/normal/a.csv", list(FEATURES)[:-1], [[1.0] * 9])
    rows, rejected = read_labelled(spark, base)
    assert rows.count() == 0 and "label" in rows.columns
    assert rejected.count() == 1


def test_files_of_one_folder_may_order_columns_differently(spark):
    base = tempfile.mkdtemp(prefix="telewatch-order-")
    a = ["timestamp", "hostname", "cpu_percent", "memory_percent", "ssd_model", "ssd_temperature"]
    b = ["memory_percent", "ssd_temperature", "timestamp", "cpu_percent", "hostname"]
    _write(f"{base}/a.csv", a, [["2024-01-01 10:00:00", "h1", 1.0, 2.0, '"Disk, large"', 41]])
    _write(f"{base}/b.csv", b, [[20.0, 33, "2024-01-01 10:00:01", 10.0, "h2"]])
    got = {r["hostname"]: (r["cpu_percent"], r["memory_percent"], r["ssd_model"], r["ssd_temperature"])
           for r in read_telemetry_csv(spark, base).collect()}
    assert got == {"h1": (1.0, 2.0, "Disk, large", 41), "h2": (10.0, 20.0, None, 33)}
    cal = tempfile.mkdtemp(prefix="telewatch-order-")
    names = ["cpu_percent", "memory_percent", "memory_available_mb", "disk_write_mbps"]
    _write(f"{cal}/a.csv", names, [[1, 2, 3, 4]])
    _write(f"{cal}/b.csv", list(reversed(names)), [[40, 30, 20, 10]])
    rows = {tuple(r) for r in read_calibration_csv(spark, cal).collect()}
    assert rows == {(1.0, 2.0, 3.0, 4.0), (10.0, 20.0, 30.0, 40.0)}


@pytest.mark.parametrize("step", [None, 100, 16_384])
def test_rows_keep_the_order_of_their_file(spark, step):
    base = tempfile.mkdtemp(prefix="telewatch-rows-")
    _write(f"{base}/normal/a.csv", list(FEATURES), [[float(i)] * 9 + [i] for i in range(3000)])
    with _ranges(spark, step):
        rows, _ = read_labelled(spark, base)
        got = [r["process_count"] for r in rows.orderBy("source_file", "place").collect()]
    assert got == list(range(3000))


def test_folders_inside_a_labelled_folder_are_not_read(spark):
    base = tempfile.mkdtemp(prefix="telewatch-nested-")
    _write(f"{base}/normal/a.csv", list(FEATURES), [[1.0] * 9 + [1]])
    _write(f"{base}/normal/archive/b.csv", list(FEATURES), [[2.0] * 9 + [2]])
    _write(f"{base}/normal/archive/c.csv", ["other"], [[2.0]])
    rows, rejected = read_labelled(spark, base)
    assert [(r["label"], r["process_count"]) for r in rows.collect()] == [("Normal", 1)]
    assert rejected.count() == 0


@contextlib.contextmanager
def _ranges(spark, step):
    if step:
        spark.conf.set(ranged.RANGE_BYTES_CONF, step)
    try:
        yield
    finally:
        spark.conf.unset(ranged.RANGE_BYTES_CONF)


def _quoted_rows(seed, n=300):
    rng = random.Random(seed)
    parts = ['plain', 'a,b', 'say ""', '"', '\n', '\r\n', '\n\n', 'é', ' ', 'x' * 50, '1,2\n3,"4"']
    return [[f"h{i}", str(i / 4), "".join(rng.choice(parts) for _ in range(rng.randint(0, 6))).strip() or "z", str(i)]
            for i in range(n)]


@pytest.mark.parametrize("step", [7, 64, 1000, None])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_equal_a_plain_parser(spark, step, end):
    base = tempfile.mkdtemp(prefix="telewatch-quoted-")
    want = {}
    for name in ("a", "b"):
        rows = _quoted_rows(name, 40 if step == 7 else 300)
        with open(f"{base}/{name}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["hostname", "cpu_percent", "ssd_model", "process_count"])
            w.writerows(rows)
        with open(f"{base}/{name}.csv", newline="", encoding="utf-8") as f:
            want[name] = [(r["hostname"], float(r["cpu_percent"]), r["ssd_model"], int(r["process_count"]))
                          for r in csv.DictReader(f)]
    schema = T.StructType([f for f in TELEMETRY.fields
                           if f.name in ("hostname", "cpu_percent", "ssd_model", "process_count")])
    with _ranges(spark, step):
        got = read_by_name(spark, base, schema).orderBy("source_file", "place").collect()
    for name in want:
        mine = [(r.hostname, r.cpu_percent, r.ssd_model, r.process_count) for r in got
                if r.source_file.endswith(f"{name}.csv")]
        assert mine == want[name]


@pytest.mark.parametrize("chunk", [1, 3, 10, 1 << 20])
def test_ranges_cover_every_record_once(monkeypatch, chunk):
    """Any cut of any file: the records of its ranges are those of the whole file."""
    monkeypatch.setattr(ranged, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(60):
        data = "".join(rng.choice(['a', ',', '\n', '"b\nc"', '""', '\r\n', 'é']) for _ in range(rng.randint(0, 40))).encode()
        whole = list(ranged.records_of(io.BytesIO(data), 0, len(data), False))
        assert [p for p, _ in whole] == sorted({p for p, _ in whole})
        for step in (1, 2, 5, 13):
            got = []
            for at in range(0, len(data), step):
                got += ranged.records_of(io.BytesIO(data), at, at + step, data[:at].count(b'"') % 2 == 1)
            assert got == whole


def test_the_guard_reads_a_few_kb_of_each_file(spark, monkeypatch):
    """A header longer than the first read is read whole; nothing behind it is."""
    class Counted(io.BytesIO):
        got = 0

        def read(self, n=-1):
            out = super().read(n)
            Counted.got += len(out)
            return out
    wide = [f"column_{i}_with_a_long_name" for i in range(1000)] + ['two\nlines']
    body = io.StringIO()
    csv.writer(body).writerow(wide)
    assert ranged.header_of(Counted(("\ufeff" + body.getvalue() + "1,2,3\n" * 10 ** 6).encode())) == wide
    assert Counted.got < 70_000
    Counted.got = 0
    assert ranged.header_of(Counted(b"a,b\n" + b"1,2\n" * 10 ** 6)) == ["a", "b"]
    assert Counted.got == ranged.HEAD
    assert ranged.header_of(io.BytesIO(b"")) == [] and ranged.header_of(io.BytesIO(b"x, y ")) == ["x", "y"]


def test_one_named_file_per_run(spark):
    base = tempfile.mkdtemp(prefix="telewatch-runs-")
    rows = [("2024-01-01 10:00:00", "h1", "a, \"b\"\nc", "s1"), ("2024-01-01 10:00:01", "h1", None, "s1"),
            ("2024-01-01 10:00:00", "h1", "x", "s2"), ("2024-01-01 11:00:00", "h/2 ü", "", "s1"),
            ("2024-01-02 11:00:00", None, "y", "s1"), (None, "h3", "z", None), ("no time", "h3", "w", None)]
    rows += [(f"2024-02-01 00:00:{i:02d}", "hot", str(i), "s9") for i in range(25)]
    df = spark.createDataFrame(rows, "timestamp string, hostname string, note string, session_id string")
    for parts in (1, 5):                                   # written again: the same files, no others
        found = write_collection_files(df.repartition(parts), base, rows_per_file=10)
        manifest = {r["file"]: r["n_rows"] for r in found.collect()}
        assert manifest == {
            "h1_20240101_100000.csv": 2, "h1_20240101_100000_2.csv": 1, "h%2F2+%C3%BC_20240101_110000.csv": 1,
            "unknown_20240102_110000.csv": 1, "h3_undated.csv": 2, "hot_20240201_000000.csv": 10,
            "hot_20240201_000010.csv": 10, "hot_20240201_000020.csv": 5}
        assert sorted(n for n in os.listdir(base) if not n.startswith(".")) == sorted(manifest)
        assert not [n for n in os.listdir(base) if n.startswith(".") and not n.endswith(".crc")]
    held = []
    for name in manifest:
        with open(os.path.join(base, name), encoding="utf-8", newline="") as f:
            head, *body = list(csv.reader(f))
        assert head == ["timestamp", "hostname", "note"] and body == sorted(body)
        held += [tuple(x) for x in body]
    assert sorted(held) == sorted(tuple(x or "" for x in r[:3]) for r in rows)
    back = read_by_name(spark, base, df.drop("session_id").schema)
    assert back.count() == len(rows) and back.where("hostname = 'h1' AND note LIKE '%\\nc'").count() == 1
    assert write_collection_files(df.limit(0), tempfile.mkdtemp(prefix="telewatch-runs-")).count() == 0
