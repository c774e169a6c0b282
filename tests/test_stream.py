"""Batch equals stream, however the ticks are cut into files and ordered."""

import glob
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from telewatch.functions import risk as R
from telewatch.operators import alerts as A
from telewatch.plans import catalog_stream as C
from telewatch.plans.catalog_stream import ticks
from telewatch.sources.tables import telemetry
from telewatch.streaming.live import derive_ticks, run_to_end, start_alerts, start_live
from telewatch.streaming.commits import Sinks, read_sink
from telewatch.streaming.state import System, pack, unpack

from .conftest import SF001


def _tick_files(spark, n, shuffled=False):
    """Ticks in n time-ordered files, linked into a folder in or out of order."""
    base = tempfile.mkdtemp(prefix="telewatch-stream-")
    ticks(spark, SF001).repartitionByRange(n, "ts").write.parquet(os.path.join(base, "cut"))
    files = sorted(glob.glob(os.path.join(base, "cut", "*.parquet")))
    if shuffled:
        random.Random(5).shuffle(files)
    os.makedirs(os.path.join(base, "ticks"))
    for i, f in enumerate(files):
        target = os.path.join(base, "ticks", f"{i:03d}.parquet")
        os.link(f, target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return base


def _batch_alerts(spark):
    scored = telemetry(spark, SF001).withColumn("risk_score", R.risk_score())
    return ({(r["system_id"], r["id"], "MODERATE") for r in A.moderate_cooldown(scored, 86400).collect()}
            | {(r["system_id"], r["id"], "SUSTAINED_HIGH") for r in A.sustained_high(scored, 3).collect()})


def _alerts(spark, out):
    rows = [(r["system_id"], r["id"], r["alert_type"]) for r in read_sink(spark, out, "alerts").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("files,shuffled,retain", [(1, False, 0), (3, False, 0), (10, True, None)])
def test_alerts_do_not_depend_on_files_or_order(spark, files, shuffled, retain):
    """Files in time order need no retained tick; shuffled ones need them all."""
    base = _tick_files(spark, files, shuffled)
    out = os.path.join(base, "out")
    run_to_end(start_alerts(spark, os.path.join(base, "ticks"), out, os.path.join(base, "ckpt"),
                            cooldown_s=86400, streak_len=3, max_files=1 if retain == 0 else 4, retain_s=retain), 300)
    assert _alerts(spark, out) == _batch_alerts(spark)
    assert read_sink(spark, out, "aside").count() == 0


def test_all_sinks_equal_the_batch(spark):
    base = _tick_files(spark, 6, shuffled=True)
    out = os.path.join(base, "out")
    run_to_end(start_live(spark, os.path.join(base, "ticks"), out, os.path.join(base, "ckpt"), max_files=3, retain_s=None), 300)
    want = derive_ticks(ticks(spark, SF001))
    metrics = read_sink(spark, out, "metrics")
    cols = ["system_id", "id", "disk_write_mbps", "top_cpu_process", "top_mem_process"]
    assert metrics.select(cols).exceptAll(want.select(cols)).count() == 0
    n = want.count()
    assert [read_sink(spark, out, s).count() for s in ("metrics", "predictions", "packets")] == [n] * 3
    log = read_sink(spark, out, "live_log")
    assert log.count() == n
    assert log.columns == ["cpu", "memory", "disk", "risk", "process_count", "memory_available_mb",
                           "timestamp", "top_cpu_process", "top_mem_process"]


def test_alerts_survive_a_restart(spark):
    """Stop after half the tick files, restart from the checkpoint: same alerts."""
    base = _tick_files(spark, 4)
    files = sorted(glob.glob(os.path.join(base, "ticks", "*.parquet")))
    live, out, ckpt = (os.path.join(base, x) for x in ("live", "out", "ckpt"))
    os.makedirs(live)
    for half in (files[:2], files[2:]):
        for f in half:
            os.link(f, os.path.join(live, os.path.basename(f)))
        run_to_end(start_alerts(spark, live, out, ckpt, cooldown_s=86400, streak_len=3, max_files=1, retain_s=86400), 300)
    assert _alerts(spark, out) == _batch_alerts(spark)


def test_a_stream_that_is_not_done_in_time_raises(spark):
    base = _tick_files(spark, 2)
    q = start_live(spark, os.path.join(base, "ticks"), os.path.join(base, "out"), os.path.join(base, "ckpt"), max_files=1)
    with pytest.raises(TimeoutError):
        run_to_end(q, 0.01)
    assert not q.isActive


def test_a_fresh_checkpoint_keeps_earlier_output(spark):
    base = _tick_files(spark, 1)
    out = os.path.join(base, "out")
    for n in range(2):
        run_to_end(start_live(spark, os.path.join(base, "ticks"), out, os.path.join(base, f"ckpt{n}"), retain_s=None), 300)
    assert read_sink(spark, out, "metrics").count() == 2 * telemetry(spark, SF001).count()


def test_top_process_of_a_tick(spark):
    from telewatch.operators.derive import top_of_list
    t = "array<struct<pid:int,name:string,cpu_percent:double,memory_percent:double>>"
    df = spark.createDataFrame([(1, [(7, "a", 5.0, 1.0), (3, "b", 5.0, 9.0), (9, None, None, None)]), (2, []), (3, None)],
                               f"id int, processes {t}")
    got = {r.id: (r.c, r.m) for r in df.select("id", top_of_list("processes", "cpu_percent").alias("c"),
                                               top_of_list("processes", "memory_percent").alias("m")).collect()}
    assert got == {1: ("b", "b"), 2: ("N/A", "N/A"), 3: ("N/A", "N/A")}
    assert df.select(F.lit(1)).count() == 3


def _fold(ticks, cooldown, length, high=0.7, moderate=0.4):
    """Plain fold over one system in order: {(id, type, streak)} and {id: moved}."""
    fires, moved, fire, run, prev = set(), {}, None, 0, None
    for t, i, risk, counter, _ in sorted(ticks):
        moved[i] = None if prev is None else counter - prev
        prev = counter
        run = run + 1 if risk >= high else 0
        if run and run % length == 0:
            fires.add((i, "SUSTAINED_HIGH", run))
        if moderate <= risk < high and (fire is None or t - fire > cooldown):
            fire = t
            fires.add((i, "MODERATE", None))
    return fires, moved


@pytest.mark.parametrize("seed", range(12))
def test_state_equals_a_plain_fold_for_any_cut_and_order(seed):
    rng = random.Random(seed)
    rules = {"cooldown": 50, "length": 3, "moderate": 0.4, "high": 0.7, "retain": 10 ** 9}
    ticks = [(t, n, rng.choice([0.1, 0.5, 0.6, 0.8, 0.9]), rng.randrange(1000), "p") for n, t in
             enumerate(sorted(rng.sample(range(3000), 200)))]
    arrived = sorted(ticks, key=lambda x: x[0] + rng.randrange(800))
    saved, alerts, last, given = None, {}, {}, 0
    while arrived:
        n = rng.randrange(1, 40)
        batch, arrived = arrived[:n], arrived[n:]
        rules["retain"] = rng.choice([800, 900])
        system = System(saved)
        for i, t, kind, rev, sign, moved, alert, streak, _ in system.absorb(batch, rules):
            if kind == "tick":
                assert rev == (last[i][0] + 1 if i in last else 0)
                last[i], given = (rev, moved), given + 1
            else:
                assert kind == "alert"
                alerts[i, alert, streak] = alerts.get((i, alert, streak), 0) + sign
        saved = system.saved()
        assert set(alerts.values()) <= {0, 1}
        assert all(t >= system.clock - 900 for t, *_ in system.ticks)
    fires, moved = _fold(ticks, 50, 3)
    assert {k for k, v in alerts.items() if v} == fires
    assert {i: m for i, (_, m) in last.items()} == moved
    assert given >= len(ticks)


def test_late_repeated_and_untimed_ticks_are_put_aside():
    rules = {"cooldown": 50, "length": 2, "moderate": 0.4, "high": 0.7, "retain": 100}
    system = System()
    first = list(system.absorb([(1000, 1, 0.8, 5, "a"), (1000, 2, 0.8, 5, "b"), (None, 3, 0.8, 5, "c")], rules))
    assert [(r[0], r[2]) for r in first] == [(2, "repeated"), (3, "untimed"), (1, "tick")]
    system = System(system.saved())
    second = list(system.absorb([(899, 4, 0.8, 4, "d"), (900, 5, 0.8, 3, "e"), (1000, 6, 0.8, 9, "f")], rules))
    assert [(r[0], r[2]) for r in second] == [(4, "late"), (6, "repeated"), (5, "tick"), (1, "tick"), (1, "alert")]
    assert second[3][3:6] == (1, 1, 2)                       # revision 1: moved 5 - 3
    assert list(System(system.saved()).absorb([], rules)) == []


def _live_batches(spark, base, n):
    files = sorted(glob.glob(os.path.join(base, "ticks", "*.parquet")))
    live, out, ckpt = (os.path.join(base, x) for x in ("live", "out", "ckpt"))
    os.makedirs(live, exist_ok=True)
    for f in files[:n]:
        if not os.path.exists(os.path.join(live, os.path.basename(f))):
            os.link(f, os.path.join(live, os.path.basename(f)))
    q = start_live(spark, live, out, ckpt, max_files=1, retain_s=0)
    run_to_end(q, 600)
    return out, q


def test_work_per_batch_follows_its_own_ticks(spark, monkeypatch):
    """20 batches in time order: no batch reads or writes more rows than its own ticks."""
    base = _tick_files(spark, 20)
    written = {}
    write = Sinks.write

    def counted(self, df, name, batch_id):
        out = write(self, df, name, batch_id)
        written[name, batch_id] = df.count()
        return out
    monkeypatch.setattr(Sinks, "write", counted)
    out, q = _live_batches(spark, base, 20)
    seen = {p["batchId"]: p["numInputRows"] for p in q.recentProgress if p["numInputRows"]}
    assert len(seen) == 20
    for name in ("metrics", "predictions", "packets", "live_log"):
        assert {b: written[name, b] for b in seen} == seen
    query = Sinks(spark, out, os.path.basename(glob.glob(os.path.join(out, "query_id=*"))[0]).split("=")[1])
    before = {s: sorted(map(str, read_sink(spark, out, s).collect())) for s in ("metrics", "alerts", "live_log", "aside")}
    opened = len(query.paths("metrics"))
    query.compact()
    assert len(query.paths("metrics")) == opened - 15
    for s, rows in before.items():
        assert sorted(map(str, read_sink(spark, out, s).collect())) == rows


def test_a_batch_is_seen_whole_or_not_at_all(spark, monkeypatch):
    """A batch that fails between two sinks changes nothing for readers; the retry completes it."""
    base = _tick_files(spark, 3)
    out, _ = _live_batches(spark, base, 2)
    sinks = ("metrics", "predictions", "packets", "live_log")
    before = [read_sink(spark, out, s).count() for s in sinks]
    write = Sinks.write

    def broken(self, df, name, batch_id):
        if name == "packets":
            raise OSError("no space left")
        return write(self, df, name, batch_id)
    monkeypatch.setattr(Sinks, "write", broken)
    with pytest.raises(Exception, match="no space left"):
        _live_batches(spark, base, 3)
    assert [read_sink(spark, out, s).count() for s in sinks] == before
    monkeypatch.setattr(Sinks, "write", write)
    _live_batches(spark, base, 3)
    assert [read_sink(spark, out, s).count() for s in sinks] == [telemetry(spark, SF001).count()] * 4


def test_merged_runs_cover_the_batches():
    for n in (0, 5, 16, 31, 32, 256, 300, 4096 + 272):
        spans = Sinks._spans(None, n)
        assert [x for a, b in spans for x in range(a, b)] == list(range(n // 16 * 16))


def test_systems_share_state_rows(spark):
    """Every state row costs Python a set of pandas frames, so many systems are in one."""
    base = _tick_files(spark, 2)
    out = os.path.join(base, "out")
    q = start_alerts(spark, os.path.join(base, "ticks"), out, os.path.join(base, "ckpt"), cooldown_s=86400, streak_len=3,
                     max_files=1, retain_s=0, groups=3)
    run_to_end(q, 300)
    assert _alerts(spark, out) == _batch_alerts(spark)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 3 < _systems(spark)


def _systems(spark):
    return telemetry(spark, SF001).select("system_id").distinct().count()


def test_a_state_row_gives_its_systems_back():
    rules = {"cooldown": 50, "length": 2, "moderate": 0.4, "high": 0.7, "retain": 100}
    held = {}
    for name, n in (("a", 3), (None, 1), ("b", 0), ("c", 2)):
        system = System()
        list(system.absorb([(1000 + k, k, 0.5, k, None) for k in range(n)], rules))
        held[name] = system.saved()
    assert unpack(pack(held)) == held
    assert unpack(pack({})) == {}


def test_an_arrival_of_many_files_is_one_batch(spark, tmpdir_path):
    """An arrival is written by many tasks and still read in one micro-batch, in order."""
    rows = spark.range(0, 600, 1, 4).selectExpr("id", "cast(id % 6 as int) as _file")
    path, seen = os.path.join(tmpdir_path, "ticks"), []

    class Ended:
        def awaitTermination(self):
            seen.append((len(glob.glob(path + "/*.parquet")), spark.read.parquet(path).count()))
    C.deliver(rows, path, lambda source: Ended(), per_run=2)
    assert [n for _, n in seen] == [200, 400, 600]
    assert seen[0][0] > 2


@pytest.mark.parametrize("query", ["t1_t2_streaming_state", "s11_late_and_repeated"])
def test_each_run_of_arrivals_is_a_batch(spark, monkeypatch, query):
    runs = []
    monkeypatch.setattr(C, "run_to_end", lambda q: (run_to_end(q), runs.append(
        [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]])))
    {"t1_t2_streaming_state": C.stream_alerts, "s11_late_and_repeated": C.late_and_repeated}[query](spark, SF001)
    assert [len(r) for r in runs] == [1] * (3 if query == "t1_t2_streaming_state" else 6)
