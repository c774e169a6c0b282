"""Keyed state of the live stream: order, repeats, counters and alerts per system.

One stateful operator holds, per system, the ticks of its last ``retain_s``
seconds and what came before them as a carry: the last moderate fire, the
length of the running high streak and the last write counter.  Systems share
``GROUPS`` state rows by a hash of their name, since Spark hands every state
row to Python as pandas frames of its own, which costs far more than the few
ticks of a system.  A micro-batch loads the state rows of the systems it touches
and folds these systems only; what it costs follows its own ticks and the
retained ones, not the history.

Ticks are decided on arrival, in event order.  A tick that arrives after later
ones is put in its place: the retained ticks are folded again from the carry,
and what had been said about them is corrected - a tick whose counter delta
changed is given out again with the next revision, an alert that no longer
holds is taken back (``sign`` -1) and one that now does is given (+1).  So the
rows that remain do not depend on how ticks were cut into files and batches,
nor on the order they came in, as long as none is late.

``late`` ticks (older than the latest tick of their system in an earlier batch
by more than ``retain_s``), ``repeated`` ones (a retained or new tick of the
system has their time) and ``untimed`` ones change nothing and are given out
under that kind.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import risk as R
from ..functions.timefn import epoch_micros

US = 1_000_000
RETAIN_S = 3_600.0
ASIDE = ("late", "repeated", "untimed")

CHANGES = ("system_id string, id long, t long, kind string, rev int, sign int, moved long, "
           "alert_type string, streak long, payload string")
#: One entry per system, ``held`` its retained ticks; then one per retained tick, system after system.
STATE = ("systems array<string>, held array<int>, clocks array<long>, fires array<long>, runs array<long>, "
         "lasts array<long>, ts array<long>, ids array<long>, risks array<double>, counters array<long>, "
         "payloads array<string>, moved array<long>, revs array<int>, fired array<boolean>, streaks array<long>")
PER_SYSTEM = ("clock", "fire", "streak", "counter")
PER_TICK = ("ts", "ids", "risks", "counters", "payloads", "moved", "revs", "fired", "streaks")
#: State rows that systems are dealt out to; a checkpoint keeps the number it was started with.
GROUPS = 1024


def _order(tick) -> tuple:
    """Time, then id (a missing one first, as Spark sorts), ticks without a time last."""
    return tick[0] is None, tick[0] or 0, tick[1] is not None, tick[1] or 0


class Carry:
    """What the ticks so far leave to the next one of a system."""

    def __init__(self, fire=None, streak=0, counter=None):
        self.fire, self.streak, self.counter = fire, streak, counter

    def step(self, t, risk, counter, rules) -> tuple:
        """``(moved, fires moderate, streak that fires or None)`` of the next tick.

        The counter delta is empty on the first tick; a moderate tick fires when
        more than the cooldown passed since the last fire; every ``length``-th
        consecutive high tick fires, and any other tick (also one without a
        score) ends the streak.
        """
        moved = counter - self.counter if counter is not None and self.counter is not None else None
        self.counter = counter
        high = risk is not None and risk >= rules["high"]
        self.streak = self.streak + 1 if high else 0
        fires = (risk is not None and rules["moderate"] <= risk < rules["high"]
                 and (self.fire is None or t - self.fire > rules["cooldown"]))
        if fires:
            self.fire = t
        return moved, fires, self.streak if high and self.streak % rules["length"] == 0 else None


class System:
    """State of one system; ``absorb`` takes the ticks of a micro-batch."""

    def __init__(self, saved=None):
        self.clock, fire, streak, counter, *lists = saved or (None, None, 0, None, *([] for _ in PER_TICK))
        self.carry = Carry(fire, streak, counter)
        self.ticks = [list(x) for x in zip(*lists, strict=True)]     # [t, id, risk, counter, payload, moved, rev, fired, streak]

    def saved(self) -> tuple:
        lists = [list(x) for x in zip(*self.ticks, strict=True)] or [[] for _ in PER_TICK]
        return (self.clock, self.carry.fire, self.carry.streak, self.carry.counter, *lists)

    def absorb(self, new: list[tuple], rules: dict) -> Iterator[tuple]:
        """Rows of ``CHANGES`` without the system: ``new`` is (t, id, risk, counter, payload)."""
        floor = None if self.clock is None or rules["retain"] is None else self.clock - rules["retain"]
        times = [x[0] for x in self.ticks]
        fresh: list[list] = []
        for t, i, risk, counter, payload in sorted(new, key=_order):
            aside = None
            if t is None:
                aside = "untimed"
            elif floor is not None and t < floor:
                aside = "late"
            else:
                at = bisect_left(times, t)
                if (at < len(times) and times[at] == t) or (fresh and fresh[-1][0] == t):
                    aside = "repeated"
            if aside:
                yield i, t, aside, 0, 1, None, None, None, payload
            else:
                fresh.append([t, i, risk, counter, payload, None, None, False, None])
        if not fresh:
            return
        self.ticks = sorted(self.ticks + fresh, key=_order)
        self.clock = fresh[-1][0] if self.clock is None else max(self.clock, fresh[-1][0])
        floor = None if rules["retain"] is None else self.clock - rules["retain"]
        run, keep, kept = Carry(self.carry.fire, self.carry.streak, self.carry.counter), None, 0
        for n, tick in enumerate(self.ticks):
            t, i, risk, counter, payload, before, rev, fired, streak = tick
            if keep is None and (floor is None or t >= floor):
                keep, kept = Carry(run.fire, run.streak, run.counter), n
            moved, fires, now = run.step(t, risk, counter, rules)
            if rev is None or moved != before:
                tick[5], tick[6] = moved, 0 if rev is None else rev + 1
                yield i, t, "tick", tick[6], 1, moved, None, None, payload
            if fires != fired:
                tick[7] = fires
                yield i, t, "alert", 0, 1 if fires else -1, None, "MODERATE", None, None
            if now != streak:
                tick[8] = now
                for sign, length in ((-1, streak), (1, now)):
                    if length is not None:
                        yield i, t, "alert", 0, sign, None, "SUSTAINED_HIGH", length, None
        self.carry, self.ticks = keep, self.ticks[kept:]


def unpack(row) -> dict:
    """``{system: System.saved()}`` of a state row."""
    names, held, *rest = row
    systems, ticks = rest[:len(PER_SYSTEM)], rest[len(PER_SYSTEM):]
    out, at = {}, 0
    for name, n, *carry in zip(names, held, *systems, strict=True):
        out[name] = (*carry, *(x[at:at + n] for x in ticks))
        at += n
    return out


def pack(systems: dict) -> tuple:
    """The state row of ``{system: System.saved()}``."""
    columns = list(zip(*systems.values(), strict=True)) or [()] * (len(PER_SYSTEM) + len(PER_TICK))
    per_system, per_tick = columns[:len(PER_SYSTEM)], columns[len(PER_SYSTEM):]
    return (list(systems), [len(x) for x in per_tick[0]], *map(list, per_system),
            *([v for part in column for v in part] for column in per_tick))


def tick_changes(ticks: DataFrame, cooldown_s: float, streak_len: int, retain_s: float | None = RETAIN_S,
                 payload=None, t: R.Thresholds = R.DEFAULT, groups: int = GROUPS) -> DataFrame:
    """C2, T1, T2, repeats and late ticks of a stream of ``TICK`` rows, as rows of ``CHANGES``.

    ``payload`` is a string column that a tick carries through the state, for
    the sinks.  With ``retain_s`` None every tick is retained and none is late.
    The state of a system that falls silent stays (its retained ticks and the
    carry); a null system is a system of its own.  ``groups`` state rows hold
    all systems; it must not change under a checkpoint, and a deployment whose
    systems hold more than some MB a row starts with more.
    """
    import pandas as pd
    rules = {"cooldown": int(round(cooldown_s * US)), "length": streak_len, "moderate": t.band_moderate,
             "high": t.band_high, "retain": None if retain_s is None else int(round(retain_s * US))}
    names = [f.split()[0] for f in CHANGES.split(", ")]

    def nullable(values, kind):
        return [None if v is None or v != v else kind(v) for v in values]

    def step(key, frames, state):
        held = unpack(state.get) if state.exists else {}
        new: dict = {}
        for f in frames:
            for name, *tick in zip(nullable(f["system_id"], str), nullable(f["t"], int), nullable(f["id"], int),
                                   nullable(f["risk"], float), nullable(f["counter"], int),
                                   nullable(f["payload"], str), strict=True):
                new.setdefault(name, []).append(tuple(tick))
        rows = []
        for name, arrived in new.items():
            system = System(held.get(name))
            rows.extend((name, *row) for row in system.absorb(arrived, rules))
            held[name] = system.saved()
        state.update(pack(held))
        if rows:
            columns = list(zip(*rows, strict=True))
            kinds = ("object", "Int64", "Int64", "object", "Int32", "Int32", "Int64", "object", "Int64", "object")
            yield pd.DataFrame({n: pd.array(c, dtype=k) if k != "object" else pd.Series(c, dtype=object)
                                for n, c, k in zip(names, columns, kinds, strict=True)})

    counter = F.col("disk_write_bytes") if "disk_write_bytes" in ticks.columns else F.lit(None)
    # as text, since pandas turns a column of longs with nulls into doubles
    rows = ticks.select("system_id", F.col("id").cast("string").alias("id"), epoch_micros("ts").cast("string").alias("t"),
                        R.risk_score().alias("risk"), counter.cast("string").alias("counter"),
                        (F.lit(None).cast("string") if payload is None else payload).alias("payload"))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("system_id"), F.lit(groups)))
    return rows.groupBy("_group").applyInPandasWithState(step, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)
