"""Alert decisions in batch (T1-T5, T7) and minimum-gap thinning.

Cooldown alerts depend on the time of the last *fire*, not the last row, so
no plain window expresses them.  The fold works on the segments of
``operators.ordered`` (bounded ranges of rows along key and time), written once:

1. For a key that spans segments, each segment becomes a step function from
   the last fire before it to the last fire in it: next-fire pointers by
   binary search, exits by one pass from the last row back.
2. The few steps of such a key are composed in segment order, which gives
   every segment the last fire before it.
3. Each segment marks its fires by following the pointers from there.

No key is ever held in one task, and the number of written tables and
shuffles does not depend on the length of the chains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import risk as R
from ..functions.timefn import epoch_micros
from .ordered import SEG, TIE, materialize, ordered_scan, segments

US = 1_000_000

# Alert rows written by T7 (type, severity, fault).
MODERATE_ALERT = ("Moderate Risk Detected", "MEDIUM", "CPU")
HIGH_ALERT = ("CRITICAL SYSTEM RISK", "CRITICAL", "CPU")


def _micros(ts: str = "ts") -> Column:
    return epoch_micros(ts)


def _gap_classes(gaps) -> list[tuple[Column, int]]:
    """Normalise ``gaps`` to [(condition, gap in microseconds)], first match wins."""
    if isinstance(gaps, (int, float)):
        return [(F.lit(True), int(round(gaps * US)))]
    return [(cond, int(round(g * US))) for cond, g in gaps]


def _runs(pdf, key: str):
    """Row ranges of equal keys in a frame sorted by (key, time, id)."""
    import numpy as np
    codes = pdf[key].factorize(use_na_sentinel=False)[0]
    cut = np.flatnonzero(np.diff(codes)) + 1
    return zip(np.r_[0, cut], np.r_[cut, len(codes)], strict=True) if len(codes) else ()


def _next_fires(t, cls, gaps: list[int], side: str):
    """For every candidate of a run the position of the first later one that
    would fire if it fired (``len(t)`` when none in the run)."""
    import numpy as np
    n = len(t)
    here = np.arange(n)
    best = np.full(n, n)
    for c, gap in enumerate(gaps):
        pos = np.flatnonzero(cls == c)
        if len(pos):
            at = np.searchsorted(t[pos], t + gap, side=side)
            at = np.maximum(at, np.searchsorted(pos, here, side="right"))
            best = np.minimum(best, np.append(pos, n)[at])
    return best


def _entry_steps(t, cls, gaps: list[int], strict: bool, nxt):
    """The run as a step function of the last fire before it.

    The first candidate that fires after a fire at ``t0`` is the first with
    ``t - gap`` beyond ``t0``, so only record highs of ``t - gap`` matter, up
    to the first that fires whatever the entry was.  Steps with the same exit
    (the last fire of the chain they start) are one.  Returns (bounds, exits).
    """
    import numpy as np
    exit_time = t.tolist()
    jump = nxt.tolist()
    for i in range(len(t) - 1, -1, -1):            # from the last row back
        if jump[i] < len(t):
            exit_time[i] = exit_time[jump[i]]
    bound = t - np.asarray(gaps)[cls]
    high = np.maximum.accumulate(bound)
    record = np.r_[True, bound[1:] > high[:-1]]
    always = (bound > t[0]) if strict else (bound >= t[0])
    if always.any():
        record[int(np.argmax(always)) + 1:] = False
    rows = np.flatnonzero(record).tolist()
    bounds, exits = [], []
    for i in rows:
        if exits and exits[-1] == exit_time[i]:
            bounds[-1] = int(bound[i])
        else:
            bounds.append(int(bound[i]))
            exits.append(int(exit_time[i]))
    return bounds, exits


def _fold_segments(cand: DataFrame, key: str, gaps: list[int], strict: bool) -> DataFrame:
    """``(key, _id)`` of the candidates that fire; see the module docstring."""
    import numpy as np
    import pandas as pd
    side = "right" if strict else "left"
    sort = [key, "_t", "_id", TIE]
    laid = segments(cand, [key], ["_t", "_id"])
    kind = laid.schema[key].dataType.simpleString()

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(sort, na_position="first", kind="stable")
        t, cls, out = pdf["_t"].to_numpy(), pdf["_cls"].to_numpy(), []
        for a, b in _runs(pdf, key):
            nxt = _next_fires(t[a:b], cls[a:b], gaps, side)
            out.append((pdf[key].iloc[a], pdf[SEG].iloc[a],
                        *_entry_steps(t[a:b], cls[a:b], gaps, strict, nxt)))
        return pd.DataFrame(out, columns=[key, SEG, "bounds", "exits"])

    # only keys that span segments need an entry time: two per segment boundary at most
    several = (laid.groupBy(key).agg(F.min(SEG).alias("_lo"), F.max(SEG).alias("_hi"))
               .where(F.col("_lo") < F.col("_hi")).select(F.col(key).alias("_k")))
    spans = laid.join(several, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    steps = spans.groupBy(SEG).applyInPandas(
        summarise, f"{key} {kind}, {SEG} int, bounds array<long>, exits array<long>")

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        last, entry = None, []
        pdf = pdf.sort_values(SEG)
        for bounds, exits in zip(pdf["bounds"], pdf["exits"], strict=True):
            entry.append(last)
            i = 0 if last is None else int(np.searchsorted(bounds, last, side=side))
            if i < len(exits):
                last = int(exits[i])
        return pd.DataFrame({key: pdf[key], SEG: pdf[SEG], "_entry": pd.array(entry, "Int64")})

    entries = materialize(steps.groupBy(key).applyInPandas(
        compose, f"{key} {kind}, {SEG} int, _entry long")).select(
        F.col(key).alias("_k"), F.col(SEG).alias("_s"), "_entry")
    entered = laid.join(entries, F.col(key).eqNullSafe(F.col("_k")) & (F.col(SEG) == F.col("_s")), "left")

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(sort, na_position="first", kind="stable")
        t, cls = pdf["_t"].to_numpy(), pdf["_cls"].to_numpy()
        entry = pdf["_entry"]
        fires = []
        for a, b in _runs(pdf, key):
            run, kinds = t[a:b], cls[a:b]
            nxt = _next_fires(run, kinds, gaps, side).tolist()
            i = 0
            if not pd.isna(entry.iloc[a]):
                bound = run - np.asarray(gaps)[kinds]
                ok = bound > entry.iloc[a] if strict else bound >= entry.iloc[a]
                i = int(np.argmax(ok)) if ok.any() else b - a
            while i < b - a:
                fires.append(a + i)
                i = nxt[i]
        return pdf.iloc[fires][[key, "_id"]]

    columns = [key, "_t", "_id", "_cls", SEG, TIE, "_entry"]
    return entered.select(*columns).groupBy(SEG).applyInPandas(mark, f"{key} {kind}, _id long")


def cooldown_fires(df: DataFrame, key: str, candidate: Column, gaps, *,
                   strict: bool = True, id_col: str = "id", ts: str = "ts") -> DataFrame:
    """Rows of ``df`` that fire under a cooldown measured from the last fire.

    ``candidate``  rows that may fire (others neither fire nor reset the clock);
    ``gaps``       seconds, or [(condition, seconds), ...] gap classes (first
                   match wins); a row fires when its time minus the last fire
                   time is ``> gap`` (``>= gap`` when not strict).
    The first candidate of every key fires; a null key is a key of its own, a
    row without a time never fires.  ``(key, id_col)`` must be unique.
    """
    classes = _gap_classes(gaps)
    cls = None
    for c, (cond, _) in enumerate(classes):
        cls = F.when(cond, F.lit(c)) if cls is None else cls.when(cond, F.lit(c))
    cand = (df.filter(candidate & F.col(ts).isNotNull())
            .select(key, F.col(id_col).cast("long").alias("_id"), _micros(ts).alias("_t"),
                    cls.otherwise(F.lit(len(classes) - 1)).alias("_cls")))
    fires = _fold_segments(cand, key, [g for _, g in classes], strict).select(
        F.col(key).alias("_k"), "_id")
    return df.join(fires, F.col(key).eqNullSafe(F.col("_k")) & (F.col(id_col) == F.col("_id")), "left_semi")


def moderate_cooldown(df: DataFrame, cooldown_s: float = 300.0, key: str = "system_id",
                      t: R.Thresholds = R.DEFAULT) -> DataFrame:
    """Moderate band fires when more than ``cooldown_s`` since the last fire."""
    risk = F.col("risk_score")
    band = (risk >= t.band_moderate) & (risk < t.band_high)
    return cooldown_fires(df, key, band, cooldown_s, strict=True)


def two_band_cooldown(df: DataFrame, high_gap_s: float = 30.0, moderate_gap_s: float = 300.0,
                      key: str = "system_id", t: R.Thresholds = R.DEFAULT) -> DataFrame:
    """T4: high and moderate toasts share one clock, each with its own gap."""
    risk = F.col("risk_score")
    gaps = [(risk >= t.band_high, high_gap_s), (F.lit(True), moderate_gap_s)]
    fires = cooldown_fires(df, key, risk >= t.band_moderate, gaps, strict=True)
    return fires.withColumn("toast", F.when(risk >= t.band_high, "HIGH").otherwise("MODERATE"))


def thin_min_gap(df: DataFrame, interval_s: float, key: str = "session_id") -> DataFrame:
    """Keep a row only if at least ``interval_s`` passed since the last kept row."""
    return cooldown_fires(df, key, F.lit(True), interval_s, strict=False)


def sustained_high(df: DataFrame, length: int = 30, key: str = "system_id",
                   t: R.Thresholds = R.DEFAULT) -> DataFrame:
    """Every ``length``-th consecutive high sample fires; any other resets
    (also one without a score)."""
    high = _is_high(t)
    s = ordered_scan(df, [key], ["ts", "id"], row_number="_rn",
                     last_position={"_last_low": ~high})
    return _streak_fires(s, length, t)


def _is_high(t: R.Thresholds) -> Column:
    return F.coalesce(F.col("risk_score") >= t.band_high, F.lit(False))   # no score: not high


def _streak_fires(scanned: DataFrame, length: int, t: R.Thresholds) -> DataFrame:
    """T2 on rows that carry their position and that of the last row that was not high."""
    streak = F.col("_rn") - F.coalesce(F.col("_last_low"), F.lit(0))
    return (scanned.withColumn("streak", streak)
            .filter(_is_high(t) & (F.col("streak") % F.lit(length) == 0))
            .drop("_rn", "_last_low"))


def burst(fires: DataFrame, count: int = 3, spacing_s: int = 2) -> DataFrame:
    """Each fire becomes ``count`` notices ``spacing_s`` seconds apart."""
    return (fires.withColumn("notice", F.explode(F.sequence(F.lit(1), F.lit(count))))
            .withColumn("notice_ts", F.col("ts") + F.make_dt_interval(
                secs=((F.col("notice") - 1) * spacing_s).cast("decimal(18,6)"))))


def banner_changes(df: DataFrame, key: str = "system_id",
                   t: R.Thresholds = R.DEFAULT) -> DataFrame:
    """T5: banner on at high risk; rows where it switches on or off."""
    on = F.col("risk_score") >= t.band_high
    s = ordered_scan(df.withColumn("banner", on), [key], ["ts", "id"],
                     lags={"_prev_banner": "banner"})
    changed = F.col("_prev_banner").isNull() | (F.col("_prev_banner") != F.col("banner"))
    return s.withColumn("changed", changed).drop("_prev_banner")


def with_resolution(df: DataFrame, key: str = "system_id",
                    t: R.Thresholds = R.DEFAULT) -> DataFrame:
    """Adds ``resolved_at``: the first sample at or after each row back in NORMAL band."""
    return ordered_scan(df, [key], ["ts", "id"], next_min={"resolved_at": _normal_time(t)})


def _normal_time(t: R.Thresholds) -> Column:
    return F.when(F.col("risk_score") < t.band_moderate, F.col("ts"))


def alert_table(scored: DataFrame, cooldown_s: float = 300.0, streak: int = 30,
                key: str = "system_id", t: R.Thresholds = R.DEFAULT) -> DataFrame:
    """Alerts from T1 and T2, with the time each condition cleared.

    One ordered scan gives both streaks and resolution times; what can become
    an alert (the moderate band and the streaks) is written once.
    """
    scan = ordered_scan(scored.select("id", "ts", key, "risk_score"), [key], ["ts", "id"], row_number="_rn",
                        last_position={"_last_low": ~_is_high(t)}, next_min={"resolved_at": _normal_time(t)})
    risk = F.col("risk_score")
    scan = materialize(scan.filter(risk >= t.band_moderate))
    moderate = moderate_cooldown(scan, cooldown_s, key, t)
    high = _streak_fires(scan, streak, t)

    def shape(frame: DataFrame, spec) -> DataFrame:
        kind, sev, fault = spec
        return frame.select("id", "ts", key, F.lit(kind).alias("alert_type"),
                            F.lit(sev).alias("severity"), F.lit(fault).alias("fault_type"),
                            "resolved_at")
    return shape(moderate, MODERATE_ALERT).unionByName(shape(high, HIGH_ALERT))



def write_alerts(alerts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The alert table, one folder per day, for the queries that read it."""
    (alerts.withColumn("dt", F.to_date("ts")).repartition("dt").sortWithinPartitions("ts", "id")
     .write.mode(mode).partitionBy("dt").parquet(path))


def read_alerts(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("dt")
