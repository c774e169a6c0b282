"""Registered alert queries (T1-T5, T7, C18) and the alert serving queries (Q3, Q9).

Ticks per system are hours apart in the driver data, so the cooldowns and
the streak length are scaled to it: moderate cooldown 86,400 s, high gap
21,600 s, streak 3 samples, thinning interval 21,600 s.
"""

from __future__ import annotations

import uuid

from ..functions import risk as R
from ..operators import alerts as A
from ..operators import serving as Q
from ..session import scratch_table_dir
from ..sources import readings as RD
from ..sources.files import exists
from ..sources.tables import TELEMETRY_CTE, telemetry
from .registry import register

COOLDOWN_S = 86400
HIGH_GAP_S = 21600
STREAK = 3
THIN_S = 21600

SCORED_CTE = """scored AS (
  SELECT *, (cpu_percent * 0.4 + memory_percent * 0.6) / 100.0 AS risk_score FROM telemetry)"""

RESOLVED_CTE = """resolved AS (
  SELECT *, min(CASE WHEN risk_score < 0.4 THEN ts END) OVER (
           PARTITION BY system_id ORDER BY ts, id
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS resolved_at
  FROM scored)"""


def scored(spark, sf_dir):
    return telemetry(spark, sf_dir).withColumn("risk_score", R.risk_score())


def cooldown_sql(src: str, key: str, where: str, gap_us: str, strict: bool, name: str) -> list[str]:
    """Recursive-CTE fold: CTE ``{name}`` lists (key, id) of the rows that fire."""
    op = ">" if strict else ">="
    return [
        f"""{name}_c AS (
  SELECT {key} AS k, id, epoch_us(ts) AS t, {gap_us} AS g,
         row_number() OVER (PARTITION BY {key} ORDER BY ts, id) AS rn
  FROM {src} WHERE {where})""",
        f"""{name}_f(k, rn, last_fire, fired) AS (
  SELECT k, rn, t, true FROM {name}_c WHERE rn = 1
  UNION ALL
  SELECT c.k, c.rn, CASE WHEN c.t - f.last_fire {op} c.g THEN c.t ELSE f.last_fire END,
         c.t - f.last_fire {op} c.g
  FROM {name}_f f JOIN {name}_c c ON c.k = f.k AND c.rn = f.rn + 1)""",
        f"""{name} AS (
  SELECT c.k, c.id FROM {name}_f f JOIN {name}_c c ON c.k = f.k AND c.rn = f.rn
  WHERE f.fired)""",
    ]


def _rec(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


MOD_BAND = "risk_score >= 0.4 AND risk_score < 0.7"


def t1(spark, sf_dir):
    return A.moderate_cooldown(scored(spark, sf_dir), COOLDOWN_S).select("system_id", "id", "ts")


T1_SQL = _rec(TELEMETRY_CTE, SCORED_CTE,
              *cooldown_sql("scored", "system_id", MOD_BAND, f"{COOLDOWN_S}000000", True, "fires")) + """
SELECT s.system_id, s.id, s.ts FROM scored s JOIN fires f ON s.system_id = f.k AND s.id = f.id"""

register("t1_moderate_cooldown", "T1", T1_SQL)(t1)


def t2(spark, sf_dir):
    return A.sustained_high(scored(spark, sf_dir), STREAK).select("system_id", "id", "ts", "streak")


STREAK_CTE = f"""streaks AS (
  SELECT system_id, id, ts, streak FROM (
    SELECT *, rn - coalesce(max(CASE WHEN NOT high THEN rn END) OVER (
             PARTITION BY system_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING), 0) AS streak
    FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY ts, id) AS rn,
                 risk_score >= 0.7 AS high FROM scored) x) y
  WHERE high AND streak % {STREAK} = 0)"""

T2_SQL = "WITH " + ",\n".join([TELEMETRY_CTE, SCORED_CTE, STREAK_CTE]) + "\nSELECT * FROM streaks"

register("t2_sustained_high", "T2", T2_SQL)(t2)


def t3(spark, sf_dir):
    fires = A.sustained_high(scored(spark, sf_dir), STREAK)
    return A.burst(fires).select("system_id", "id", "notice", "notice_ts")


T3_SQL = "WITH " + ",\n".join([TELEMETRY_CTE, SCORED_CTE, STREAK_CTE]) + """
SELECT system_id, id, CAST(n AS INTEGER) AS notice, ts + to_seconds(2 * (n - 1)) AS notice_ts
FROM streaks, (SELECT unnest(range(1, 4)) AS n) r"""

register("t3_high_burst", "T3 T2", T3_SQL)(t3)


def t4(spark, sf_dir):
    return A.two_band_cooldown(scored(spark, sf_dir), HIGH_GAP_S, COOLDOWN_S).select(
        "system_id", "id", "ts", "toast")


T4_SQL = _rec(TELEMETRY_CTE, SCORED_CTE,
              *cooldown_sql("scored", "system_id", "risk_score >= 0.4",
                            f"CASE WHEN risk_score >= 0.7 THEN {HIGH_GAP_S}000000 "
                            f"ELSE {COOLDOWN_S}000000 END", True, "fires")) + """
SELECT s.system_id, s.id, s.ts,
       CASE WHEN s.risk_score >= 0.7 THEN 'HIGH' ELSE 'MODERATE' END AS toast
FROM scored s JOIN fires f ON s.system_id = f.k AND s.id = f.id"""

register("t4_two_band_cooldown", "T4 L8", T4_SQL)(t4)


def t5(spark, sf_dir):
    b = A.banner_changes(scored(spark, sf_dir))
    return b.filter("changed").select("system_id", "id", "ts", "banner")


T5_SQL = "WITH " + ",\n".join([TELEMETRY_CTE, SCORED_CTE]) + """
SELECT system_id, id, ts, banner FROM (
  SELECT *, risk_score >= 0.7 AS banner,
         lag(risk_score >= 0.7) OVER (PARTITION BY system_id ORDER BY ts, id) AS prev
  FROM scored) x
WHERE prev IS NULL OR prev <> banner"""

register("t5_banner_changes", "T5", T5_SQL)(t5)


def c18(spark, sf_dir):
    s = RD.sessions(spark, sf_dir)
    return A.thin_min_gap(s, THIN_S, key="session_id").select("session_id", "id", "ts")


C18_SQL = _rec(TELEMETRY_CTE, RD.SESSIONS_CTE,
               *cooldown_sql("sessions", "session_id", "true", f"{THIN_S}000000", False, "kept")) + """
SELECT s.session_id, s.id, s.ts FROM sessions s JOIN kept k ON s.session_id = k.k AND s.id = k.id"""

register("c18_min_gap_thinning", "C18", C18_SQL)(c18)


def alert_rows(spark, sf_dir):
    return A.alert_table(scored(spark, sf_dir), COOLDOWN_S, STREAK)


ALERTS_CTES = [TELEMETRY_CTE, SCORED_CTE, RESOLVED_CTE,
               *cooldown_sql("resolved", "system_id", MOD_BAND, f"{COOLDOWN_S}000000", True,
                             "fires"),
               STREAK_CTE.replace("FROM scored", "FROM resolved").replace(
                   "SELECT system_id, id, ts, streak FROM", "SELECT system_id, id, ts, streak, resolved_at FROM"),
               """alerts AS (
  SELECT r.id, r.ts, r.system_id, 'Moderate Risk Detected' AS alert_type, 'MEDIUM' AS severity,
         'CPU' AS fault_type, r.resolved_at
  FROM resolved r JOIN fires f ON r.system_id = f.k AND r.id = f.id
  UNION ALL
  SELECT id, ts, system_id, 'CRITICAL SYSTEM RISK', 'CRITICAL', 'CPU', resolved_at FROM streaks)"""]

register("t7_alert_table", "T7 T1 T2", _rec(*ALERTS_CTES) + "SELECT * FROM alerts")(alert_rows)


_STORED: dict[tuple[str, str], str] = {}


def stored_alerts(spark, sf_dir):
    """The alert table of ``sf_dir``, written once per application by T7 and read
    by the queries over it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED or not exists(spark, _STORED[key]):
        path = scratch_table_dir(spark, f"alerts-{uuid.uuid4().hex}")
        A.write_alerts(alert_rows(spark, sf_dir), path)
        _STORED[key] = path
    return A.read_alerts(spark, _STORED[key])


def newest_alerts(spark, sf_dir):
    return Q.newest(stored_alerts(spark, sf_dir), 20)


register("q3_newest_alerts", "Q3 T7",
         _rec(*ALERTS_CTES) + "SELECT * FROM alerts ORDER BY ts DESC, id DESC LIMIT 20")(newest_alerts)


def active_alerts(spark, sf_dir):
    return Q.alert_status(stored_alerts(spark, sf_dir), drop_resolved=True)


register("q9_active_alerts", "Q9 T7",
         _rec(*ALERTS_CTES) + "SELECT *, 'Active' AS status FROM alerts WHERE resolved_at IS NULL")(
    active_alerts)

