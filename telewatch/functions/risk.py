"""Row-level risk scoring and classification (column expressions only).

Everything here is a Catalyst expression, so it stays inside whole-stage
codegen; nothing reaches Python at run time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """Cut points of the reference."""
    vote: float = 0.6          # stored level / vote / fault cut
    band_high: float = 0.7     # three-band level
    band_moderate: float = 0.4
    cpu_anomaly: float = 80.0  # row anomaly
    mem_anomaly: float = 85.0
    critical: float = 80.0     # failure window / recommendation, risk %
    warning: float = 60.0
    watch: float = 40.0
    health_critical: float = 50.0
    health_warning: float = 75.0


DEFAULT = Thresholds()

# Failure windows (R13), most urgent first.
WINDOW_24H = "Within 24 Hours"
WINDOW_1_3 = "1–3 Days"
WINDOW_3_7 = "3–7 Days"
WINDOW_7P = "7+ Days"

# Cause text by fault type.
CAUSES = {
    "CPU": "High CPU utilization and abnormal processing load.",
    "MEMORY": "Memory pressure and reduced available RAM.",
    "DISK": "High disk activity and write throughput.",
}
CAUSE_DEFAULT = "No significant anomaly detected."

# Recommendations (R15), most urgent first.
REC_CRITICAL = "Immediate maintenance recommended. Investigate system before failure."
REC_WARNING = "Schedule maintenance as soon as possible."
REC_WATCH = "Increase monitoring frequency."
REC_NONE = "Continue monitoring."

# F1 scores shown beside model votes (R19), as published.
MODEL_F1 = {
    "Random Forest": 98.62,
    "XGBoost": 98.81,
    "Isolation Forest": 87.61,
    "One-Class SVM": 87.12,
    "Compressed IF": 89.02,
    "LSTM ": 46.53,
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def risk_score(cpu="cpu_percent", mem="memory_percent") -> Column:
    """(0.4 * cpu + 0.6 * mem) / 100."""
    return (_c(cpu) * F.lit(0.4) + _c(mem) * F.lit(0.6)) / F.lit(100.0)


def vote(risk="risk_score", t: Thresholds = DEFAULT) -> Column:
    """R2: 1 when risk is above the vote cut."""
    return F.when(_c(risk) > t.vote, 1).otherwise(0)


def stored_level(risk="risk_score", t: Thresholds = DEFAULT) -> Column:
    """Level written to the predictions table."""
    return F.when(_c(risk) > t.vote, "HIGH").otherwise("NORMAL")


def stored_fault(risk="risk_score", t: Thresholds = DEFAULT) -> Column:
    """Fault written to the predictions table."""
    return F.when(_c(risk) > t.vote, "CPU").otherwise("NONE")


def band(risk="risk_score", t: Thresholds = DEFAULT) -> Column:
    """HIGH / MODERATE / NORMAL."""
    r = _c(risk)
    return (F.when(r >= t.band_high, "HIGH")
            .when(r >= t.band_moderate, "MODERATE")
            .otherwise("NORMAL"))


def state_label(risk="risk_score", t: Thresholds = DEFAULT) -> Column:
    """R4 as a training label: High / Moderate / Normal."""
    r = _c(risk)
    return (F.when(r >= t.band_high, "High")
            .when(r >= t.band_moderate, "Moderate")
            .otherwise("Normal"))


def severity(level="risk_level") -> Column:
    """WARNING for HIGH, else INFO."""
    return F.when(_c(level) == "HIGH", "WARNING").otherwise("INFO")


def health_percent(risk="risk_score", t: Thresholds = DEFAULT) -> Column:
    """Health shown beside the risk."""
    r = _c(risk)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.lit(1.0) - r) * F.lit(100.0)))
    return F.when(r >= t.band_high, F.round(clamped).cast("int")).otherwise(F.lit(100))


def health_status(health="health_percent", t: Thresholds = DEFAULT) -> Column:
    """Critical / Warning / Healthy."""
    h = _c(health)
    return (F.when(h < t.health_critical, "Critical")
            .when(h < t.health_warning, "Warning")
            .otherwise("Healthy"))


def is_anomaly(cpu="cpu_percent", mem="memory_percent", t: Thresholds = DEFAULT) -> Column:
    """Boolean row anomaly."""
    return (_c(cpu) > t.cpu_anomaly) | (_c(mem) > t.mem_anomaly)


def anomaly_label(cpu="cpu_percent", mem="memory_percent", t: Thresholds = DEFAULT) -> Column:
    return F.when(is_anomaly(cpu, mem, t), "Anomaly Detected").otherwise("Normal")


def row_fault(cpu="cpu_percent", mem="memory_percent", t: Thresholds = DEFAULT) -> Column:
    """CPU checked first, then memory."""
    return (F.when(_c(cpu) > t.cpu_anomaly, "CPU")
            .when(_c(mem) > t.mem_anomaly, "Memory")
            .otherwise("Normal"))


def row_severity(cpu="cpu_percent", mem="memory_percent", t: Thresholds = DEFAULT) -> Column:
    """HIGH / MEDIUM / LOW in the same order as R11."""
    return (F.when(_c(cpu) > t.cpu_anomaly, "HIGH")
            .when(_c(mem) > t.mem_anomaly, "MEDIUM")
            .otherwise("LOW"))


def risk_pct(risk="risk_score") -> Column:
    """Risk as a percentage."""
    return _c(risk) * F.lit(100.0)


def failure_window(pct="risk_pct", t: Thresholds = DEFAULT) -> Column:
    """Failure window from the risk percentage."""
    p = _c(pct)
    return (F.when(p >= t.critical, WINDOW_24H)
            .when(p >= t.warning, WINDOW_1_3)
            .when(p >= t.watch, WINDOW_3_7)
            .otherwise(WINDOW_7P))


def cause_text(fault="fault_type") -> Column:
    """Cause text; unknown fault types get the default."""
    f = _c(fault)
    expr = None
    for key, text in CAUSES.items():
        expr = F.when(f == key, text) if expr is None else expr.when(f == key, text)
    return expr.otherwise(CAUSE_DEFAULT)


def recommendation(pct="risk_pct", t: Thresholds = DEFAULT) -> Column:
    """Recommendation text."""
    p = _c(pct)
    return (F.when(p >= t.critical, REC_CRITICAL)
            .when(p >= t.warning, REC_WARNING)
            .when(p >= t.watch, REC_WATCH)
            .otherwise(REC_NONE))


def warning_flag(pct="risk_pct", t: Thresholds = DEFAULT) -> Column:
    """Banner shown at the warning threshold."""
    return _c(pct) >= t.warning


def models_json(vote_col="vote", model="xgboost") -> Column:
    """Vote map as JSON text."""
    return F.to_json(F.create_map(F.lit(model), _c(vote_col).cast("int")))


def probabilities_json(risk="risk_score", model="xgboost") -> Column:
    """Probability map as JSON text, at full precision."""
    r = _c(risk)
    return F.to_json(F.create_map(F.lit(model), r, F.lit("normal"), F.lit(1.0) - r))
