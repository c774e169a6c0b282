"""Per-system baseline calibration.

One grouped aggregate computes count, means, sample standard deviations and
the ten distinct entries of the 4x4 sample covariance (pairwise-complete, as
``covar_samp`` skips pairs with a null).  All of these aggregate partially
before the shuffle, so a system with billions of samples costs one buffer
per map task.  The inverse covariance is a closed-form cofactor expression
over those ten columns: no Python, no collect, one row per system.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CALIBRATION_COLUMNS

MIN_SAMPLES = 30
SHORT = {"cpu_percent": "cpu", "memory_percent": "mem",
         "memory_available_mb": "avail", "disk_write_mbps": "disk"}


def _cov_name(a: str, b: str) -> str:
    i, j = sorted((CALIBRATION_COLUMNS.index(a), CALIBRATION_COLUMNS.index(b)))
    return f"cov_{SHORT[CALIBRATION_COLUMNS[i]]}_{SHORT[CALIBRATION_COLUMNS[j]]}"


def _entry(i: int, j: int) -> str:
    return _cov_name(CALIBRATION_COLUMNS[i], CALIBRATION_COLUMNS[j])


def _det(rows: list[int], cols: list[int]) -> str:
    """Leibniz expansion of the minor on (rows, cols) as an SQL expression."""
    terms = []
    for perm in permutations(range(len(rows))):
        inversions = sum(1 for a in range(len(perm)) for b in range(a + 1, len(perm))
                         if perm[a] > perm[b])
        sign = "-" if inversions % 2 else "+"
        prod = " * ".join(_entry(rows[k], cols[perm[k]]) for k in range(len(rows)))
        terms.append(f"{sign} ({prod})")
    body = " ".join(terms)
    return "(" + (body[2:] if body.startswith("+ ") else "0 " + body) + ")"


def determinant_sql() -> str:
    return _det([0, 1, 2, 3], [0, 1, 2, 3])


def inverse_sql(i: int, j: int, det: str | None = None) -> str:
    """(i, j) entry of the inverse: cofactor(j, i) / det.

    ``det`` names a column already holding the determinant; by default the
    determinant expression is written out.
    """
    rows = [r for r in range(4) if r != j]
    cols = [c for c in range(4) if c != i]
    sign = "-" if (i + j) % 2 else ""
    return f"({sign}{_det(rows, cols)} / {det or determinant_sql()})"


def inverse_names() -> list[tuple[int, int, str]]:
    out = []
    for i in range(4):
        for j in range(i, 4):
            a, b = SHORT[CALIBRATION_COLUMNS[i]], SHORT[CALIBRATION_COLUMNS[j]]
            out.append((i, j, f"inv_{a}_{b}"))
    return out


def baseline_stats(df: DataFrame, key: str = "system_id") -> DataFrame:
    """B2 + B3: count, means, sample stds and covariances per system."""
    cols = CALIBRATION_COLUMNS
    aggs = [F.count(F.lit(1)).alias("samples")]
    for c in cols:
        aggs.append(F.avg(c).alias(f"{SHORT[c]}_mean"))
        aggs.append(F.stddev_samp(c).alias(f"{SHORT[c]}_std"))
    for a in range(4):
        for b in range(a, 4):
            x, y = cols[a], cols[b]
            expr = F.var_samp(x) if a == b else F.covar_samp(x, y)
            aggs.append(expr.alias(_cov_name(x, y)))
    return df.groupBy(key).agg(*aggs)


def calibrate(df: DataFrame, key: str = "system_id", min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Statistics, inverse covariance and a status per system.

    Systems under ``min_samples`` keep their count and get the reference's
    message as status with null statistics; a singular covariance gets status
    ``singular`` and a null inverse.
    """
    stats = baseline_stats(df, key)
    det = F.expr(determinant_sql())
    enough = F.col("samples") >= min_samples
    status = (F.when(~enough, F.concat(
        F.lit("Collect at least 30 samples before calibration. Currently have "),
        F.col("samples").cast("string"), F.lit(".")))
        .when(det.isNull() | (det == 0), F.lit("singular"))
        .otherwise(F.lit("calibrated")))
    stat_cols = [c for c in stats.columns if c not in (key, "samples")]
    out = stats.select(key, "samples", det.alias("cov_det"), status.alias("status"),
                       *[F.when(enough, F.col(c)).alias(c) for c in stat_cols])
    inv = [F.when(F.col("status") == "calibrated", F.expr(inverse_sql(i, j, "cov_det"))).alias(name)
           for i, j, name in inverse_names()]
    return out.select("*", *inv)


def result_record(calibrated: DataFrame, key: str = "system_id") -> DataFrame:
    """The response record: samples used, cpu / memory mean and std, status."""
    return calibrated.select(key, F.col("samples").alias("samples_used"), "cpu_mean", "cpu_std",
                             "mem_mean", "mem_std", "status")


def matrices(calibrated: DataFrame, key: str = "system_id") -> DataFrame:
    """S14 shape: covariance and inverse as 4x4 array-of-array columns."""
    def mat(prefix: str, namer) -> F.Column:
        rows = []
        for i in range(4):
            rows.append(F.array(*[F.col(namer(prefix, i, j)) for j in range(4)]))
        return F.array(*rows)

    def cov_name(_, i, j):
        return _entry(i, j)

    def inv_name(_, i, j):
        a, b = sorted((i, j))
        return f"inv_{SHORT[CALIBRATION_COLUMNS[a]]}_{SHORT[CALIBRATION_COLUMNS[b]]}"

    return calibrated.select(key, "samples", "status",
                             *[c for c in calibrated.columns if c.endswith(("_mean", "_std"))],
                             mat("cov", cov_name).alias("covariance"),
                             mat("inv", inv_name).alias("inverse_covariance"))
