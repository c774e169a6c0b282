"""Registered calibration queries (B1-B5) over lineitem measures per supplier.

The telemetry view's available memory is a linear function of its memory
percent, so its covariance is singular by construction; calibration runs on
four independent lineitem measures instead, one "system" per supplier.
Statistics are compared at 9 significant digits and the inverse at 6, since
the two engines accumulate co-moments in different orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate as B
from ..sources.tables import read_table
from .registry import register


def sig(col, digits: int):
    return F.format_string(f"%.{digits - 1}e", col).cast("double")


def sig_sql(expr: str, digits: int) -> str:
    return f"CAST(printf('%.{digits - 1}e', {expr}) AS DOUBLE)"


def measures(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("SUPP-"), F.col("l_suppkey").cast("string")).alias("system_id"),
        (F.col("l_quantity") * 2.0).alias("cpu_percent"),
        (F.col("l_discount") * 1000.0).alias("memory_percent"),
        F.col("l_extendedprice").alias("memory_available_mb"),
        (F.col("l_tax") * 100.0).alias("disk_write_mbps"))


MEASURES_CTE = """m AS (
  SELECT 'SUPP-' || CAST(l_suppkey AS VARCHAR) AS system_id,
         l_quantity * 2.0 AS cpu_percent, l_discount * 1000.0 AS memory_percent,
         l_extendedprice AS memory_available_mb, l_tax * 100.0 AS disk_write_mbps
  FROM lineitem)"""

STAT_COLS = [f"{s}_{k}" for s in ("cpu", "mem", "avail", "disk") for k in ("mean", "std")]


def calibration(spark, sf_dir):
    c = B.calibrate(measures(spark, sf_dir))
    cov = [c_ for c_ in c.columns if c_.startswith("cov_") and c_ != "cov_det"]
    inv = [name for _, _, name in B.inverse_names()]
    return c.select("system_id", "samples", "status",
                    *[sig(F.col(x), 9).alias(x) for x in STAT_COLS + cov],
                    *[sig(F.col(x), 6).alias(x) for x in inv])


def _calibration_sql() -> str:
    cols = ["cpu_percent", "memory_percent", "memory_available_mb", "disk_write_mbps"]
    short = B.SHORT
    aggs = ["count(*) AS samples"]
    for c in cols:
        aggs.append(f"avg({c}) AS {short[c]}_mean")
        aggs.append(f"stddev_samp({c}) AS {short[c]}_std")
    covs = []
    for a in range(4):
        for b in range(a, 4):
            name = f"cov_{short[cols[a]]}_{short[cols[b]]}"
            covs.append(name)
            fn = f"var_samp({cols[a]})" if a == b else f"covar_samp({cols[a]}, {cols[b]})"
            aggs.append(f"{fn} AS {name}")
    det = B.determinant_sql()
    status = (f"CASE WHEN samples < 30 THEN 'Collect at least 30 samples before calibration. "
              f"Currently have ' || CAST(samples AS VARCHAR) || '.' "
              f"WHEN {det} IS NULL OR {det} = 0 THEN 'singular' ELSE 'calibrated' END")
    outs = ["system_id", "samples", f"{status} AS status"]
    outs += [f"CASE WHEN samples >= 30 THEN {sig_sql(x, 9)} END AS {x}" for x in STAT_COLS + covs]
    inv = [f"CASE WHEN ({status}) = 'calibrated' THEN {sig_sql(B.inverse_sql(i, j), 6)} END AS {n}"
           for i, j, n in B.inverse_names()]
    return (f"WITH {MEASURES_CTE}, s AS (SELECT system_id, {', '.join(aggs)} FROM m GROUP BY system_id)\n"
            f"SELECT {', '.join(outs + inv)} FROM s")


register("b_calibration", "B1 B2 B3 B4 S4", _calibration_sql())(calibration)


def calibration_record(spark, sf_dir):
    r = B.result_record(B.calibrate(measures(spark, sf_dir)))
    return r.select("system_id", "samples_used", "status",
                    *[sig(F.col(x), 9).alias(x) for x in ("cpu_mean", "cpu_std", "mem_mean", "mem_std")])


CAL_RECORD_SQL = f"""WITH {MEASURES_CTE}
SELECT system_id, count(*) AS samples_used,
       CASE WHEN count(*) < 30 THEN 'Collect at least 30 samples before calibration. Currently have '
            || CAST(count(*) AS VARCHAR) || '.' ELSE 'calibrated' END AS status,
       CASE WHEN count(*) >= 30 THEN {sig_sql("avg(cpu_percent)", 9)} END AS cpu_mean,
       CASE WHEN count(*) >= 30 THEN {sig_sql("stddev_samp(cpu_percent)", 9)} END AS cpu_std,
       CASE WHEN count(*) >= 30 THEN {sig_sql("avg(memory_percent)", 9)} END AS mem_mean,
       CASE WHEN count(*) >= 30 THEN {sig_sql("stddev_samp(memory_percent)", 9)} END AS mem_std
FROM m GROUP BY system_id"""

register("b5_calibration_record", "B5 B1 B2", CAL_RECORD_SQL)(calibration_record)
