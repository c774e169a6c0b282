"""Skew-safe ordered scans per key (row number, lag, running sum, running max).

A plain ``Window.partitionBy(system_id).orderBy(ts)`` sends every row of a key
to one task, so a host holding a third of the data would run on one core.
Here the rows are range-partitioned by (keys, order) into segments of about
``rows_per_segment`` rows and written once, with the segment number as a
column.  A key spans as many consecutive segments as it needs, whatever its
rows look like in time (bursts, gaps, equal timestamps), and several small
keys share one.  Each segment is scanned with an ordinary window on
``(keys, segment)``; a summary of one row per (key, segment) carries counts,
last values and running maxima across segment boundaries and is joined back.

The input is evaluated once: it is written as it comes, counted from the
written files, and only what exceeds one segment is laid out again by range.
The scans are the same at every size, and a written segment never changes, so
every branch of the plan (and every task retry after an executor loss) agrees
on it.  Null keys are a key of their own, as in a plain window.  The summary
has about ``rows / rows_per_segment + keys`` rows; adaptive execution
broadcasts it when its runtime size is under the broadcast threshold.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEG = "_seg"
TIE = "_tie"
ROWS_PER_SEGMENT_CONF = "telewatch.ordered.rowsPerSegment"
DEFAULT_ROWS_PER_SEGMENT = 2_000_000


def _col(expr: str | Column) -> Column:
    return expr if isinstance(expr, Column) else F.col(expr)


def rows_per_segment(df: DataFrame) -> int:
    conf = df.sparkSession.conf.get(ROWS_PER_SEGMENT_CONF, None)
    return int(conf) if conf else DEFAULT_ROWS_PER_SEGMENT


def segments(df: DataFrame, keys: Sequence[str], order: Sequence[str],
             per_segment: int | None = None) -> DataFrame:
    """``df`` written in segments of about ``per_segment`` rows along (keys, order).

    Adds the segment number and a tie-breaker (input position), which also
    splits runs of rows that are equal in every order column.
    """
    per_segment = per_segment or rows_per_segment(df)
    tied = materialize(df.withColumn(TIE, F.monotonically_increasing_id()))
    parts = -(-tied.count() // per_segment)                # row counts of the written files
    if parts <= 1:
        return tied.withColumn(SEG, F.lit(0))
    laid = tied.repartitionByRange(parts, *keys, *order, TIE)
    return materialize(laid.withColumn(SEG, F.spark_partition_id()))


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
                 row_number: str | None = None,
                 lags: dict[str, str] | None = None,
                 running_sums: dict[str, str | Column] | None = None,
                 running_max: dict[str, str | Column] | None = None,
                 last_position: dict[str, Column] | None = None,
                 next_min: dict[str, str | Column] | None = None,
                 key_count: str | None = None,
                 per_segment: int | None = None) -> DataFrame:
    """Add per-key ordered columns without putting a whole key in one task.

    ``row_number``   name of a 1-based position column within the key.
    ``lags``         {output: input} previous row's value within the key.
    ``running_sums`` {output: expression} inclusive running sum, null until the
                     first value that is not null (exact for integral inputs;
                     floating sums may differ in the last bit).
    ``running_max``  {output: expression} inclusive running max, nulls skipped.
    ``last_position`` {output: condition} 1-based position (as in
                     ``row_number``) of the latest row so far where the
                     condition held; null when it never held.  This is the
                     gaps-and-islands primitive.
    ``next_min``     {output: expression} smallest value on this row or a later
                     one of the key, nulls skipped.
    ``key_count``    name of a column with the number of rows of the key.
    An empty list of keys scans the whole frame as one key.
    """
    lags, last_position = lags or {}, last_position or {}
    running_sums, running_max, next_min = running_sums or {}, running_max or {}, next_min or {}
    keys, order = list(keys), list(order)
    inputs = {**running_sums, **running_max, **last_position, **next_min}
    seg = segments(df.withColumns({f"_in_{n}": _col(e) for n, e in inputs.items()}) if inputs else df,
                   keys, order, per_segment)

    w = Window.partitionBy(*keys, SEG).orderBy(*order, TIE)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = {"_lrn": F.row_number().over(w).cast("long")}
    cols |= {f"_lag_{out}": F.lag(src).over(w) for out, src in lags.items()}
    cols |= {f"_rs_{n}": F.sum(f"_in_{n}").over(run) for n in running_sums}
    cols |= {f"_rm_{n}": F.max(f"_in_{n}").over(run) for n in running_max}
    if next_min:                                            # from the last row back
        back = Window.partitionBy(*keys, SEG).orderBy(*[F.col(c).desc() for c in (*order, TIE)])
        cols |= {f"_nm_{n}": F.min(f"_in_{n}").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
                 for n in next_min}
    local = seg.withColumns(cols)
    if last_position:
        local = local.withColumns({f"_lp_{n}": F.max(F.when(F.col(f"_in_{n}"), F.col("_lrn"))).over(run)
                                   for n in last_position})

    # One summary row per (key, segment): what a later segment needs to know.
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    if lags:
        aggs.append(F.max_by(F.struct(*[F.col(src).alias(out) for out, src in lags.items()]),
                             F.struct(*[F.col(o) for o in order], F.col(TIE))).alias("_last"))
    aggs += [F.sum(f"_in_{n}").alias(f"_tot_{n}") for n in running_sums]
    aggs += [F.max(f"_in_{n}").alias(f"_max_{n}") for n in running_max]
    aggs += [F.min(f"_in_{n}").alias(f"_min_{n}") for n in next_min]
    # positions inside a segment exist only after its window
    aggs += [F.max(f"_lp_{n}").alias(f"_lpmax_{n}") for n in last_position]
    summary = (local if last_position else seg).groupBy(*keys, SEG).agg(*aggs)

    ws = Window.partitionBy(*keys).orderBy(SEG)
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carry = [F.col(k).alias(f"_key_{k}") for k in keys] + [
        F.col(SEG).alias("_sseg"), F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(whole).alias("_all")]
    if lags:
        carry.append(F.lag("_last").over(ws).alias("_prev"))
    carry += [F.sum(f"_tot_{n}").over(before).alias(f"_cs_{n}") for n in running_sums]
    carry += [F.max(f"_max_{n}").over(before).alias(f"_cm_{n}") for n in running_max]
    if next_min:
        after = Window.partitionBy(*keys).orderBy(F.col(SEG).desc()).rowsBetween(Window.unboundedPreceding, -1)
        carry += [F.min(f"_min_{n}").over(after).alias(f"_cn_{n}") for n in next_min]
    carry += [F.col(f"_lpmax_{n}") for n in last_position]
    summary = summary.select(*carry)
    if last_position:
        ws = Window.partitionBy(*[f"_key_{k}" for k in keys]).orderBy("_sseg")
        before = ws.rowsBetween(Window.unboundedPreceding, -1)
        summary = summary.withColumns({f"_cl_{n}": F.max(F.col(f"_lpmax_{n}") + F.col("_off")).over(before)
                                       for n in last_position})

    same = F.col(SEG) == F.col("_sseg")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = local.join(summary, same)
    exprs = {}
    if row_number:
        exprs[row_number] = F.col("_lrn") + F.col("_off")
    if key_count:
        exprs[key_count] = F.col("_all")
    for n in lags:
        exprs[n] = F.when(F.col("_lrn") == 1, F.col(f"_prev.{n}")).otherwise(F.col(f"_lag_{n}"))
    for n in running_sums:
        mine, prior = F.col(f"_rs_{n}"), F.col(f"_cs_{n}")
        exprs[n] = F.coalesce(mine + prior, mine, prior)
    for n in running_max:
        exprs[n] = F.greatest(F.col(f"_rm_{n}"), F.col(f"_cm_{n}"))
    for n in next_min:
        exprs[n] = F.least(F.col(f"_nm_{n}"), F.col(f"_cn_{n}"))
    for n in last_position:
        exprs[n] = F.coalesce(F.col(f"_lp_{n}") + F.col("_off"), F.col(f"_cl_{n}"))
    out = out.withColumns(exprs)
    return out.drop(*[c for c in out.columns if c not in df.columns and c not in exprs])


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table in the shared checkpoint folder and
    read it back (one job; the lineage is cut at the written table).

    The folder comes from ``spark.checkpoint.dir`` (shared storage on a
    cluster), so a lost executor does not lose the table.
    """
    return written(df)[0]


def written(df: DataFrame, **options) -> tuple[DataFrame, str]:
    """``materialize`` with options of the writer; also gives the folder, for
    ``session.drop_table`` when nothing reads the table any more."""
    from ..session import scratch_table_dir, shuffles_dropped
    path = scratch_table_dir(df.sparkSession, f"stage-{uuid.uuid4().hex}")
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.parquet(path), path


def global_row_number(df: DataFrame, order: Sequence[str], name: str = "row_id",
                      per_segment: int | None = None) -> DataFrame:
    """Contiguous 1..n over the whole frame without a one-partition window:
    only the summary (one row per segment) meets in one task."""
    return ordered_scan(df, [], order, row_number=name, per_segment=per_segment)
