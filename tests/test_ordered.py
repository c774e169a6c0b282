"""The segmented ordered scan equals a plain per-key window at any segment size."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from telewatch.operators.ordered import SEG, global_row_number, ordered_scan, segments
from telewatch.sources.tables import telemetry

from .conftest import SF001


@pytest.mark.parametrize("per_segment", [1, 3, 50, 10_000_000])
def test_scan_matches_window(spark, per_segment):
    t = telemetry(spark, SF001)
    got = ordered_scan(t, ["system_id"], ["ts", "id"], per_segment=per_segment,
                       row_number="rn", lags={"prev_id": "id"},
                       running_sums={"cum": F.col("id")},
                       running_max={"mx": F.when(F.col("cpu_percent") < 50, F.col("id"))},
                       last_position={"lp": F.col("cpu_percent") < 30})
    w = Window.partitionBy("system_id").orderBy("ts", "id")
    r = t.withColumn("rn", F.row_number().over(w))
    want = r.select("system_id", "id", "rn", F.lag("id").over(w).alias("prev_id"),
                    F.sum("id").over(w).alias("cum"),
                    F.max(F.when(F.col("cpu_percent") < 50, F.col("id"))).over(w).alias("mx"),
                    F.max(F.when(F.col("cpu_percent") < 30, F.col("rn"))).over(w).alias("lp"))
    got = got.select(*want.columns)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
    assert want.exceptAll(got).count() == 0


def test_global_row_number_is_contiguous(spark):
    t = telemetry(spark, SF001)
    ids = global_row_number(t, ["id"], per_segment=17).select("row_id")
    vals = sorted(r[0] for r in ids.collect())
    assert vals == list(range(1, t.count() + 1))


def test_bursts_nulls_and_label_order_make_bounded_segments(spark):
    """Null keys, null-led values, a burst in a long span, and a label rank that
    leaves wide gaps: the scan equals the window, the segments stay bounded."""
    rows = [(None if k == 2 else f"k{k}", i, (10 ** 15 * k) + (i if i < 390 else 10 ** 12 * i),
             None if i < 150 else i % 7) for k in range(4) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, id long, pos long, v long").repartition(5)
    w = Window.partitionBy("k").orderBy("pos", "id")
    want = df.select("k", "id", F.row_number().over(w).cast("long").alias("rn"), F.sum("v").over(w).alias("cum"),
                     F.lag("v").over(w).alias("prev"), F.max("v").over(w).alias("mx"),
                     F.count(F.lit(1)).over(Window.partitionBy("k")).alias("n"))
    for per_segment in (1, 40, 10 ** 6):
        got = ordered_scan(df, ["k"], ["pos", "id"], row_number="rn", running_sums={"cum": "v"},
                           lags={"prev": "v"}, running_max={"mx": "v"}, key_count="n", per_segment=per_segment)
        got = got.select(*want.columns)
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    seg = segments(df, ["k"], ["pos", "id"], per_segment=50)
    assert seg.groupBy(SEG).count().agg(F.max("count")).first()[0] <= 100
    same = spark.range(1000).select(F.lit("one").alias("k"), F.lit(0).alias("pos"))   # all rows tie
    assert segments(same, ["k"], ["pos"], per_segment=100).groupBy(SEG).count().agg(F.max("count")).first()[0] <= 200
