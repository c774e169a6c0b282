"""Ids, balancing and the split do not depend on the number of partitions."""

from telewatch.operators import prep as P
from telewatch.sources import readings as RD

from .conftest import SF001


def _run(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    t = RD.with_process_ids(RD.training_rows(spark, SF001).repartition(partitions))
    ids = sorted(tuple(r) for r in t.select("id", "process_id").collect())
    bal = sorted(tuple(r) for r in P.balance(t, 200).select("label", "process_id").collect())
    split = sorted(tuple(r) for r in P.stratified_split(t).select("process_id", "split").collect())
    return ids, bal, split


def test_same_results_for_3_and_17_partitions(spark):
    try:
        a = _run(spark, 3)
        b = _run(spark, 17)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b
