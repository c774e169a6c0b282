import pytest
from pyspark.sql import functions as F

from telewatch.llm import op9_mixing as O


def test_shares_follow_the_targets(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 10).alias("text"),
                                    F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 20 == 1, "rare")
                                    .otherwise("rest").alias("source"))
    out = O.mix_sources(df, {"hot": 0.2, "rare": 0.3})
    n = out.count()
    share = {r.source: r["count"] / n for r in out.groupBy("source").count().collect()}
    assert n == pytest.approx(20_000, rel=0.03)
    assert share == pytest.approx({"hot": 0.2, "rare": 0.3, "rest": 0.5}, abs=0.02)
    per = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("mix_copies").alias("m"),
                                    F.countDistinct("mix_copy").alias("d"))
    assert per.where("n <> m OR n <> d").count() == 0


def test_output_is_globally_ordered_and_repeatable(spark, messy):
    a = [r.mix_key for r in O.mix_sources(messy, O.TARGETS).collect()]
    b = [r.mix_key for r in O.mix_sources(messy.repartition(7), O.TARGETS).collect()]
    assert a == sorted(a) and a == b


def test_poisson_table(spark):
    from math import exp, factorial
    df = spark.createDataFrame([(1, "x" * 30, "a"), (2, "x" * 10, "b")], "doc_id long, text string, source string")
    for r in O.repetition_rates(df, {"a": 0.25, "b": 0.75}).collect():
        lam = {"a": 1 / 3, "b": 3.0}[r.grp]
        assert r.rate == pytest.approx(lam)
        want = [sum(exp(-lam) * lam ** i / factorial(i) for i in range(k + 1)) for k in range(10)]
        assert r.cdf[:10] == pytest.approx(want)
        assert r.cdf[-1] == pytest.approx(1.0, abs=1e-12)


def test_edge_cases(spark, messy, empty):
    out = O.mix_sources(messy, {})
    assert set(messy.columns) < set(out.columns)
    assert O.mix_sources(empty, O.TARGETS).count() == 0
    assert O.mix_sources(messy, {"src0": 1.0}).where("source <> 'src0'").count() == 0
    with pytest.raises(ValueError):
        O.mix_sources(messy, {"a": 0.9, "b": 0.2})
