import random

import pytest

from telewatch.llm.common import components

from .brute import components as brute_components


@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty"])
def test_components_equal_union_find(spark, shape):
    rng = random.Random(7)
    edges = {"random": [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)],
             "chain": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(200)],
             "empty": [(3, 3)]}[shape]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in components(df).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == brute_components(linked, [e for e in edges if e[0] != e[1]])


def test_further_links_join_what_was_found(spark):
    import random

    from telewatch.llm.common import components, components_with, stage
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    first, later = pairs[:180], pairs[180:] + [(500, 501), (501, 502), (7, 7)]

    def frame(rows):
        return spark.createDataFrame(rows, "src long, dst long")
    found = components_with(stage(components(frame(first))), frame(later))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, components(frame(first + later)).collect()))
    assert found.count() == components_with(stage(found), frame([(1, 1)])).count()


def test_a_stage_leaves_no_shuffle_files(spark):
    """They filled the disk of long jobs: nothing removed them before the driver's garbage collection."""
    import glob

    from pyspark.sql import functions as F
    from telewatch.llm.common import stage
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()

    def files():
        return {f for d in env.blockManager().diskBlockManager().localDirsString() for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}
    before = files()
    out = stage(spark.range(5000).groupBy((F.col("id") % 50).alias("k")).count().join(spark.range(50).withColumnRenamed("id", "k"), "k"))
    assert not files() - before
    assert out.count() == 50
