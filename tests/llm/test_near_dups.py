import random

import pytest

from telewatch.llm import op4_near_dups as O

from . import brute


def run(df):
    return {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in O.near_duplicates(df).collect()}


def test_bayes_minimum_keeps_likely_pairs():
    assert O.bayes_minimum(16, 0.75) < 8 < O.bayes_minimum(128, 0.75) < 96


def test_messy_rows_equal_brute_force(messy):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    comp = brute.near_duplicates(rows)
    got = run(messy)
    for i, n, c, kept in got:
        assert n in {len(brute.shingle_set(t)) for d, t in rows if d == i}
        assert (c, kept) == ((comp[i], comp[i] == i) if i is not None else (None, True))


def test_empty_table(empty):
    assert run(empty) == set()


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_equal_brute_force(spark, seed):
    """Groups whose members are partly linked only through each other."""
    rng = random.Random(seed)
    rows, i = [], 0
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 25)):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 12)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 10 ** 9)}"
            rows.append((i, " ".join(w)))
            i += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_duplicates(rows)
    assert {d: c for d, _, c, _ in run(df)} == want


def test_prefix_filter_finds_what_stars_miss(spark):
    """Buckets that stay open are compared exactly."""
    base = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 30):               # a chain: each document drifts on from the one before
        base = list(base)
        base[(i * 7) % 200] = f"n{i}"
        base[(i * 7 + 90) % 200] = f"m{i}"
        rows.append((i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {d: c for d, _, c, _ in run(df)} == brute.near_duplicates(rows)
