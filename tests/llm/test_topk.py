import math
import random

import pytest

from telewatch.llm import op5_topk as O

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def brute(rows, k=5, every=50):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) and abs(x * 256) < O.LIMIT for x in v)
    vec = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = set()
    for q, x in vec:
        if q % every:
            continue
        s = sorted(((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in vec if i != q))
        out |= {(q, r + 1, i, -score) for r, (score, i) in enumerate(s[:k])}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA).repartition(3)
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in O.top_k(df, **kw).collect()}


@pytest.mark.parametrize("seed,per_cell", [(1, 4096), (2, 16)])
def test_equals_brute_force(spark, seed, per_cell):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = [(i, [float(c + rng.gauss(0, 0.2)) for c in rng.choice(centre)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)]          # ties: one very common vector
    rows = [(i, [struct_float(x) for x in v]) for i, v in rows]
    assert run(spark, rows, per_cell=per_cell, pivots=8) == brute(rows)


def struct_float(x):
    import struct
    return struct.unpack("f", struct.pack("f", x))[0]


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]),
            (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [2.0]), (6, []), (7, [1e30, 0.0]), (8, [-0.25, 4.0])]
    assert run(spark, rows) == brute(rows)


def test_fewer_candidates_and_empty(spark):
    assert run(spark, [(0, [1.0]), (1, [1.0])]) == {(0, 1, 1, 65536)}
    assert run(spark, [(0, [1.0])]) == set()
    assert run(spark, []) == set()


def test_large_finite_vectors_take_part(spark):
    rows = [(0, [1.0, 2.0]), (50, [-0.5, 3.0]), (1, [2.0 ** 20, 1.0]), (2, [-(2.0 ** 40), 2.0 ** 40]),
            (3, [-(2.0 ** 45), 0.25]), (100, [2.0 ** 26, 2.0 ** 26 + 8])] + [(i, [i / 8, 1.0]) for i in range(4, 12)]
    vec = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = set()
    for q in (0, 50, 100):
        s = sorted((-sum(a * b for a, b in zip(vec[q], vec[i], strict=True)), i) for i in vec if i != q)
        want |= {(q, r + 1, i, -score) for r, (score, i) in enumerate(s[:5])}
    assert {i for _, _, i, _ in want} >= {1, 2}
    assert run(spark, rows) == want == run(spark, rows, per_cell=2, pivots=3)


def test_wide_products_are_exact():
    import numpy as np
    rng = random.Random(3)
    a, b = ([[rng.choice((1, -1)) * rng.getrandbits(rng.choice((8, 30, 45, 62))) for _ in range(6)] for _ in range(40)]
            for _ in range(2))
    b += [[-x for x in row[:3]] + row[3:] for row in a]
    got, beyond = O._dot(np.array(a), np.array(b))
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            true = sum(p * q for p, q in zip(x, y, strict=True))
            side = (true >= 1 << 63) - (true < -(1 << 63))
            assert beyond[i, j] == side and (side or got[i, j] == true)


def test_a_score_beyond_a_long_raises(spark):
    far = 2.0 ** 30
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, [(0, [far * 256]), (1, [far * 256])])
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, [(0, [far * 256]), (1, [-far * 256])])
    low = [(0, [far * 256]), (1, [-far * 256]), *((i, [1.0]) for i in range(2, 7))]
    assert {r[2] for r in run(spark, low)} == {2, 3, 4, 5, 6}
