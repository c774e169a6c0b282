import math
import random

import numpy as np
import pytest

from telewatch.llm import op11_hard_negatives as O

from .test_topk import struct_float

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, block int, place string"


def brute(rows, k=5, m=5, least=80, every=100):
    """[(vec_id, embedding, label)] -> the result rows, in plain Python."""
    vec = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, v, label in rows
           if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, la, x in vec:
        if a % every:
            continue
        s = [(-sum(p * q for p, q in zip(x, y, strict=False)), i, lab) for i, lab, y in vec if i != a]
        for p, pos in sorted((sc, i) for sc, i, lab in s if lab == la)[:k]:
            fit = sorted((sc, i) for sc, i, lab in s if lab != la and least * -p <= 100 * -sc <= 100 * -p)[:m]
            out += [(a, pos, r + 1, i, -p, -sc) for r, (sc, i) in enumerate(fit)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, label, "clash", 1, "x") for i, v, label in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in O.hard_negatives(df, **kw).collect())


def clustered(seed, n=900, dim=8, noise=0.3):
    rng = random.Random(seed)
    centre = [[rng.gauss(0.4, 1) for _ in range(dim)] for _ in range(6)]
    out = []
    for i in range(n):
        c = rng.randrange(6)
        out.append((i, [struct_float(x + rng.gauss(0, noise)) for x in centre[c]], c if rng.random() < 0.8 else rng.randrange(10)))
    return out


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"per_tree": 3, "per_block": 50}), (3, {"anchor_every": 5, "per_tree": 16}),
                                     (4, {"anchor_every": 9, "positives": 3, "negatives": 2, "least": 95})])
def test_equals_brute_force(spark, seed, kw):
    rows = clustered(seed)
    names = {"positives": "k", "negatives": "m", "anchor_every": "every", "least": "least"}
    want = brute(rows, **{names[k]: v for k, v in kw.items() if k in names})
    assert run(spark, rows, **kw) == want and want


def test_ties_and_one_common_vector(spark):
    rows = [(i, [0.5, 0.25], i % 3) for i in range(300)] + [(300 + i, [0.5, 0.24 - i / 1e3], 1) for i in range(50)]
    assert run(spark, rows, per_block=20) == brute(rows)


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0], 1), (100, [0.5, -1.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 2),
            (4, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (5, [2.0], 1), (6, [], 2), (8, [-0.25, 4.0], None),
            (9, [1.0, 1.9], 2), (10, [1.0, 2.1], 1), (11, [-1.0, -2.0], 1), (14, [0.9, 1.9], 1), (200, [0.0, 0.0], 4),
            (201, [3.0, 1.0], 4), (202, [5.0, 1.0], 5)]
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_count_each(spark):
    rows = clustered(5, 250) + [(7, [1.0] * 8, 3)] * 3 + [(21, [1.0] * 8, 2)] * 4
    got, want = run(spark, rows), brute(rows)
    assert got == want


def test_empty_and_no_anchor(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert run(spark, [(100, [], 1)]) == []


def test_large_finite_vectors_take_part(spark):
    rows = [(0, [1.0, 2.0], 1), (100, [-0.5, 3.0], 2), (1, [2.0 ** 20, 1.0], 2), (2, [-(2.0 ** 40), 2.0 ** 40], 1),
            (3, [2.0 ** 45, 0.25], 2), (4, [2.0 ** 44.9, 1.0], 1), (5, [1e30, 1e30], 3), (6, [-1e30, 1.0], 4),
            (8, [2.0 ** 39.9, 2.0 ** 39.9], 5)]
    rows = [(i, [struct_float(x) for x in v], lab) for i, v, lab in rows]
    got = run(spark, rows, per_tree=1)
    assert got == brute(rows) and {r[3] for r in got} & {3, 4, 8}


def test_a_positive_beyond_a_long_raises(spark):
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, [(0, [2.0 ** 60], 1), (1, [2.0 ** 60], 1), (2, [2.0 ** 60], 2)])


def test_spanning_tree_is_minimal():
    rng = np.random.default_rng(0)
    m = rng.normal(size=(40, 5))
    order, parent, edge = O.spanning_tree(m)
    assert sorted(order) == list(range(40)) and (parent < 0).sum() == 1
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(axis=2))
    pairs = sorted((d[i, j], i, j) for i in range(40) for j in range(i))
    root = list(range(40))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    total = 0.0
    for w, i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            total += w
    assert edge.sum() == pytest.approx(total)
    seen = {order[0]}
    for i in order[1:]:
        assert parent[i] in seen and edge[i] == pytest.approx(d[i, parent[i]])
        seen.add(i)


def test_bounds_hold_and_spare_most_products():
    """Every score lies within its bounds; on clustered anchors most are never computed."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(10, 16)) * 300
    label = rng.integers(0, 10, 4000)
    m = np.floor(centre[label] + rng.normal(size=(4000, 16)) * 12)
    cand = O.Candidates(np.arange(4000), label, m)
    near = np.flatnonzero(label == 2)[:120]
    order, parent, edge = O.spanning_tree(m[near])
    place = np.empty(120, int)
    place[order] = np.arange(120)
    tree = {"ids": near[order], "labels": label[near][order], "m": m[near][order],
            "parent": np.where(parent[order] < 0, -1, place[parent[order]]), "edge": edge[order]}
    best = {}
    for a, v, s in O.best_positives(tree, cand, 5):
        best.setdefault(a, []).append(s)
    tree["wins"] = [list(enumerate(best[i])) for i in tree["ids"].tolist()]
    got = {}
    for a, w, v, s in O.window_negatives(tree, cand, 5, 80):
        got.setdefault((a, w), []).append(s)
    computed = 0
    full = (m[near][order] @ m.T).astype(np.int64)
    for i, rows, scores, _ in O.walk(tree, cand, lambda i, low, high: _watch(full[i], low, high, tree, i)):
        computed += len(rows)
        assert (scores == full[i, rows]).all()
    assert computed < 0.5 * full.size
    for i, a in enumerate(tree["ids"].tolist()):
        mine = (label == tree["labels"][i]) & (np.arange(4000) != a)
        assert best[a] == sorted(full[i, mine].tolist(), reverse=True)[:5]
        for w, p in tree["wins"][i]:
            fit = full[i, (label != tree["labels"][i]) & (100 * full[i] >= 80 * p) & (full[i] <= p)]
            assert got.get((a, w), []) == sorted(fit.tolist(), reverse=True)[:5]


def _watch(true, low, high, tree, i):
    assert (low <= true).all() and (true <= high).all()
    p = [s for _, s in tree["wins"][i]]
    return np.flatnonzero((high >= 0.8 * min(p)) & (low <= max(p)))
