import random

import numpy as np
import pytest

from telewatch.llm import op1_substrings as O

from . import brute


def run(df, **kw):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
                   for r in O.dedup_substrings(df, **kw).collect()), key=repr)


def test_levels_double():
    assert O.level_lengths(50) == [13, 25, 50]
    assert all(b <= 2 * a for n in (20, 37, 50, 200) for a, b in
               zip(O.level_lengths(n), O.level_lengths(n)[1:], strict=False))


def test_anchor_is_the_smallest_hash_of_its_run():
    x = np.random.default_rng(1).integers(0, 2 ** 63, 5000).astype(np.uint64)
    got = O.anchors(x, 38)
    assert len(got) == 5000 - 37
    assert all(p == i + int(np.argmin(x[i:i + 38])) for i, p in enumerate(got[:500]))


def test_chunks_of_a_long_text_agree(monkeypatch):
    x = np.random.default_rng(2).integers(0, 2 ** 63, 5000).astype(np.uint64)
    want = O.anchors(x, 38)
    monkeypatch.setattr(O, "CHUNK", 256)
    assert (O.anchors(x, 38) == want).mean() > 0.999   # ties of truncated hashes aside


def test_messy_rows_equal_brute_force(spark, messy):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert run(messy) == sorted(brute.substrings(rows), key=repr)


def test_empty_table(spark, empty):
    assert run(empty) == []


@pytest.mark.parametrize("seed,flush", [(1, 200_000), (2, 50)])
def test_random_passages_equal_brute_force(spark, monkeypatch, seed, flush):
    monkeypatch.setattr(O, "FLUSH", flush)       # small flushes: every window crosses buckets
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(45, 90)))
            for _ in range(6)]
    rows = []
    for i in rng.sample(range(1000), 60):
        parts = [rng.choice(pool) if rng.random() < 0.4 else
                 " ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(0, 60))) for _ in range(3)]
        rows.append((i, "\n".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(df) == sorted(brute.substrings(rows), key=repr)


def test_spans_and_text(spark, messy):
    for r in O.dedup_substrings(messy).collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert len(r.kept_text.encode().split()) == r.n_words - r.n_removed
