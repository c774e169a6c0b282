import random
import re
from collections import Counter

import pytest

from telewatch.llm import op13_phrases as O

from .conftest import messy_rows


def brute(rows, support=10, longest=3, top=2000, share=50):
    """[(text, lang)] -> {(lang, rank, phrase, a, l, r, n, score)} in plain Python."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + size])] += 1
    out = set()
    for lang, counts in f.items():
        ok = {p: c for p, c in counts.items() if len(p) > 1 and c >= support}
        rows = []
        for p, a in ok.items():
            score, k = min((10 ** 6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            inside = any(100 * c >= share * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                         for q, c in ok.items() if len(q) > len(p))
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top]):
            out.add((lang, rank + 1, p.decode(), -a, left, right, n[lang], -s))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows],
                               "text string, lang string, phrase int, bucket string").repartition(7)
    return {tuple(r) for r in O.collocations(df, **kw).collect()}


def texts(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Alpha", "BETA", "é", "Ünder", " x", "a\x1cb"]
    fixed = ["New York City", "over the moon", "per se", "as well as"]
    out = []
    for i in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocabulary[:rng.randint(2, 46)])
                 for _ in range(rng.randint(0, 40))]
        out.append(("".join(w + rng.choice([" ", "  ", "\t", ", ", ". ", "\n", "! "]) for w in words),
                    rng.choice(["en", "de", None])))
    return out


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"support": 4, "shards": 3}), (3, {"support": 3, "top": 7}),
                                     (4, {"support": 5, "longest": 4, "keep_share": 80}), (5, {"support": 10, "shards": 40})])
def test_equals_brute_force(spark, seed, kw):
    rows = texts(seed)
    names = {"keep_share": "share"}
    want = brute(rows, **{names.get(k, k): v for k, v in kw.items() if k != "shards"})
    assert run(spark, rows, **kw) == want and want


def test_small_chunks_and_buckets_change_nothing(spark, monkeypatch):
    rows = texts(6)
    want = brute(rows, support=3)
    monkeypatch.setattr(O, "CHUNK", 50)
    monkeypatch.setattr(O, "BUCKET_BYTES", 500)
    assert run(spark, rows, support=3) == want


def test_a_filter_that_lets_everything_through_changes_nothing(spark, monkeypatch):
    rows = texts(7)
    monkeypatch.setattr(O, "MOST_BITS", 8)
    assert run(spark, rows, support=3) == brute(rows, support=3)


def test_overlaps_and_one_hot_phrase(spark):
    rows = [("a a a a a a a a a a a a a", "en")] + [("hot phrase here", "en")] * 500 + [("hot phrase", "fr")] * 9
    got = run(spark, rows)
    assert got == brute(rows)
    assert ("a a a", 11, 13, 12) in {(g[2], g[3], g[4], g[5]) for g in got}


def test_messy_and_empty(spark, messy, empty):
    rows = [(t, lang) for _, t, lang, *_ in messy_rows()]
    assert {tuple(r) for r in O.collocations(messy, support=3).collect()} == brute(rows, support=3)
    assert O.collocations(empty).collect() == []
    assert run(spark, [(None, "en"), ("", None), (" \t. \n", "en")]) == set()


def test_counts_beyond_64_bits_stay_exact(spark):
    """The score of huge counts, through the same expression."""
    a, left, right = 3 * 10 ** 12 + 7, 5 * 10 ** 12 + 1, 4 * 10 ** 12 + 3
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(
        O.score("a", "l", "r").alias("s")).first()
    assert row.s == 10 ** 6 * a * a // (left * right)


def test_local_support_never_loses_a_frequent_phrase(spark):
    """Candidates of the first pass hold every frequent phrase, whatever the shards."""
    import numpy as np
    rows = texts(8)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(9).selectExpr(
        "cast(text as binary) AS text", "coalesce(lang, 'und') AS lang")
    found = O._locally_frequent(df, 8, 4, 10, 3).collect()
    keys = {(r.lang, k) for r in found for k in np.frombuffer(r.keys, np.uint64).tolist()}
    total = {(r.lang, r.n) for r in found}
    frequent = {(r.lang, r.phrase) for r in O.frequent_phrases(spark.createDataFrame(rows, "text string, lang string"), 10).collect()}
    assert len(keys) >= len(frequent) and len(total) == 3
