import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from telewatch.llm import op2_packing as O


@given(st.lists(st.integers(1, 100), max_size=60))
@settings(max_examples=150, deadline=None)
def test_bin_completion_packs_everything(lengths):
    bins = O.bin_completion(lengths, 100, nodes=300)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= len(O.best_fit(lengths, 100))


def test_bin_completion_improves_best_fit():
    rng = random.Random(1)
    lengths = [rng.randint(400, 1100) for _ in range(300)]
    assert len(O.bin_completion(lengths, 2048)) < len(O.best_fit(lengths, 2048))


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(O.VOCABULARY))


@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_word_tokens_equal_the_tokenizer(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    whole = tokenizer_cached().encode_batch(texts, add_special_tokens=False)
    got = list(O.word_tokens(O.VOCABULARY).packed([t.encode() for t in texts]))
    assert got == [np.array(e.ids, "<u4").tobytes() for e in whole]


_T = []


def tokenizer_cached():
    if not _T:
        _T.append(tokenizer())
    return _T[0]


def expected_pieces(rows, capacity=O.CAPACITY):
    out = []
    for i, t in rows:
        ids = tokenizer_cached().encode(t or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at:at + capacity], "<u4").tobytes()
            out.append((i, p, at, len(part) // 4, zlib.crc32(part)))
    return sorted(out, key=repr)


def check_packing(rows, capacity=O.CAPACITY):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_messy_rows(spark, messy):
    got = O.pack_documents(messy).collect()
    want = expected_pieces([(r.doc_id, r.text) for r in messy.collect()])
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=repr) == want
    n = check_packing(got)
    assert n == -(-sum(r.length for r in got) // O.CAPACITY)


def test_empty_table(empty):
    assert O.pack_documents(empty).count() == 0


@pytest.mark.parametrize("per_group", [20, 200])
def test_groups_lose_little(spark, per_group):
    rng = random.Random(3)
    rows = [(i, min(2047, int(rng.lognormvariate(5.5, 1)) + 1), rng.randint(0, 10 ** 9)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, length long, salt long")
    got = O.pack_pieces(df, per_group=per_group).collect()
    assert len(got) == len(rows)
    bound = -(-sum(r[1] for r in rows) // O.CAPACITY)
    assert check_packing(got) <= bound * 1.05 + 1


@pytest.mark.parametrize("capacity,lengths,bins", [
    (200, [128, 121, 95, 50, 47, 34, 31, 24, 21, 18, 15, 8, 6, 2], 3),
    (200, [157, 113, 81, 67, 52, 31, 25, 24, 22, 21, 7], 3),
    (200, [134, 106, 103, 102, 84, 80, 68, 65, 60, 56, 50, 47, 43, 43, 37, 36, 30, 24, 12, 12, 4, 4], 6)])
def test_an_exhausted_search_is_a_proof(capacity, lengths, bins):
    packed = O.bin_completion(lengths, capacity)
    assert sorted(i for b in packed for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= capacity for b in packed)
    assert len(packed) == bins == -(-sum(lengths) // capacity)


@given(st.lists(st.integers(1, 20), max_size=8), st.integers(0, 40))
@settings(max_examples=150, deadline=None)
def test_every_completion(lengths, room):
    from itertools import combinations
    want = set()
    for r in range(len(lengths) + 1):
        for c in combinations(range(len(lengths)), r):
            left = room - sum(lengths[i] for i in c)
            if left >= 0 and all(lengths[i] > left for i in range(len(lengths)) if i not in c):
                want.add(tuple(sorted((lengths[i] for i in c), reverse=True)))
    count = [lengths.count(s) for s in range(41)]
    got = [f for f in O.every_completion(count, sorted(set(lengths)), room) if f is not None]
    assert len(got) == len(set(got)) and set(got) == want
