import glob
import os
import random
import tempfile
import zlib

import numpy as np
import pytest
import xxhash

from telewatch.llm import op12_token_store as O

from .conftest import messy_rows

SCHEMA = "doc_id long, text string, start string, bucket int"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def order(row):
    """Rows without an id first; ties by the hash of the text (signed), then the text."""
    i, t = row
    h = 42 if t is None else xxhash.xxh64_intdigest(t.encode(), seed=42)
    return i is not None, i or 0, h - (1 << 64) if h >> 63 else h, (t or "").encode()


def brute(tokenizer, rows, end=1):
    """[(doc_id, text)] -> [(doc_id, start, n_tokens, crc)] in store order."""
    at, out = 0, []
    for i, t in sorted(rows, key=order):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in rows], SCHEMA).repartition(5)


def store(spark, rows, **kw):
    path = os.path.join(tempfile.mkdtemp(prefix="telewatch-store-"), "s")
    O.write_store(frame(spark, rows), path, **kw)
    return path


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)] + ["Ünïcode", "don't", "\"quoted\"", "!", "x\x00y", "1984", "日本語"]
    out = [(rng.randrange(-10 ** 12, 10 ** 12), " ".join(rng.choices(words, k=rng.randint(0, 60)))) for _ in range(400)]
    return out + [(r[0], r[1]) for r in messy_rows()]


@pytest.mark.parametrize("width", [2, 4])
def test_round_trip_equals_brute_force(spark, tokenizer, rows, width):
    path = store(spark, rows, width=width)
    assert got(O.read_documents(spark, path, frame(spark, rows), width, digest=True)) == brute(tokenizer, rows)


def test_many_shards_and_buckets(spark, tokenizer, rows, monkeypatch):
    monkeypatch.setattr(O, "SHARD_BYTES", 400)
    monkeypatch.setattr(O, "SHARD_ROWS", 7)
    monkeypatch.setattr(O, "KEYS_PER_BUCKET", 16)
    monkeypatch.setattr(O, "RUN", 64)
    monkeypatch.setattr(O, "TASK_BYTES", 20_000)
    path = store(spark, rows)
    assert len(glob.glob(f"{path}/data/kind=ids/part=*/*.txt")) > 50
    assert got(O.read_documents(spark, path, frame(spark, rows), digest=True)) == brute(tokenizer, rows)


def test_shards_hold_raw_ids_in_order(spark, tokenizer, rows):
    path = store(spark, rows)
    shards = spark.read.parquet(f"{path}/shards").orderBy("shard").collect()
    raw = b"".join(open(r.file.replace("file:", ""), "rb").read() for r in shards)
    want = [x for _, t in sorted(rows, key=order) for x in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]]
    assert np.frombuffer(raw, "<u2").tolist() == want
    assert [r.base for r in shards] == [sum(x.n_ids for x in shards[:i]) for i in range(len(shards))]


def test_keyed_access_to_some_and_foreign_keys(spark, tokenizer, rows):
    path = store(spark, rows)
    mine = [r for r in brute(tokenizer, rows) if r[0] is not None and r[0] % 7 == 0]
    asked = sorted({r[0] for r in mine}) * 2 + [10 ** 15 + i for i in range(5000)]
    keys = spark.createDataFrame([(k,) for k in asked], "doc_id long")
    found = O.read_documents(spark, path, keys).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4"))) for r in found) \
        == sorted(mine)
    nameless = spark.createDataFrame([(None,)], "doc_id long")
    assert O.lookup(spark, path, nameless).count() == sum(r[0] is None for r in rows)


def test_empty_and_only_null(spark, tokenizer, empty):
    path = os.path.join(tempfile.mkdtemp(prefix="telewatch-store-"), "s")
    O.write_store(empty, path)
    assert O.read_documents(spark, path, empty, digest=True).collect() == []
    rows = [(None, None), (None, "a b"), (None, "a b")]
    path = store(spark, rows)
    assert got(O.read_documents(spark, path, frame(spark, rows), digest=True)) == brute(tokenizer, rows)


@pytest.mark.parametrize("n", [0, 1, 2, 64, 5000])
def test_perfect_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    if n == 5000:
        keys = np.arange(n, dtype=np.uint64)               # dense keys as well
    rooms, bits = O.perfect_hash(keys)
    at = O.slots(keys, rooms, bits)
    assert sorted(at.tolist()) == list(range(len(keys)))
    assert len(bits) * 8 <= 8 * max(64, len(keys)) + 64 * len(rooms)


def test_foreign_keys_fail_their_fingerprint():
    keys = np.arange(4096, dtype=np.uint64)
    rooms, bits = O.perfect_hash(keys)
    prints = np.empty(len(keys), "<u4")
    prints[O.slots(keys, rooms, bits)] = O.fingerprints(keys)
    other = np.arange(10 ** 6, 10 ** 6 + 200_000, dtype=np.uint64)
    at = O.slots(other, rooms, bits)
    held = at >= 0
    assert (prints[at[held]] == O.fingerprints(other[held])).sum() <= 1


def test_repeated_keys_raise():
    with pytest.raises(ValueError, match="distinct"):
        O.perfect_hash(np.array([5, 5], np.uint64))


def test_texts_split_as_a_whole_equal_the_tokenizer(tokenizer):
    """Texts of plain words are split into parts in one go, without a cache entry per word."""
    texts = ["It's HE'LL x''s don'T,, 12.5%...ÀÉß\t\n\r\x0b\x0c(word)", " a,b ;c×d", "", " ", "Word <|endoftext|> x", "'S 've'd ,'m",
             "café İx 日本 y", "nul\x00 \x1c z"]
    tokens = O.PackedTokens(O.VOCABULARY, "<u2")
    for t, ids in zip(texts, tokens.packed([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    plain = O.PackedTokens(O.VOCABULARY, "<u2")
    list(plain.packed([b"Anou, anou. ANOU anou; (anou)"]))
    assert not plain.young and set(plain.parts) == {"anou", ",", ".", ";", "(", ")"}
