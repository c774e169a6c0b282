import tempfile
from collections import Counter

import numpy as np
import pytest

from telewatch.llm import op7_token_counts as O


def flat(folder, name, docs, width=2, tail=()):
    ids = [x for d in docs for x in [*d, 0]] + list(tail)
    data = np.array(ids, O.WIDTHS[width]).tobytes()
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data)


def counts(spark, folder, **kw):
    return sorted((r.file.rsplit("/", 1)[1], r.doc_no, r.start, r.n_tokens, r.terminated)
                  for r in O.count_tokens(spark, folder, **kw).collect())


def expected(files):
    out = []
    for name, (docs, tail) in files.items():
        at = 0
        for i, d in enumerate(docs):
            out.append((name, i, at, len(d), True))
            at += len(d) + 1
        if tail:
            out.append((name, len(docs), at, len(tail), False))
    return sorted(out)


@pytest.mark.parametrize("width,block", [(2, 1 << 20), (2, 7), (4, 16), (2, 64)])
def test_documents_are_stitched_across_blocks(spark, width, block):
    rng = np.random.default_rng(5)
    files = {}
    folder = tempfile.mkdtemp(prefix="telewatch-tok-")
    for k in range(4):
        docs = [list(map(int, rng.integers(1, 60_000, rng.integers(0, 50)))) for _ in range(40)]
        tail = [5, 6, 7] if k == 2 else []
        files[f"f{k}.bin"] = (docs, tail)
        flat(folder, f"f{k}.bin", docs, width, tail)
    files["one.bin"] = ([], [9] * 100)
    flat(folder, "one.bin", [], width, [9] * 100)
    open(f"{folder}/none.bin", "wb").close()
    assert counts(spark, folder, width=width, block=block) == expected(files)


def test_round_trip_of_messy_rows(spark, messy, empty):
    from .test_packing import tokenizer_cached
    folder = tempfile.mkdtemp(prefix="telewatch-tok-")
    O.write_token_files(messy, folder)
    got = Counter(r.n_tokens for r in O.count_tokens(spark, folder, block=256).collect())
    want = Counter(len(tokenizer_cached().encode(r.text or "", add_special_tokens=False).ids)
                   for r in messy.collect())
    assert got == want
    O.write_token_files(empty, folder)
    assert O.count_tokens(spark, folder).count() == 0


def test_a_large_id_and_a_partial_id(spark):
    folder = tempfile.mkdtemp(prefix="telewatch-tok-")
    with open(f"{folder}/f.bin", "wb") as f:
        f.write(np.array([256, 1, 0, 65535, 0], "<u2").tobytes() + b"\x01")   # zero bytes inside ids
    assert counts(spark, folder) == [("f.bin", 0, 0, 2, True), ("f.bin", 1, 3, 1, True)]


def test_a_file_above_two_gigabytes(spark):
    folder = tempfile.mkdtemp(prefix="telewatch tok%20-")
    size, ends = (1 << 31) + 4096, [5, 1 << 20, (1 << 30) + 17, (1 << 30) + 2000]
    with open(f"{folder}/f.bin", "wb") as f:           # sparse: ids 0 but for the separators
        f.truncate(size)
        for e in ends:
            f.seek(2 * e)
            f.write(b"\x07\x00")
    starts = [0, *(e + 1 for e in ends)]
    want = [("f.bin", i, a, b - a, i < len(ends)) for i, (a, b) in enumerate(zip(starts, [*ends, size // 2], strict=True))]
    assert counts(spark, folder, separator=7) == want


def test_written_files_are_bounded_by_bytes(spark, monkeypatch):
    import os
    rows = [(" ".join(["word"] * (i % 50)),) for i in range(300)]
    docs = spark.createDataFrame(rows, "text string").coalesce(1)
    folder = tempfile.mkdtemp(prefix="telewatch-tok-")
    monkeypatch.setattr(O, "FILE_BYTES", 4096)
    O.write_token_files(docs, folder)
    sizes = [os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder) if n.startswith("part-")]
    assert len(sizes) > 1 and max(sizes) <= 4096
    assert sorted(r[3] for r in counts(spark, folder)) == sorted(i % 50 for i in range(300))


def test_blocks_read_by_spark_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    folder = tempfile.mkdtemp(prefix="telewatch-tok-")
    docs = [list(map(int, rng.integers(1, 9, n))) for n in (0, 40, 3, 700, 0)]
    flat(folder, "f.bin", docs, tail=[4])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.tok.link./in", f"file://{folder}")
    got = counts(spark, "viewfs://tok/in", block=64)
    assert got == counts(spark, folder, block=64) == expected({"f.bin": (docs, [4])})
