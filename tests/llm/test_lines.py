from pyspark.sql import functions as F

from telewatch.llm import op8_lines as O

LINE = ("The quick brown fox jumps over the lazy dog near the river bank in the early morning light "
        "while seven grey herons watch from a fallen oak and count small fish below them")


def run(df):
    return sorted([(r.doc_id, r.n_lines, r.n_removed, r.text) for r in O.dedup_lines(df).collect()], key=repr)


def test_similar_lines_leave_one(spark):
    near = LINE.replace("lazy", "lame")
    rows = [(3, LINE + "\nown line of three\n\nlast"), (1, "first\n" + near), (2, LINE + "  \n" + LINE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df) == [(1, 2, 0, "first\n" + near), (2, 2, 2, ""), (3, 4, 1, "own line of three\n\nlast")]


def test_shingles_cover_all_characters(spark):
    a, b = "http://example.com/" + "a" * 60 + "1", "http://example.com/" + "b" * 60 + "1"
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert all(r[2] == 0 for r in run(df))


def test_messy_and_empty(spark, messy, empty):
    before = {(r.doc_id, r.text) for r in messy.collect()}
    out = O.dedup_lines(messy)
    assert set(messy.columns) <= set(out.columns)
    rows = out.collect()
    assert len(rows) == messy.count()
    assert {r.text for r in rows if r.doc_id == 4} == {None}
    assert [r.n_removed for r in rows if r.doc_id == 1] == [0]
    assert [r.n_removed for r in rows if r.doc_id == 2] == [1]
    assert all(r.n_removed == 1 for r in rows if r.doc_id in (2, 3, 13))      # copies of the line of 1
    assert {r.n_removed for r in rows if r.doc_id == 12} == {7, 0}           # one of eight equal lines stays
    assert (6, "  \n\t \n") in before and [r.n_removed for r in rows if r.doc_id == 6] == [0]
    assert O.dedup_lines(empty).count() == 0


def test_links_are_exact(spark):
    rows = [(i, " ".join(f"{w}{i % 7 if k == i % 20 else ''}" for k, w in enumerate(LINE.split() * 2))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sh = {r.doc_id: set(r.sh) for r in df.select("doc_id", O.shingles(O.line_key(F.col("text"))).alias("sh")).collect()}
    from .brute import components
    links = [(a, b) for a in sh for b in sh if a < b and 100 * len(sh[a] & sh[b]) >= O.PERCENT * len(sh[a] | sh[b])]
    comp = components(sh, links)
    kept = {r[0] for r in run(df) if r[2] == 0}
    assert kept == {c for c in comp.values()}


def test_unlike_sets_with_common_elements_make_no_pairs(spark):
    """Sets drawn from a small pool share many elements: few pairs are given but the similar ones."""
    import random

    from telewatch.llm.common import pairs_apart
    rng = random.Random(3)
    pool = [rng.randrange(-2 ** 62, 2 ** 62) for _ in range(45)]
    sets = {k: set(rng.sample(pool, 20)) for k in range(300)}
    for k in range(0, 300, 30):                        # ten similar pairs
        sets[1000 + k] = set(list(sets[k])[:19]) | {rng.randrange(2 ** 62)}
    rows = spark.createDataFrame([(k, k, len(v), x) for k, v in sets.items() for x in v], "node long, comp long, n int, s long")
    found = {(r.a, r.b) for r in pairs_apart(rows, 80).collect()}
    similar = {(a, b) for a in sets for b in sets if a < b
               and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(similar) >= 10 and similar <= found
    assert len(found) <= 20 * len(similar)


def test_separators_inside_a_line_are_characters(spark):
    """A shingle goes on behind U+2028 and U+0085, which do not end a line."""
    for sep in ("\u2028", "\u0085"):
        df = spark.createDataFrame([(1, f"x{sep}oneside"), (2, f"x{sep}another")], "doc_id long, text string")
        assert [r[2] for r in run(df)] == [0, 0]


def test_lines_meet_the_bit_filter_before_they_are_shuffled(spark, monkeypatch):
    """A left semi join was moved below the filter, so every line was shuffled."""
    plans, stage = [], O.stage
    monkeypatch.setattr(O, "stage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stage(df))
    df = spark.createDataFrame([(1, LINE), (2, LINE.replace("lazy", "lame"))], "doc_id long, text string")
    assert [r[2] for r in run(df)] == [0, 1]
    assert any("_bits" in p for p in plans) and not any("LeftSemi" in p for p in plans)


def test_links_are_contracted_once(spark, monkeypatch):
    """Further stars around members of open buckets contracted all links anew each time."""
    calls, components = [], O.components
    monkeypatch.setattr(O, "components", lambda links: calls.append(1) or components(links))
    import random
    rng = random.Random(4)
    words = [f"{w}{k}" for k, w in enumerate(LINE.split() * 3)]
    rows = [(i, " ".join(f"other{i}" + w if rng.random() < 0.12 else w for w in words)) for i in range(40)]
    assert len(run(spark.createDataFrame(rows, "doc_id long, text string"))) == 40
    assert len(calls) == 1
