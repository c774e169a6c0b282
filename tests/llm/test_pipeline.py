"""The pipeline against plain Python versions of its stages."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as C
from telewatch.llm import catalog, op8_lines, op9_mixing

from . import brute
from .conftest import SF001
from .test_packing import check_packing, expected_pieces

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Output of every stage, each fed with what the one before it kept."""
    out, docs = {}, spark.read.parquet(f"{SF001}/documents.parquet")
    for name, apply in C.STAGES:
        docs = apply(spark, docs, SF001)
        if name != "packing":
            docs = C.stage(docs)
        out[name] = docs
    return out


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stage_order_and_columns(stages):
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    assert all(df.columns == DOCUMENTS for name, df in stages.items() if name != "packing")


def test_quality_stage(spark, stages):
    kept = {r.doc_id for r in catalog.QUERIES["op6_quality"](spark, SF001).where("kept").collect()}
    assert {i for i, _ in pairs(stages["quality_rules"])} == kept


def line_key(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ")


def test_line_stage_equals_brute_force(spark, stages):
    """Every pair of lines compared exactly; documents left without a word go."""
    rows = pairs(stages["quality_rules"])
    place, texts = {}, {}                              # key of a line: first place, and its shingles below
    for i, t in rows:
        texts[i] = t.split("\n")
        for k, line in enumerate(texts[i]):
            key = line_key(line)
            if key:
                place[key] = min(place.get(key, (i, k)), (i, k))
    lines = spark.createDataFrame([(key,) for key in place], "line string")
    sets = {r.line: frozenset(r.sh) for r in
            lines.select("line", op8_lines.shingles(op8_lines.line_key(F.col("line"))).alias("sh")).collect()}
    holders = {}
    for key, sh in sets.items():
        for x in sh:
            holders.setdefault(x, []).append(key)
    links = set()
    for key, sh in sets.items():
        for other in {o for x in sh for o in holders[x] if o < key}:
            both = len(sh & sets[other])
            if 100 * both >= op8_lines.PERCENT * (len(sh) + len(sets[other]) - both):
                links.add((other, key))
    group = brute.components(sets, links)
    first = {}
    for key, g in group.items():
        first[g] = min(first.get(g, place[key]), place[key])
    want = []
    for i, t in texts.items():
        kept = [line for k, line in enumerate(t)
                if not line_key(line) or first[group[line_key(line)]] == (i, k)]
        if any(line_key(line) for line in kept):
            want.append((i, "\n".join(kept)))
    assert pairs(stages["line_dedup"]) == sorted(want) and len(want) < len(rows)


def test_emptied_documents_go_and_equal_ids_are_repeatable(spark):
    text = "one line of twelve words that is repeated in another document of this table"
    rows = [(1, text, "en", "a", 5), (2, text + "\n\n", "en", "b", 5), (3, None, "en", "a", None),
            (4, "  \n", "fr", "a", 3), (5, "another text of its own", "en", "c", 1), (5, "another text of its own", "de", "b", 2),
            (5, "another text of its own", None, "z", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = C.stage(C.line_dedup(spark, docs, SF001))
    assert {r.doc_id for r in out.collect()} == {1, 3, 4, 5}
    for n in (1, 3):
        near = C.near_dedup(spark, out.repartition(n), SF001).where("doc_id = 5").collect()
        assert [(r.lang, r.source, r.n_chars) for r in near] == [(None, "z", 23)]


def test_near_stage_keeps_one_of_each_group(stages):
    rows = pairs(stages["line_dedup"])
    comp = brute.near_duplicates(rows)
    assert pairs(stages["near_dedup"]) == [(i, t) for i, t in rows if comp[i] == i]


def test_mixing_stage(stages):
    con = duckdb.connect()
    documents = stages["near_dedup"].toPandas()  # noqa: F841  (read by DuckDB)
    want = con.execute(op9_mixing.SQL).df()
    assert pairs(stages["mixing"]) == sorted(zip(want.doc_id, want.text, strict=True))


def test_packing_stage(stages):
    got = stages["packing"].collect()
    rows = pairs(stages["mixing"])
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=repr) == expected_pieces(rows)
    check_packing(got)


def test_messy_rows_pass_through(spark, messy, empty):
    for docs in (messy, empty):
        for name, apply in C.STAGES[:-1]:
            docs = C.stage(apply(spark, docs, SF001))
        C.STAGES[-1][1](spark, docs, SF001).count()


def test_registered(spark):
    names = set(E.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert E.queries()["pipeline"](spark, SF001).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_duckdb(spark, name):
    from tests.test_oracle import rows
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    got = E.queries()[name](spark, SF001).toPandas()
    assert rows(got) == rows(con.execute(catalog.ORACLE_SQL[name]).df())
