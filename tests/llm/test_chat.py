import duckdb
import pytest

from telewatch.llm import op10_chat as O

from .conftest import SF001

SCHEMA = "conv_id long, turn long, role string, text string, kind int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)


def test_common_prefix_is_rendered_once(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "Q"), (1, 2, "assistant", "good"),
            (4, 0, "system", "S"), (4, 1, "user", "Q"), (4, 2, "assistant", "bad"), (4, 3, "user", "why")]
    out = O.format_preferences(O.preference_pairs(frame(spark, rows))).collect()
    assert [(r.pair_id, r.kind, r.prompt_turns) for r in out] == [(4, "opening", 2)]
    r = out[0]
    assert r.prompt == "<|system|>\nS<|end|>\n<|user|>\nQ<|end|>\n"
    assert r.chosen_text == "<|assistant|>\ngood<|end|>\n" and r.chosen_mask == "0:14,1:12"
    assert r.rejected_mask == "0:14,1:11,0:9,0:11"
    spans = [x.split(":") for x in r.rejected_mask.split(",")]
    assert sum(int(n) for _, n in spans) == len(r.rejected_text)


def test_swapped_answer_of_the_neighbour(spark):
    rows = [(2, 0, "user", "a"), (2, 1, "assistant", "x"), (3, 0, "user", "b"), (3, 1, "assistant", "y")]
    out = {r.pair_id: r for r in O.format_preferences(O.preference_pairs(frame(spark, rows))).collect()}
    assert set(out) == {2, 3} and out[2].kind == "swap" and out[2].prompt_turns == 1
    assert "x" in out[2].chosen_text and "y" in out[2].rejected_text


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (None, 0, "user", "x"),
            (0, 0, "assistant", ""), (5, 3, "user", "q" * 100_000)]
    out = O.format_preferences(O.preference_pairs(frame(spark, rows))).collect()
    assert all(r.pair_id is not None for r in out)
    assert O.preference_pairs(frame(spark, [])).count() == 0


def test_pairs_of_the_operator(spark):
    t = "array<struct<turn:bigint,role:string,text:string>>"
    a = [(0, "user", "q"), (1, "assistant", "r")]
    df = spark.createDataFrame([(1, a, a), (2, a, a[:1]), (3, a, None), (4, None, None)],
                               f"pair_id long, chosen {t}, rejected {t}")
    got = {r.pair_id: (r.prompt_turns, r.chosen_text, r.rejected_text) for r in O.format_preferences(df).collect()}
    answer = "<|assistant|>\nr<|end|>\n"
    assert got == {1: (2, "", ""), 2: (1, answer, ""), 3: (0, "<|user|>\nq<|end|>\n" + answer, ""), 4: (0, "", "")}


def test_every_answered_conversation_is_in_a_pair_whatever_the_ids(spark):
    conversations = spark.read.parquet(f"{SF001}/conversations.parquet")
    answered = {r.conv_id for r in conversations.where("role = 'assistant' AND conv_id IS NOT NULL").collect()}
    results = {}
    for factor, shift in ((1, 0), (10, 0), (1_000_003, 7)):
        turns = conversations.selectExpr(f"conv_id * {factor} + {shift} AS conv_id", "turn", "role", "text")
        rows = O.format_preferences(O.preference_pairs(turns)).collect()
        results[factor] = sorted(((r.pair_id - shift) // factor, r.kind, r.prompt_turns, r.prompt, r.chosen_text,
                                  r.chosen_mask, r.rejected_text, r.rejected_mask) for r in rows)
        heads = {i for i in answered if any(r[0] == i and r[1] == "swap" for r in results[factor])}
        others = {r[0] for r in results[factor] if r[1] == "opening"}
        assert answered <= heads | others
    assert results[1] == results[10] == results[1_000_003]


def brute_swaps(rows):
    """(pair_id, lender) by a plain loop over the table."""
    conv = {}
    for i, t, role, text in rows:
        if i is not None:
            conv.setdefault(i, []).append((t, role or "", text or ""))
    heads = {}
    for i in sorted(conv):
        turns = sorted(conv[i])
        first = next((k for k, x in enumerate(turns) if x[1] == "user"), len(turns) - 1)
        heads.setdefault(tuple(x[1:] for x in turns[:first + 1]), i)
    asked = [i for i in sorted(heads.values()) if any(x[1] == "assistant" for x in conv[i])]
    return {(i, asked[k - 1]) for k, i in enumerate(asked) if len(asked) > 1}


@pytest.mark.parametrize("per_segment", ["2", "2000000"])
def test_lenders_equal_a_plain_loop_and_the_twin(spark, per_segment):
    rows = []
    for k in range(23):
        i = k * k * 7 - 50                             # sparse, negative, unlike gaps
        rows += [(i, 0, "user", f"q{k % 17}"), *([(i, 1, "assistant", f"a{i}")] if k % 5 else [])]
    rows += [(None, 1, "assistant", "none"), (3, 0, None, None)]
    spark.conf.set("telewatch.ordered.rowsPerSegment", per_segment)
    try:
        df = frame(spark, rows)
        got = O.format_preferences(O.preference_pairs(df)).select(
            "pair_id", "kind", "prompt_turns", "prompt", "chosen_text", "chosen_mask", "rejected_text",
            "rejected_mask").collect()
    finally:
        spark.conf.unset("telewatch.ordered.rowsPerSegment")
    swaps = {(r.pair_id, r.rejected_text) for r in got if r.kind == "swap"}
    assert swaps == {(i, f"<|assistant|>\na{j}<|end|>\n") for i, j in brute_swaps(rows)}
    con = duckdb.connect()
    conversations = df.toPandas()  # noqa: F841  (read by DuckDB)
    assert sorted(map(tuple, got)) == sorted(con.execute(O.SQL).fetchall())


def test_a_single_conversation_and_clashing_names(spark):
    assert O.preference_pairs(frame(spark, [(7, 0, "user", "q"), (7, 1, "assistant", "r")])).count() == 0
    t = "array<struct<turn:bigint,role:string,text:string>>"
    a = [(0, "user", "q"), (1, "assistant", "r")]
    df = spark.createDataFrame([(a, a[:1], 1, "x", 2.0, 3, 4)],
                               f"chosen {t}, rejected {t}, _c int, _R string, _p double, __cc int, prompt int")
    (r,) = O.format_preferences(df).collect()
    assert (r._c, r._R, r._p, r["__cc"]) == (1, "x", 2.0, 3)
    assert (r.prompt_turns, r.prompt, r.rejected_text) == (1, "<|user|>\nq<|end|>\n", "")
