"""Preference formatting of conversations.

A chosen and a rejected conversation usually share their first turns.  The
longest common turn prefix is rendered once as the prompt; what follows it is
rendered as two completions, each with a mask that trains on assistant turns
only.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ordered_scan
from .common import table

END = "<|end|>\n"


def conversation_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation: ``turns``, an array of ``(turn, role, text)``
    in turn order (a null turn number first, ties by role, then text)."""
    turn = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(2 ** 63))).alias("turn"),
                    F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _header(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def render(turns: Column) -> Column:
    """Text of a list of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(END))), "")


def loss_mask(turns: Column) -> Column:
    """Run lengths ``flag:characters`` over the rendered text: headers and
    turns of other roles are masked (0), assistant text and its end are not."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit("0:"), F.char_length(_header(t)).cast("string"),
        F.when(t["role"] == "assistant", F.lit(",1:")).otherwise(F.lit(",0:")),
        F.char_length(F.concat(t["text"], F.lit(END))).cast("string"))), ",")


def _free(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many leading underscores as make them new to ``df``."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pairs`` with arrays of turns ``chosen`` and ``rejected`` gains

    ``prompt_turns`` (length of the longest common turn prefix; turns are equal
    when role and text are), ``prompt``, ``chosen_text``, ``chosen_mask``,
    ``rejected_text`` and ``rejected_mask``.  No shuffle: every pair is a row.

    Edge cases: null role or text counts as ''; conversations without a common
    turn have an empty prompt; when one is a prefix of the other (or both are
    equal) the shorter completion is empty with an empty mask; a null list of
    turns counts as empty; extra columns are kept whatever their names, except
    that columns named like the six results are replaced.
    """
    empty = F.expr("cast(array() as array<struct<turn:bigint,role:string,text:string>>)")
    c, r, p, cc, rc = _free(pairs, "c", "r", "p", "cc", "rc")
    base = pairs.withColumn(c, F.coalesce("chosen", empty)) \
                .withColumn(r, F.coalesce("rejected", empty))
    short = F.least(F.size(c), F.size(r))
    differ = F.filter(F.sequence(F.lit(0), short), lambda i: F.coalesce(
        (F.get(c, i)["role"] != F.get(r, i)["role"])
        | (F.get(c, i)["text"] != F.get(r, i)["text"]), F.lit(True)))
    base = base.withColumn("prompt_turns", F.least(F.get(differ, F.lit(0)), short))
    rest = {p: F.slice(c, F.lit(1), F.col("prompt_turns")),
            cc: F.slice(c, F.col("prompt_turns") + 1, F.size(c)),
            rc: F.slice(r, F.col("prompt_turns") + 1, F.size(r))}
    return (base.withColumns(rest)
            .withColumns({"prompt": render(F.col(p)),
                          "chosen_text": render(F.col(cc)), "chosen_mask": loss_mask(F.col(cc)),
                          "rejected_text": render(F.col(rc)),
                          "rejected_mask": loss_mask(F.col(rc))})
            .drop(c, r, p, cc, rc))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """Pairs ``(pair_id, kind, chosen, rejected)`` from ``(conv_id, turn, role, text)``.

    * ``opening``: conversations that share all turns up to the first user
      turn; the one with the smallest id is chosen, every other one is
      rejected against it (a star: the pairs grow with the conversations).
    * ``swap``: for the first of each opening, if it has an assistant turn, the
      conversation is chosen and the same conversation with its last assistant
      turn replaced by that of the one before it is rejected.  The one before it
      is the previous such conversation in the order of ids, of another opening
      then; the first of them takes the last one.  So every answered
      conversation is in a pair, whatever the ids, unless the table has one
      opening and no other conversation of it.

    The first of an opening is a partial minimum; the join back to it is an
    inner join that adaptive execution splits for a hot opening.  The order of
    ids is a segmented scan over the ids alone.  Rows with a null ``conv_id``
    belong to no conversation and give no pair.
    """
    conv = conversation_turns(turns.where(F.col("conv_id").isNotNull()))
    first_user = F.array_position(F.transform("turns", lambda t: t["role"]), "user")
    conv = (conv.withColumn("_u", first_user)
            .withColumn("_open", F.sha2(F.array_join(F.transform(
                F.when(F.col("_u") > 0, F.slice("turns", F.lit(1), F.col("_u").cast("int")))
                .otherwise(F.col("turns")),
                lambda t: F.concat(t["role"], F.lit("\u0001"), t["text"])), "\u0002"), 256))
            .drop("_u"))
    first = conv.groupBy("_open").agg(F.min("conv_id").alias("_first"))
    tagged = conv.join(first, "_open")
    heads = tagged.where(F.col("conv_id") == F.col("_first"))
    others = (tagged.where(F.col("conv_id") != F.col("_first"))
              .select(F.col("conv_id").alias("pair_id"), "_first", F.col("turns").alias("rejected")))
    opening = (others.join(heads.select("_first", F.col("turns").alias("chosen")), "_first")
               .select("pair_id", F.lit("opening").alias("kind"), "chosen", "rejected"))
    answers = F.filter("turns", lambda t: t["role"] == "assistant")
    last = F.try_element_at(answers, F.lit(-1))
    ids = ordered_scan(heads.where(F.size(answers) > 0).select("conv_id"), [], ["conv_id"],
                       lags={"_lender": "conv_id"})
    end = ids.agg(F.max("conv_id")).first()[0]
    lender = (ids.withColumn("_lender", F.coalesce("_lender", F.lit(end)))
              .where(F.col("_lender") != F.col("conv_id"))
              .select(F.col("conv_id").alias("pair_id"), "_lender"))
    lend = (heads.select(F.col("conv_id").alias("_lender"), last.alias("_a"))
            .join(lender, "_lender").select("pair_id", "_a"))
    swap = (heads.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"))
            .join(lend, "pair_id")
            .withColumn("_at", F.array_max(F.filter(
                F.sequence(F.lit(1), F.size("chosen")),
                lambda i: F.element_at("chosen", i)["role"] == "assistant")))
            .select("pair_id", F.lit("swap").alias("kind"), "chosen",
                    F.concat(F.slice("chosen", F.lit(1), F.col("_at") - 1), F.array("_a"))
                    .alias("rejected")))
    return opening.unionByName(swap)


def op10_chat(spark, sf_dir) -> DataFrame:
    pairs = preference_pairs(table(spark, sf_dir, "conversations"))
    return format_preferences(pairs).select(
        "pair_id", "kind", "prompt_turns", "prompt", "chosen_text", "chosen_mask",
        "rejected_text", "rejected_mask")


def _render_sql(turns: str) -> str:
    return (f"array_to_string(list_transform({turns}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text"
            " || '<|end|>' || chr(10)), '')")


def _mask_sql(turns: str) -> str:
    return (f"array_to_string(list_transform({turns}, lambda t: '0:' || (length(t.role) + 5)::VARCHAR ||"
            " CASE WHEN t.role = 'assistant' THEN ',1:' ELSE ',0:' END ||"
            " (length(t.text) + 8)::VARCHAR), ',')")


SQL = f"""
WITH conv AS (
  SELECT conv_id, list({{'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')}}
                       ORDER BY turn, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
opened AS (
  SELECT conv_id, turns, array_to_string(list_transform(
           CASE WHEN list_position(list_transform(turns, lambda t: t.role), 'user') > 0
                THEN turns[1:list_position(list_transform(turns, lambda t: t.role), 'user')]
                ELSE turns END, lambda t: t.role || chr(1) || t.text), chr(2)) AS opening,
         list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS answers
  FROM conv),
tagged AS (SELECT *, min(conv_id) OVER (PARTITION BY opening) AS head FROM opened),
answered AS (
  SELECT conv_id, turns, answers,
         coalesce(lag(conv_id) OVER (ORDER BY conv_id), max(conv_id) OVER ()) AS lender
  FROM tagged WHERE conv_id = head AND len(answers) > 0),
pairs AS (
  SELECT r.conv_id AS pair_id, 'opening' AS kind, c.turns AS chosen, r.turns AS rejected
  FROM tagged r JOIN tagged c ON c.conv_id = r.head WHERE r.conv_id <> r.head
  UNION ALL
  SELECT c.conv_id, 'swap', c.turns,
         list_concat(c.turns[1:c.answers[-1] - 1], [n.turns[n.answers[-1]]])
  FROM answered c JOIN answered n ON n.conv_id = c.lender WHERE c.lender <> c.conv_id),
cut AS (
  SELECT *, len(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda i:
              len(list_filter(range(1, i + 1), lambda j: chosen[j].role <> rejected[j].role
                                               OR chosen[j].text <> rejected[j].text)) = 0))
            ::INTEGER AS prompt_turns
  FROM pairs)
SELECT pair_id, kind, prompt_turns, {_render_sql('chosen[1:prompt_turns]')} AS prompt,
  {_render_sql('chosen[prompt_turns + 1:len(chosen)]')} AS chosen_text,
  {_mask_sql('chosen[prompt_turns + 1:len(chosen)]')} AS chosen_mask,
  {_render_sql('rejected[prompt_turns + 1:len(rejected)]')} AS rejected_text,
  {_mask_sql('rejected[prompt_turns + 1:len(rejected)]')} AS rejected_mask
FROM cut
"""
