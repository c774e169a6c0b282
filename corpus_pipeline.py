"""The corpus pipeline: documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept; all but the last return the columns of ``documents``.
``run`` writes each stage as Parquet to the shared folder named by
``spark.checkpoint.dir`` and rereads it, so a lost executor repeats one stage
at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telewatch.llm import (op2_packing, op4_near_dups, op6_quality, op8_lines, op9_mixing)
from telewatch.llm.common import WORD_PATTERN, stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go."""
    rows = stage(op6_quality.scored(docs.select(COLUMNS)))
    cuts = op6_quality.thresholds(rows, table(spark, sf_dir, "labels"))
    return op6_quality.judge(rows, cuts).where("kept").select(COLUMNS)


def line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines one stays; ``n_chars`` follows the text.  A document that
    lost its last line with a word goes: its text is all in others.  One that
    had no word before stays as it is."""
    out = op8_lines.dedup_lines(docs.select(COLUMNS))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(WORD_PATTERN)
    return (out.where(~F.coalesce(emptied, F.lit(False)))
            .withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS))


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays.  Rows equal in id and
    text count as one; theirs is the smallest (lang, source, n_chars), nulls
    first.  Rows without an id are in no group and stay."""
    docs = docs.select(COLUMNS)
    found = op4_near_dups.near_duplicates(docs)
    kept = found.where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = (docs.join(kept, "doc_id", "left_semi").groupBy("doc_id", "text")
             .agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest")))
    return (named.select("doc_id", "text", "rest.*").select(COLUMNS)
            .unionByName(docs.where(F.col("doc_id").isNull())))


def mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeat by their drawn counts."""
    return op9_mixing.mix_sources(docs.select(COLUMNS), op9_mixing.TARGETS).select(COLUMNS)


def packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in the training sequences."""
    return op2_packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: MinHash, the union-find and the tokenizer have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
