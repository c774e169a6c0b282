"""Mixing sources to target weights by Poisson replication.

Every document of a source is repeated ``k`` times, ``k`` drawn from a Poisson
distribution whose mean is the source's target repetition rate; the copies are
then shuffled globally.  The draw inverts the distribution at a uniform number
made from a seeded hash of the row, so a retried task draws the same counts.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

MAX_TARGETS = 10_000        # proven bound of the broadcast rate table
OTHER = "\u0000other"       # group of the sources that have no target of their own


def _group(targets: dict[str, float]) -> Column:
    """The source itself when it has a target, else the group of the others."""
    source = F.coalesce(F.col("source"), F.lit(""))
    return F.when(source.isin(list(targets)), source).otherwise(F.lit(OTHER))


def repetition_rates(docs: DataFrame, targets: dict[str, float]) -> DataFrame:
    """``(grp, rate, cdf)``: one row per target plus one for the other sources.

    ``rate`` is target share x total characters / characters of the group, so
    the expected output has as many characters as the input, at the target
    shares.  Sources without a target share what the targets leave, at one
    common rate.  ``cdf[k]`` is P(count <= k), summed in log space, long enough
    that the rest is below the resolution of the uniform numbers.
    """
    if len(targets) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target weights")
    if any(w < 0 for w in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("target weights must be >= 0 and sum to at most 1")
    rest = max(0.0, 1.0 - sum(targets.values()))
    weight = F.lit(rest)
    for name, w in targets.items():
        weight = F.when(F.col("grp") == name, F.lit(float(w))).otherwise(weight)
    size = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    by = docs.groupBy(_group(targets).alias("grp")).agg(F.sum(size).alias("chars"))
    every = Window.partitionBy()                        # at most 10,001 rows
    rates = by.withColumn("total", F.sum("chars").over(every)).select(
        "grp", F.when(F.col("chars") > 0, weight * F.col("total") / F.col("chars"))
        .otherwise(F.lit(1.0)).alias("rate"))
    steps = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    start = F.struct((-F.col("rate")).alias("logp"), F.exp(-F.col("rate")).alias("cum"),
                     F.array(F.exp(-F.col("rate"))).alias("cdf"))

    def step(acc, k):
        logp = acc["logp"] + F.log(F.col("rate")) - F.log(k.cast("double"))
        cum = acc["cum"] + F.exp(logp)
        return F.struct(logp.alias("logp"), cum.alias("cum"),
                        F.concat(acc["cdf"], F.array(cum)).alias("cdf"))
    cdf = F.aggregate(F.sequence(F.lit(1), steps), start, step)["cdf"]
    return rates.select("grp", "rate", F.when(F.col("rate") > 0, cdf)
                        .otherwise(F.array(F.lit(1.0))).alias("cdf"))


def mix_sources(docs: DataFrame, targets: dict[str, float], seed: str = "mix") -> DataFrame:
    """Replicate and shuffle ``docs(doc_id, text, source, ...)`` to ``targets``.

    Adds ``mix_copy`` (0-based), ``mix_copies`` (count drawn for the row) and
    ``mix_key`` (hex; the output is globally ordered by it, a random order).

    Shape: one pass for the character totals per group (partial aggregates; a
    hot source is one buffer per task), a broadcast of at most 10,001 rates,
    then one range exchange by a hash key.  Documents are never grouped by
    source, so a source with a third of all rows is spread evenly.

    Edge cases: a null source counts as source ''; a null text has size 0 and
    is drawn like any row; rows that are equal in every column draw equal
    counts; an empty table gives an empty result; a group without characters
    keeps rate 1; extra columns are kept (the three names above and names
    starting with ``_mix`` are replaced).
    """
    rates = repetition_rates(docs, targets).select(
        F.col("grp").alias("_mix_grp"), F.col("cdf").alias("_mix_cdf"))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                            F.coalesce(F.col("source"), F.lit("")),
                            F.coalesce(F.col("text"), F.lit(""))))
    u = F.conv(F.substring("_mix_row", 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    drawn = (docs.drop("mix_copy", "mix_copies", "mix_key")
             .withColumn("_mix_row", key).withColumn("_mix_grp", _group(targets))
             .join(F.broadcast(rates), "_mix_grp")
             .withColumn("mix_copies", F.size(F.filter("_mix_cdf", lambda c: c <= u)))
             .where(F.col("mix_copies") > 0)
             .withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
             .withColumn("mix_key", F.md5(F.concat_ws("|", F.col("_mix_row"),
                                                      F.col("mix_copy").cast("string"))))
             # equal rows have equal keys: the row position splits such a run over ranges
             .withColumn("_mix_tie", F.monotonically_increasing_id()))
    return (drawn.orderBy("mix_key", "_mix_tie")
            .drop("_mix_row", "_mix_grp", "_mix_cdf", "_mix_tie"))


#: Production targets: the crawl source down to a sixth, one curated source up.
TARGETS = {"src0": 0.16, "src1": 0.12, "src2": 0.08}


def op9_mixing(spark, sf_dir) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"), TARGETS)
    return out.select("doc_id", "source", "mix_copy", "mix_copies", "mix_key", "text")


SQL = """
WITH RECURSIVE tot AS (
  SELECT CASE WHEN coalesce(source, '') IN ('src0','src1','src2') THEN source ELSE '*' END AS grp,
         sum(coalesce(length(text), 0)) AS chars
  FROM documents GROUP BY 1),
rates AS (
  SELECT grp, CASE WHEN chars > 0 THEN
           CASE grp WHEN 'src0' THEN 0.16::DOUBLE WHEN 'src1' THEN 0.12::DOUBLE
                    WHEN 'src2' THEN 0.08::DOUBLE
                    ELSE 1.0::DOUBLE - (0.16::DOUBLE + 0.12::DOUBLE + 0.08::DOUBLE) END
           * (SELECT sum(chars) FROM tot)::DOUBLE / chars::DOUBLE ELSE 1.0 END AS rate
  FROM tot),
pois(grp, rate, k, logp, cum) AS (
  SELECT grp, rate, 0, -rate, exp(-rate) FROM rates
  UNION ALL
  SELECT grp, rate, k + 1, logp + ln(rate) - ln((k + 1)::DOUBLE),
         cum + exp(logp + ln(rate) - ln((k + 1)::DOUBLE))
  FROM pois WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
keyed AS (
  SELECT doc_id, source, text,
         CASE WHEN coalesce(source, '') IN ('src0','src1','src2') THEN source ELSE '*' END AS grp,
         md5('mix' || '|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(source, '')
             || '|' || coalesce(text, '')) AS rowkey
  FROM documents),
drawn AS (
  SELECT doc_id, source, text, rowkey,
         (SELECT count(*) FROM pois WHERE pois.grp = keyed.grp
          AND cum <= ('0x' || substr(rowkey, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)::INTEGER
           AS mix_copies
  FROM keyed)
SELECT doc_id, source, c.mix_copy::INTEGER AS mix_copy, mix_copies,
       md5(rowkey || '|' || c.mix_copy::VARCHAR) AS mix_key, text
FROM drawn, LATERAL (SELECT unnest(range(0, mix_copies)) AS mix_copy) c
"""
