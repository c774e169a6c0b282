"""Quality rules with risk-controlled thresholds.

Base rules reject what is too short or repeats itself.  The other cutoffs are
not guessed: a labelled holdout (documents with a quality label) decides, per
stratum (language) and rule, which cutoffs of a fixed grid reject clean
documents rarely enough.  A cutoff is certified when the exact binomial test
refutes a false-rejection rate above the rule's share of ``alpha`` at level
``delta`` divided by the number of tests (all strata, rules and cutoffs).
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_PATTERN, stage, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
WINDOW = 5
REPEAT_PERCENT = 20

ALPHA = 0.02      # bound on the share of clean documents rejected, per stratum
DELTA = 0.05      # chance that any bound of the whole table is wrong
GOOD_COST = 10    # a cutoff must reject 10 bad holdout documents per clean one
MAX_STRATA = 10_000

#: rule -> (metric, cutoffs from strict to lax); rejected when metric > cutoff.
RULES = {
    "symbols": ("symbol_share", (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2)),
    "lines": ("dup_line_share", (0.1, 0.2, 0.3, 0.5)),
    "long_words": ("mean_word_chars", (6.0, 7.0, 8.0, 10.0, 15.0)),
}
RULE_ALPHA = ALPHA / len(RULES)


def features(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words`` (long), counted over the whole text (null: none).

    Repeated windows are found inside the row: the 5-word windows are hashed
    with their position, sorted, and equal neighbours give the positions to
    cover.  No shuffle, and the cost grows with the text (n log n).
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1),
                     lambda s: F.length(F.regexp_replace(s, SPACE_CLASS, "")) > 0)
    base = (docs.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(1)))
            .withColumn("_lines", lines))
    window = F.transform(
        F.when(F.size("_words") >= WINDOW, F.sequence(F.lit(0), F.size("_words") - WINDOW))
        .otherwise(F.expr("cast(array() as array<int>)")),
        lambda i: F.struct(F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]).alias("h"),
                           i.alias("i")))
    # each array is read several times below, so Catalyst keeps it a column of its own
    ordered = base.withColumn("_win", F.sort_array(window))
    again = F.sort_array(F.transform(F.filter("_win", lambda x, i: F.coalesce(
        (F.get("_win", i - 1)["h"] == x["h"]) | (F.get("_win", i + 1)["h"] == x["h"]),
        F.get("_win", i - 1)["h"] == x["h"], F.get("_win", i + 1)["h"] == x["h"],
        F.lit(False))), lambda x: x["i"]))
    covered = ordered.withColumn("_again", again)
    repeat = F.aggregate(F.transform("_again", lambda x, j: F.least(
        F.lit(WINDOW), F.coalesce(F.get("_again", j + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return (covered.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.regexp_replace(text, SPACE_CLASS, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, "")))
        .cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeat,
        "_n_lines": F.size("_lines").cast("long")})
        .drop("_words", "_lines", "_win", "_again"))


def _metrics() -> dict[str, Column]:
    def share(a, b):
        return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))
    return {"symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "_n_lines"),
            "mean_word_chars": share("word_chars", "n_words")}


def scored(docs: DataFrame) -> DataFrame:
    """Features, the base verdict, the metrics and the stratum (language)."""
    out = features(docs)
    failed = (F.col("n_words") < MIN_WORDS) | \
        (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return (out.withColumn("base_failed", failed).withColumns(_metrics())
            .withColumn("_stratum", F.coalesce("lang", F.lit(""))))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact up to double rounding.

    The term at ``k`` comes from logarithms, the smaller ones from its ratios.
    At ``k >= n * p`` the value cannot fall under any level in use: 1 is given.
    """
    log_choose = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k))
        .otherwise(F.expr("cast(array() as array<bigint>)")),
        F.lit(0.0), lambda a, j: a + F.log((n - k + j).cast("double") / j.cast("double")))
    top = F.exp(log_choose + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1.0 - p)))
    odds = (1.0 - p) / p
    tail = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k))
        .otherwise(F.expr("cast(array() as array<bigint>)")),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, j: F.struct(
            (a["t"] * (k - j + 1) / (n - k + j) * odds).alias("t"),
            (a["s"] + a["t"] * (k - j + 1) / (n - k + j) * odds).alias("s")))["s"]
    return F.when(k >= n * p, F.lit(1.0)).otherwise(top * tail)


def thresholds(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``(_stratum, <rule>...)``: the certified cutoff per stratum and rule.

    ``rows`` needs doc_id, base_failed, the metrics and the stratum; ``labels``
    (doc_id, quality).  A document is clean when all its labels say quality 1
    and bad when any says 0; null labels and ids are ignored.  Only documents
    that pass the base rules take part.  Among the certified cutoffs of a rule
    the one with the largest ``bad - GOOD_COST * clean`` rejections is taken if
    that is positive, the laxest on ties; else the rule is off (null).
    """
    truth = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
             .groupBy("doc_id").agg((F.min("quality") >= 1).alias("good")))
    held = (rows.where(F.col("doc_id").isNotNull() & ~F.col("base_failed"))
            .select("doc_id", "_stratum", *[m for m, _ in RULES.values()])
            .join(truth, "doc_id"))
    sums = [F.count_if(F.col("good")).alias("n")]
    for rule, (metric, cuts) in RULES.items():
        for j, c in enumerate(cuts):
            hit = F.col(metric) > c
            sums += [F.count_if(hit & F.col("good")).alias(f"g_{rule}_{j}"),
                     F.count_if(hit & ~F.col("good")).alias(f"b_{rule}_{j}")]
    counts = stage(held.groupBy("_stratum").agg(*sums))
    strata = counts.where(F.col("n") > 0).count()
    tests = max(1, strata) * sum(len(c) for _, c in RULES.values())
    out = [F.col("_stratum")]
    for rule, (_, cuts) in RULES.items():
        options = []
        for j, c in enumerate(cuts):
            g, b = F.col(f"g_{rule}_{j}"), F.col(f"b_{rule}_{j}")
            gain = b - GOOD_COST * g
            ok = (F.col("n") > 0) & (gain > 0) & \
                (binomial_cdf(g, F.col("n"), RULE_ALPHA) <= DELTA / tests)
            options.append(F.when(ok, F.struct(gain.alias("gain"), F.lit(c).alias("cut"))))
        out.append(F.array_max(F.array_compact(F.array(*options)))["cut"].alias(f"_cut_{rule}"))
    return counts.select(*out)


def judge(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``kept``: false when a base rule or a certified cutoff rejects."""
    small = stage(cuts)
    if small.count() <= MAX_STRATA:      # the bound of the broadcast
        small = F.broadcast(small)
    over = F.lit(False)
    for rule, (metric, _) in RULES.items():
        over = over | F.coalesce(F.col(metric) > F.col(f"_cut_{rule}"), F.lit(False))
    return (rows.join(small, "_stratum", "left").withColumn("kept", ~(F.col("base_failed") | over))
            .drop("_stratum", *[f"_cut_{r}" for r in RULES]))


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: the counts, ``base_failed`` and ``kept``.

    Shape: one pass over the texts writes a narrow feature table; the labelled
    part of it is joined to the labels on doc_id, counted by partial
    aggregates (one row per stratum), and the cutoffs are joined back by
    broadcast (checked: at most 10,000 strata).  A hot language or source is
    never gathered.

    Edge cases: a null or empty text has no words and fails the base rules; a
    null language is the stratum ''; a stratum without enough clean labels to
    certify anything keeps all that passes the base rules; repeated rows are
    judged alike; empty tables give an empty result or, without labels, the
    base verdict; extra columns of ``docs`` do not take part.
    """
    rows = stage(scored(docs.select("doc_id", "text", "lang")).drop("text", "lang"))
    return judge(rows, thresholds(rows, labels))


def op6_quality(spark, sf_dir) -> DataFrame:
    out = quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept")


def _choice_sql(rule: str) -> str:
    metric, cuts = RULES[rule]
    rows = ", ".join(f"({c}::DOUBLE)" for c in cuts)
    return f"""
  SELECT lang, '{rule}' AS rule, cut, n,
         count(*) FILTER (WHERE {metric} > cut AND good) AS g,
         count(*) FILTER (WHERE {metric} > cut AND NOT good) AS b
  FROM held JOIN (SELECT lang, count(*) FILTER (WHERE good) AS n FROM held GROUP BY lang) USING (lang),
       (VALUES {rows}) AS v(cut)
  GROUP BY lang, cut, n"""


_TESTS = sum(len(c) for _, c in RULES.values())
_P = RULE_ALPHA
SQL = f"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
win AS (
  SELECT rid, i, words[i:i+4] AS gram
  FROM w, LATERAL (SELECT unnest(range(1, len(words) - 3)) AS i) t WHERE len(words) >= 5),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM win),
rep AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, (SELECT unnest(range(0, 5)) AS k) o WHERE c > 1 GROUP BY rid),
f AS (
  SELECT w.rid, doc_id, lang, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid)),
m AS (
  SELECT rid, doc_id, lang, n_words, word_chars, n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0.0 END AS symbol_share,
         CASE WHEN len(lines) > 0 THEN (len(lines) - len(list_distinct(lines)))::DOUBLE / len(lines)
              ELSE 0.0 END AS dup_line_share,
         CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0.0 END AS mean_word_chars
  FROM f),
held AS (
  SELECT m.*, good FROM m
  JOIN (SELECT doc_id, min(quality) >= 1 AS good FROM labels
        WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id) l USING (doc_id)
  WHERE NOT base_failed),
tests AS (
  SELECT greatest(1, count(*)) * {_TESTS} AS t
  FROM (SELECT lang FROM held GROUP BY lang HAVING count(*) FILTER (WHERE good) > 0)),
options AS ({" UNION ALL ".join(_choice_sql(r) for r in RULES)}),
judged AS (
  SELECT *, CASE WHEN g >= n * {_P!r}::DOUBLE THEN 1.0 ELSE
      exp(coalesce(list_sum(list_transform(range(1, g + 1),
              lambda j: ln((n - g + j)::DOUBLE / j))), 0.0)
          + g * ln({_P!r}::DOUBLE) + (n - g) * ln(1.0 - {_P!r}::DOUBLE))
      * list_sum(list_transform(range(0, g + 1), lambda i: exp(coalesce(list_sum(list_transform(
              range(1, i + 1), lambda j: ln((g - j + 1)::DOUBLE / (n - g + j)
                                     * (1.0 - {_P!r}::DOUBLE) / {_P!r}::DOUBLE))), 0.0)))) END AS cdf
  FROM options),
chosen AS (
  SELECT lang, rule, max_by(cut, (b - {GOOD_COST} * g, cut)) AS cut
  FROM judged, tests
  WHERE n > 0 AND b - {GOOD_COST} * g > 0 AND cdf <= {DELTA} / t GROUP BY lang, rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR symbol_share > coalesce((SELECT cut FROM chosen c WHERE c.lang = m.lang AND rule = 'symbols'), 1e300)
    OR dup_line_share > coalesce((SELECT cut FROM chosen c WHERE c.lang = m.lang AND rule = 'lines'), 1e300)
    OR mean_word_chars > coalesce((SELECT cut FROM chosen c WHERE c.lang = m.lang AND rule = 'long_words'), 1e300))
    AS kept
FROM m
"""
