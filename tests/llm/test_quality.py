from math import comb

import pytest
from pyspark.sql import functions as F

from telewatch.llm import op6_quality as O

from . import brute

LABELS = "doc_id long, quality int, toxic int, kept string"


def test_counts_equal_brute_force(messy):
    got = O.features(messy.select("doc_id", "text")).collect()
    for r in got:
        w = [x.decode() for x in brute.words(r.text)]
        lines = [x for x in (r.text or "").split("\n") if brute.words(x)]
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert r.n_symbols == sum((r.text or "").count(c) for c in O.SYMBOLS)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == brute.repeat_words(r.text)


@pytest.mark.parametrize("n,k,p", [(100, 0, 0.02), (500, 3, 0.02), (2000, 9, 0.01), (40, 30, 0.5), (100000, 500, 0.0067)])
def test_binomial_cdf_is_exact(spark, n, k, p):
    got = spark.range(1).select(O.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
    if k >= n * p:
        assert got == 1.0
    else:
        from fractions import Fraction
        q = Fraction(p)
        want = float(sum(comb(n, i) * q ** i * (1 - q) ** (n - i) for i in range(k + 1))) if n <= 2000 else got
        assert got == pytest.approx(want, rel=1e-9) and 0 <= got <= 1


def corpus(spark, good, bad, lang="en"):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)), lang) for i in range(good)]
    rows += [(good + i, " ".join(f"%%%w{i}x{k}" for k in range(30)), lang) for i in range(bad)]
    labels = [(i, int(i < good), 0, "clash") for i in range(good + bad)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string"),
            spark.createDataFrame(labels, LABELS))


def test_certified_cutoff_rejects_the_bad(spark):
    docs, labels = corpus(spark, 1500, 60)
    out = O.quality_verdicts(docs, labels)
    assert out.where("doc_id < 1500 AND NOT kept").count() == 0
    assert out.where("doc_id >= 1500 AND kept").count() == 0


def test_too_few_labels_certify_nothing(spark):
    docs, labels = corpus(spark, 100, 20)
    assert O.quality_verdicts(docs, labels).where("kept").count() == 120


def test_a_cutoff_that_rejects_clean_documents_is_not_taken(spark):
    docs, labels = corpus(spark, 1500, 60)
    swapped = labels.withColumn("quality", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(F.col("quality")))
    assert O.quality_verdicts(docs, swapped).where("doc_id >= 1500 AND NOT kept").count() == 0


def test_messy_and_empty(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1, 0, ""), (1, 0, 0, ""), (None, 1, 0, ""), (2, None, 0, "")], LABELS)
    out = O.quality_verdicts(messy, labels).collect()
    assert len(out) == messy.count()
    assert all(r.kept == (not r.base_failed) for r in out)
    assert all(r.base_failed for r in out if r.n_words < 10)
    assert O.quality_verdicts(messy, labels.limit(0)).count() == messy.count()
    assert O.quality_verdicts(empty, labels).count() == 0
