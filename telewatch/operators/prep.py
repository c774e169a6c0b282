"""Training-set preparation (D1-D8): labelled scan, guard, ids, exact balancing.

Sampling is exact and reproducible: rows are ordered inside each label by a
seeded md5 of their id (no ``sample``/``randomSplit``, whose sizes vary and
which change with partitioning).  The N smallest are found by selection: a
histogram of the leading bits of the hash (partial aggregates) tells the bucket
the N-th row is in, and only the rows of that bucket are ranked.  A null label
is a label of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import global_row_number, ordered_scan, rows_per_segment

TARGET_PER_CLASS = 8366
SEED = 42
SELECT_BITS = 16             # leading bits of the hash in the histogram


def hash_rank_key(*parts: Column) -> Column:
    """Seeded 60-bit integer from md5 (DuckDB twin: ('0x'||substr(md5(s),1,15))::BIGINT)."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def assign_ids(df: DataFrame, order: list[str], name: str = "process_id") -> DataFrame:
    """Contiguous 1..n in the given order, without a one-partition window."""
    return global_row_number(df, order, name)


def distinct_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """D7."""
    return df.select(label).distinct()


def pick_smallest(df: DataFrame, wanted: Column, seed: int = SEED, label: str = "label",
                  id_col: str = "process_id", name: str = "_picked") -> DataFrame:
    """Adds ``name``: whether a row is among the ``wanted`` rows of its label with
    the smallest seeded hash (ties by id).

    ``wanted`` is an expression of ``_cnt``, the rows of the label.  The input is
    read three times (histogram, rows off the border bucket, rows in it); only
    rows of the border bucket, one in 2**``SELECT_BITS``, are shuffled.  One row
    per label goes to the driver.
    """
    keyed = df.withColumn("_h", hash_rank_key(F.col(id_col), F.lit(seed))).withColumn(
        "_b", F.shiftright("_h", 60 - SELECT_BITS).cast("int"))
    bars = keyed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bars = bars.withColumns({"_cnt": F.sum("_n").over(Window.partitionBy(label)),
                             "_before": F.coalesce(F.sum("_n").over(w), F.lit(0))})
    left = wanted - F.col("_before")
    cuts = bars.groupBy(label).agg(
        F.max(F.when(left > 0, F.struct(F.col("_b").alias("b"), left.alias("need")))).alias("cut")).collect()
    # one row per label: the bucket of its last row and how many that bucket gives
    border, need = F.lit(-1), F.lit(0)                     # nothing is wanted: no row is below
    for r in cuts:
        if r["cut"] is not None:
            mine = F.col(label).eqNullSafe(F.lit(r[label]))
            border = F.when(mine, r["cut"]["b"]).otherwise(border)
            need = F.when(mine, r["cut"]["need"]).otherwise(need)
    off = keyed.where(F.col("_b") != border).withColumn(name, F.col("_b") < border)
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h", id_col))
    on = keyed.where(F.col("_b") == border).withColumn(name, rank <= need)
    return off.unionByName(on).drop("_h", "_b")


def _is_one_of(label: str, names: list) -> Column:
    known = F.col(label).isin([n for n in names if n is not None])
    return F.coalesce(known, F.lit(False)) | (F.col(label).isNull() if None in names else F.lit(False))


def balance(df: DataFrame, n: int = TARGET_PER_CLASS, seed: int = SEED,
            label: str = "label", id_col: str = "process_id") -> DataFrame:
    """Exactly ``n`` rows per label.

    Labels with at least ``n`` rows keep the ``n`` rows with the smallest
    seeded hash (no repeats).  Smaller labels are drawn with replacement:
    slot ``s`` in 1..n takes the row ranked ``hash(label, s, seed) mod count + 1``.
    Slots are generated with ``spark.range`` (distributed) and matched by an
    equi-join on (label, rank); only these labels are ranked.
    """
    spark = df.sparkSession
    # one row per label (a handful): fetched once to plan the two branches
    counts = {r[label]: r["_cnt"] for r in
              df.groupBy(label).agg(F.count(F.lit(1)).alias("_cnt")).collect()}
    big = [k for k, c in counts.items() if c >= n]
    small = sorted((k for k, c in counts.items() if c < n), key=lambda k: (k is not None, k))
    without = pick_smallest(df.filter(_is_one_of(label, big)), F.lit(n), seed, label, id_col).filter("_picked").drop("_picked")
    if not small:
        return without

    few = df.filter(_is_one_of(label, small)).withColumn("_h", hash_rank_key(F.col(id_col), F.lit(seed)))
    if n <= rows_per_segment(df):                          # so has each of these labels: one task may rank it
        ranked = few.withColumn("_rank", F.row_number().over(Window.partitionBy(label).orderBy("_h", id_col)))
    else:
        ranked = ordered_scan(few, [label], ["_h", id_col], row_number="_rank")
    # slot s of small label i: row hash(label, s, seed) mod count + 1 of that label
    kind = df.schema[label].dataType
    names = F.array(*[F.lit(k).cast(kind) for k in small])
    sizes = F.array(*[F.lit(counts[k]) for k in small])
    slots = spark.range(0, n * len(small)).select(
        F.element_at(names, (F.col("id") / F.lit(n)).cast("int") + 1).alias("_label"),
        F.element_at(sizes, (F.col("id") / F.lit(n)).cast("int") + 1).alias("_cnt"),
        (F.col("id") % F.lit(n) + 1).alias("_slot"))
    picks = slots.select(
        "_label", (F.pmod(hash_rank_key(F.col("_label"), F.col("_slot"), F.lit(seed)), F.col("_cnt")) + 1)
        .alias("_place"))
    with_rep = ranked.join(picks, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_rank") == F.col("_place")))
    return without.unionByName(with_rep.drop("_h", "_rank", "_label", "_place"))


def audit(df: DataFrame, label: str = "label", file_col: str | None = "source_file",
          id_col: str = "process_id", columns: list[str] | None = None) -> DataFrame:
    """Rows per file and label with the id range, the total number of rows
    and the column list (one row per file and label)."""
    keys = [file_col, label] if file_col else [label]
    per = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(id_col).alias("min_id"), F.max(id_col).alias("max_id"))
    names = columns if columns is not None else df.columns
    total = F.sum("rows").over(Window.partitionBy())        # over the report, not the data
    return per.select("*", total.alias("total_rows"), F.array(*[F.lit(c) for c in names]).alias("columns"))


def stratified_split(df: DataFrame, train_fraction: float = 0.8, seed: int = SEED,
                     label: str = "label", id_col: str = "process_id") -> DataFrame:
    """M3: per label, the floor(fraction * count) rows with the smallest seeded
    hash go to train, the rest to test (column ``split``)."""
    wanted = F.floor(F.col("_cnt") * F.lit(train_fraction))
    return (pick_smallest(df, wanted, seed, label, id_col)
            .withColumn("split", F.when(F.col("_picked"), "train").otherwise("test")).drop("_picked"))


def label_index(df: DataFrame, label: str = "label", out: str = "label_idx") -> DataFrame:
    """M2: alphabetical label codes (High=0, Moderate=1, Normal=2)."""
    from pyspark.ml.feature import StringIndexer
    model = StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc").fit(df)
    return model.transform(df)


def standard_scale(df: DataFrame, features: list[str], split_col: str = "split",
                   fit_on: str = "train") -> DataFrame:
    """M4: centre and scale by population std fitted on the train rows only;
    a zero std divides by 1."""
    stats = df.filter(F.col(split_col) == fit_on).agg(
        *[F.avg(f).alias(f"m_{f}") for f in features],
        *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    # 2 x features scalars: fitted once, applied as literals (no join needed)
    out = df
    for f in features:
        mean, sd = stats[f"m_{f}"], stats[f"s_{f}"]
        divisor = 1.0 if sd is None or sd == 0 else float(sd)
        out = out.withColumn(f"{f}_scaled",
                             (F.col(f) - F.lit(float(mean or 0.0))) / F.lit(divisor))
    return out
