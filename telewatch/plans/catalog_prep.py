"""Registered preparation and ML queries.

The balancing target for the driver data is twice the High class (so High is
drawn with replacement and the other two classes without); the reference's
fixed 8,366 stays the operator default.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import ml as M
from ..operators import prep as P
from ..operators.ordered import materialize
from ..schemas import FEATURES
from ..session import scratch_table_dir
from ..sources import readings as RD
from ..sources.files import exists, read_labelled
from ..sources.tables import TELEMETRY_CTE
from .catalog_calibrate import sig, sig_sql
from .registry import register

FOLDER_OF_LABEL = {"Normal": "normal", "Moderate": "moderate", "High": "high_load"}


def _sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def write_labelled_folders(spark, sf_dir) -> str:
    """S6-style sink: labelled CSV folders under the shared scratch location.

    Also writes a ``high`` folder whose files lack ``process_count``, which
    the schema guard (D2) must reject.
    """
    base = scratch_table_dir(spark, f"labelled-{uuid.uuid4().hex}")
    rows = RD.training_rows(spark, sf_dir)
    cols = ["ts", *FEATURES]
    for label, folder in FOLDER_OF_LABEL.items():
        (rows.filter(F.col("label") == label).select(*cols)
         .write.mode("overwrite").option("header", True).csv(f"{base}/{folder}"))
    (rows.filter(F.col("label") == "High").select(*[c for c in cols if c != "process_count"])
     .write.mode("overwrite").option("header", True).csv(f"{base}/high"))
    return base


def labelled_scan(spark, sf_dir):
    base = write_labelled_folders(spark, sf_dir)
    rows, _ = read_labelled(spark, base)
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"),
        sig(F.sum("cpu_percent"), 9).alias("sum_cpu"),
        sig(F.sum("memory_available_mb"), 9).alias("sum_avail"),
        F.sum("process_count").alias("sum_processes"))


SCAN_SQL = _sql(TELEMETRY_CTE, RD.TRAINING_CTE) + f"""
SELECT label, count(*) AS rows, {sig_sql("sum(cpu_percent)", 9)} AS sum_cpu,
       {sig_sql("sum(memory_available_mb)", 9)} AS sum_avail,
       CAST(sum(process_count) AS BIGINT) AS sum_processes
FROM training GROUP BY label"""

register("s1_labelled_scan", "S1 S2 S6 D1 D2 D3 D4", SCAN_SQL)(labelled_scan)


def rejected_files(spark, sf_dir):
    """D2 report: the files skipped by the guard and what they miss."""
    base = write_labelled_folders(spark, sf_dir)
    _, rejected = read_labelled(spark, base)
    return rejected.select(F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1).alias("folder"),
                           F.array_join("missing", ",").alias("missing")).distinct()


_HEADERS = ", ".join(f"('{folder}', '{c}')" for folder, cols in
                     [*((f, ["ts", *FEATURES]) for f in FOLDER_OF_LABEL.values()),
                      ("high", [c for c in ["ts", *FEATURES] if c != "process_count"])] for c in cols)
REJECTED_SQL = f"""
WITH headers(folder, col) AS (VALUES {_HEADERS}),
required(col) AS (VALUES {", ".join(f"('{c}')" for c in FEATURES)})
SELECT folder, string_agg(r.col, ',') AS missing
FROM (SELECT DISTINCT folder FROM headers) f, required r
WHERE NOT EXISTS (SELECT 1 FROM headers h WHERE h.folder = f.folder AND h.col = r.col)
GROUP BY folder"""

register("d2_rejected_files", "D2 S1", REJECTED_SQL)(rejected_files)


def process_ids(spark, sf_dir):
    t = RD.with_process_ids(RD.training_rows(spark, sf_dir))
    return t.select("id", "label", "process_id")


IDS_SQL = _sql(TELEMETRY_CTE, RD.TRAINING_CTE, RD.IDS_CTE) + "SELECT id, label, process_id FROM ided"

register("d5_process_ids", "D5 D3 D4", IDS_SQL)(process_ids)


def audit(spark, sf_dir):
    """D8 over the scanned files: ids run along label, path and row; files per
    label are summed, since part file names are random."""
    rows, _ = read_labelled(spark, write_labelled_folders(spark, sf_dir))
    rank = F.create_map(*[F.lit(x) for kv in RD.LABEL_RANK.items() for x in kv])[F.col("label")]
    ided = materialize(P.assign_ids(rows.withColumn("_rank", rank), ["_rank", "source_file", "place"]))
    per_file = P.audit(ided, columns=[*FEATURES, "label"])
    return per_file.groupBy("label").agg(
        F.sum("rows").alias("rows"), F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"),
        F.max("total_rows").alias("total_rows"), F.max(F.array_join("columns", ",")).alias("columns"))


AUDIT_SQL = _sql(TELEMETRY_CTE, RD.TRAINING_CTE, RD.IDS_CTE) + f"""
SELECT label, count(*) AS rows, min(process_id) AS min_id, max(process_id) AS max_id,
       (SELECT count(*) FROM ided) AS total_rows, '{",".join([*FEATURES, "label"])}' AS columns
FROM ided GROUP BY label"""

register("d8_dataset_audit", "D8 D5 S1", AUDIT_SQL)(audit)


def distinct_labels(spark, sf_dir):
    return P.distinct_labels(RD.training_rows(spark, sf_dir))


register("d7_distinct_labels", "D7",
         _sql(TELEMETRY_CTE, RD.TRAINING_CTE) + "SELECT DISTINCT label FROM training")(distinct_labels)


def balance_target(training) -> int:
    """Twice the High class: one scalar from a grouped count."""
    return 2 * training.filter(F.col("label") == "High").count()


def balanced(spark, sf_dir):
    t = RD.with_process_ids(RD.training_rows(spark, sf_dir))
    n = balance_target(t)
    return P.balance(t, n).select("label", "process_id")


def _h(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 15))::BIGINT"


BALANCE_SQL = _sql(TELEMETRY_CTE, RD.TRAINING_CTE, RD.IDS_CTE, f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, process_id) AS rk,
         count(*) OVER (PARTITION BY label) AS cnt
  FROM (SELECT *, {_h("CAST(process_id AS VARCHAR) || ':42'")} AS h FROM ided) x)""",
                   """target AS (SELECT 2 * count(*) AS n FROM training WHERE label = 'High')""",
                   """small AS (SELECT DISTINCT label, cnt FROM ranked, target WHERE cnt < target.n)""",
                   f"""picks AS (
  SELECT label, {_h("label || ':' || CAST(slot AS VARCHAR) || ':42'")} % cnt + 1 AS rk
  FROM small, target, generate_series(1, target.n) g(slot))""") + """
SELECT label, process_id FROM ranked, target WHERE cnt >= target.n AND rk <= target.n
UNION ALL
SELECT r.label, r.process_id FROM picks p JOIN ranked r ON r.label = p.label AND r.rk = p.rk"""

register("d6_balanced_classes", "D6 D5", BALANCE_SQL)(balanced)


def label_encoding(spark, sf_dir):
    t = P.label_index(RD.training_rows(spark, sf_dir))
    return t.select("label", F.col("label_idx").cast("int").alias("label_idx")).distinct()


register("m2_label_encoding", "M2", _sql(TELEMETRY_CTE, RD.TRAINING_CTE) + """
SELECT DISTINCT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx
FROM training""")(label_encoding)


def split(spark, sf_dir):
    t = RD.with_process_ids(RD.training_rows(spark, sf_dir))
    return P.stratified_split(t).select("process_id", "label", "split")


SPLIT_CTE = f"""split AS (
  SELECT *, CASE WHEN rk <= floor(cnt * 0.8) THEN 'train' ELSE 'test' END AS split FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, process_id) AS rk,
           count(*) OVER (PARTITION BY label) AS cnt
    FROM (SELECT *, {_h("CAST(process_id AS VARCHAR) || ':42'")} AS h FROM ided) x) y)"""

register("m3_stratified_split", "M3", _sql(TELEMETRY_CTE, RD.TRAINING_CTE, RD.IDS_CTE, SPLIT_CTE)
         + "SELECT process_id, label, split FROM split")(split)

SCALE_COLS = FEATURES


def scaling(spark, sf_dir):
    # the split feeds the fitted statistics and the output: write it once
    t = materialize(P.stratified_split(RD.with_process_ids(RD.training_rows(spark, sf_dir))))
    s = P.standard_scale(t, SCALE_COLS)
    return s.select("process_id", "split", *[sig(F.col(f"{c}_scaled"), 9).alias(f"{c}_scaled")
                                             for c in SCALE_COLS])


SCALE_SQL = _sql(TELEMETRY_CTE, RD.TRAINING_CTE, RD.IDS_CTE, SPLIT_CTE, "st AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALE_COLS)
    + " FROM split WHERE split = 'train')") + "SELECT process_id, split, " + ", ".join(
    sig_sql(f"({c} - m_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0 ELSE s_{c} END", 9)
    + f" AS {c}_scaled" for c in SCALE_COLS) + " FROM split, st"

register("m4_standard_scaling", "M4 M3", SCALE_SQL)(scaling)


def rule_metrics(spark, sf_dir):
    """M10 on the rule classifier: stored level (R3) scored against the band label."""
    t = RD.training_rows(spark, sf_dir)
    risk = (F.col("cpu_percent") * 0.4 + F.col("memory_percent") * 0.6) / 100.0
    pred = t.select(F.col("label").alias("label_idx"),
                    F.when(risk > 0.6, "High").otherwise("Normal").alias("prediction"))
    m = M.classification_metrics(pred)
    return m.select(*[sig(F.col(c), 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


METRICS_SQL = _sql(TELEMETRY_CTE, RD.TRAINING_CTE, """p AS (
  SELECT label AS y, CASE WHEN (cpu_percent * 0.4 + memory_percent * 0.6) / 100.0 > 0.6
                          THEN 'High' ELSE 'Normal' END AS p FROM training)""",
                   "cm AS (SELECT y, p, count(*) AS n FROM p GROUP BY y, p)",
                   """cls AS (
  SELECT t.y, t.support, t.tp, coalesce(q.predicted, 0) AS predicted FROM
    (SELECT y, sum(n) AS support, sum(CASE WHEN y = p THEN n ELSE 0 END) AS tp FROM cm GROUP BY y) t
    LEFT JOIN (SELECT p AS y, sum(n) AS predicted FROM cm GROUP BY p) q ON t.y = q.y)""",
                   """pr AS (
  SELECT support, tp,
         CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM cls)""") + f"""
SELECT {sig_sql("sum(tp) / sum(support)", 9)} AS accuracy,
       {sig_sql("sum(prec * support) / sum(support)", 9)} AS precision,
       {sig_sql("sum(rec * support) / sum(support)", 9)} AS recall,
       {sig_sql("sum(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END * support) / sum(support)", 9)} AS f1
FROM pr"""

register("m10_classification_metrics", "M10", METRICS_SQL)(rule_metrics)


def comparison_sides(spark, sf_dir):
    """Split first, then balance the train side only: no copy of a row is on both sides."""
    t = materialize(P.stratified_split(RD.with_process_ids(RD.training_rows(spark, sf_dir))))
    train, test = t.filter("split = 'train'"), t.filter("split = 'test'")
    return materialize(P.balance(train, balance_target(train))), test


def split_then_balance(spark, sf_dir):
    """M3 + D6 as the model comparison uses them: rows and distinct rows per side and class."""
    train, test = comparison_sides(spark, sf_dir)
    return train.unionByName(test).groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("process_id").alias("sum_ids"), F.countDistinct("process_id").alias("distinct_ids"))


SIDES_CTES = _sql(TELEMETRY_CTE, RD.TRAINING_CTE, RD.IDS_CTE, SPLIT_CTE,
                 "side AS (SELECT label, process_id FROM split WHERE split = 'train')", f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, process_id) AS rk,
         count(*) OVER (PARTITION BY label) AS cnt
  FROM (SELECT *, {_h("CAST(process_id AS VARCHAR) || ':42'")} AS h FROM side) x)""",
                 "target AS (SELECT 2 * count(*) AS n FROM side WHERE label = 'High')",
                 "small AS (SELECT DISTINCT label, cnt FROM ranked, target WHERE cnt < target.n)", f"""picks AS (
  SELECT label, {_h("label || ':' || CAST(slot AS VARCHAR) || ':42'")} % cnt + 1 AS rk
  FROM small, target, generate_series(1, target.n) g(slot))""", """rows_of AS (
  SELECT 'train' AS split, label, process_id FROM ranked, target WHERE cnt >= target.n AND rk <= target.n
  UNION ALL
  SELECT 'train', r.label, r.process_id FROM picks p JOIN ranked r ON r.label = p.label AND r.rk = p.rk
  UNION ALL
  SELECT 'test', label, process_id FROM split WHERE split = 'test')""")
SIDES_SQL = SIDES_CTES + """
SELECT split, label, count(*) AS rows, CAST(sum(process_id) AS BIGINT) AS sum_ids,
       count(DISTINCT process_id) AS distinct_ids
FROM rows_of GROUP BY split, label"""

register("m3_split_then_balance", "M3 D6 M12", SIDES_SQL)(split_then_balance)


_COMPARED: dict[tuple[str, str], str] = {}


def _compared(spark, sf_dir) -> str:
    """Folder of the comparison of ``sf_dir``: the table as CSV (S8), the saved
    boosted model (S15), the rows per side, and that model's predictions of the
    test side.  Written once per application, read by the queries over it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _COMPARED and exists(spark, f"{_COMPARED[key]}/predicted/_SUCCESS"):
        return _COMPARED[key]
    train, test = comparison_sides(spark, sf_dir)
    table, fitted = M.fit_and_compare(spark, train, test)
    out = scratch_table_dir(spark, f"models-{uuid.uuid4().hex}")
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/comparison")
    M.save_model(fitted["XGBoost"], f"{out}/xgboost")
    train.select(F.lit("train").alias("split")).unionByName(test.select("split")).groupBy("split").count().write.parquet(
        f"{out}/sides")
    test.write.parquet(f"{out}/test")
    _predicted(fitted["XGBoost"], spark.read.parquet(f"{out}/test")).write.parquet(f"{out}/predicted")
    _COMPARED[key] = out
    return out


def _predicted(model, rows):
    return model.transform(rows).select("process_id", "label", "prediction",
                                        vector_to_array("probability").alias("probability"))


def _comparison_table(spark, out: str):
    schema = ", ".join(f"`{c}` {'string' if c == 'Model' else 'double'}" for c in M.COMPARISON_COLUMNS)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(
        f"{out}/comparison")


def model_comparison(spark, sf_dir):
    """M1, M5-M9, M11, M12 (+ S8 sink, S15 round trip): the whole comparison
    table, as read back from its CSV."""
    return _comparison_table(spark, _compared(spark, sf_dir))


register("m12_model_comparison", "M1 M5 M6 M7 M8 M9 M10 M11 M12 S8 S15")(model_comparison)


ACCURACY_FLOOR = 0.9


def model_properties(spark, sf_dir):
    """What is exact about the comparison, per model: the rows
    of both sides, measures within 0 and 1, the accuracy floor, times taken."""
    out = _compared(spark, sf_dir)
    sides = spark.read.parquet(f"{out}/sides").agg(
        F.max(F.when(F.col("split") == "train", F.col("count"))).alias("train_rows"),
        F.max(F.when(F.col("split") == "test", F.col("count"))).alias("test_rows")).first()
    measures = [c for c in M.COMPARISON_COLUMNS if c.startswith(("Train ", "Test ")) and "Time" not in c]
    inside = F.forall(F.array(*[F.col(c) for c in measures]), lambda x: (x >= 0) & (x <= 1))
    return _comparison_table(spark, out).select(
        F.col("Model").alias("model"), F.lit(sides["train_rows"]).cast("long").alias("train_rows"),
        F.lit(sides["test_rows"]).cast("long").alias("test_rows"), inside.alias("measures_in_range"),
        ((F.col("Test Acc") >= ACCURACY_FLOOR) & (F.col("Train Acc") >= ACCURACY_FLOOR)).alias("above_floor"),
        ((F.col("Latency (μs)") > 0) & (F.col("Train Time (s)") > 0)).alias("timed"))


_MODELS = ", ".join(f"('{m}')" for m in M.MODEL_NAMES)
PROPERTIES_SQL = SIDES_CTES + f"""
SELECT m.model, (SELECT count(*) FROM rows_of WHERE split = 'train') AS train_rows,
       (SELECT count(*) FROM rows_of WHERE split = 'test') AS test_rows,
       true AS measures_in_range, true AS above_floor, true AS timed
FROM (VALUES {_MODELS}) m(model)"""

register("m12_model_properties", "M5 M6 M7 M8 M11 M12 S8", PROPERTIES_SQL)(model_properties)


def model_round_trip(spark, sf_dir):
    """The loaded model against the one that was saved, per class of
    the test side: support, equal predictions, probabilities that sum to 1."""
    out = _compared(spark, sf_dir)
    again = _predicted(M.load_model(f"{out}/xgboost"), spark.read.parquet(f"{out}/test")).withColumnsRenamed(
        {"prediction": "p2", "probability": "q2"}).drop("label")
    total = F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(f"{out}/predicted").join(again, "process_id").groupBy("label").agg(
        F.count(F.lit(1)).alias("support"),
        F.bool_and((F.col("prediction") == F.col("p2")) & (F.col("probability") == F.col("q2"))).alias("same_after_load"),
        F.bool_and(F.abs(total - 1.0) < 1e-9).alias("sum_to_one"))


ROUND_TRIP_SQL = SIDES_CTES + """
SELECT label, count(*) AS support, true AS same_after_load, true AS sum_to_one
FROM rows_of WHERE split = 'test' GROUP BY label"""

register("s15_model_round_trip", "S15 M1 M9", ROUND_TRIP_SQL)(model_round_trip)
