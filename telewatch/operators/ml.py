"""Classifier training, scoring and comparison with Spark ML.

Training and prediction are Spark ML pipelines (data-parallel fits, batch
scoring through ``transform``).  Metrics come from the confusion matrix, a
grouped count, and are reduced to weighted precision / recall / F1 with a
second tiny aggregate - nothing is collected except the final 10 numbers.
"""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import risk as R
from ..schemas import FEATURES
from .boosting import SoftmaxBoosting
from .network import ReluNetwork

SEED = 42
ROWS_PER_PARTITION = 100_000     # of the prepared frames (a vector of 10 doubles per row)
# The comparison table's model names and columns, in order.
MODEL_NAMES = ["Random Forest", "XGBoost", "MLP Neural Net", "Logistic Regression"]
COMPARISON_COLUMNS = ["Model", "Train Acc", "Train F1", "Train Prec", "Train Recall", "Test Acc",
                      "Test F1", "Test Prec", "Test Recall", "Latency (μs)", "Train Time (s)"]


def estimators(n_train: int, n_classes: int = 3,
               rounds: int = 100, forest_depth: int = 30) -> dict:
    """M5-M8 with the reference's settings: 100 boosting rounds, 64 and 32
    hidden units, and forest trees as deep as Spark allows (30) where it sets no
    limit."""
    return {
        "Random Forest": RandomForestClassifier(numTrees=100, maxDepth=forest_depth, seed=SEED,
                                                featuresCol="features", labelCol="label_idx"),
        # softmax boosting and the ReLU network are not in Spark ML (see their modules)
        "XGBoost": SoftmaxBoosting(featuresCol="features", labelCol="label_idx", rounds=rounds, classes=n_classes),
        "MLP Neural Net": ReluNetwork(featuresCol="features", labelCol="label_idx", classes=n_classes, seed=SEED),
        # sklearn's C = 1 on a summed loss equals regParam = 1 / n on Spark's mean loss
        "Logistic Regression": LogisticRegression(
            family="multinomial", maxIter=1000, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
            featuresCol="features", labelCol="label_idx"),
    }


def prepare_stages(train: DataFrame, features=FEATURES) -> list:
    """M4 + M1 + M2: scale by the train side (population std, zero divides by
    1), assemble, encode labels alphabetically.

    The 2 x features statistics are one aggregate; they become literals of a
    saved SQL stage, so a loaded pipeline scales exactly as the fitted one.
    """
    stats = train.agg(*[F.avg(f).alias(f"m_{f}") for f in features],
                      *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    scaled = ", ".join(f"({f} - {float(stats[f'm_{f}'] or 0.0)!r}D) / {float(stats[f's_{f}'] or 1.0)!r}D AS _z_{f}"
                       for f in features)
    scaler = SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")
    assembler = VectorAssembler(inputCols=[f"_z_{f}" for f in features], outputCol="features",
                                handleInvalid="keep")
    indexer = StringIndexer(inputCol="label", outputCol="label_idx", stringOrderType="alphabetAsc")
    return [scaler, indexer, assembler]


def classification_metrics(pred: DataFrame, label: str = "label_idx",
                           prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1 in one row.

    Classes never predicted get precision 0, as the reference's scorer does.
    """
    cm = pred.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    per_true = cm.groupBy("y").agg(F.sum("n").alias("support"),
                                   F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))
                                         .otherwise(0)).alias("tp"))
    per_pred = cm.groupBy(F.col("p").alias("y")).agg(F.sum("n").alias("predicted"))
    cls = per_true.join(per_pred, "y", "left").fillna(0, ["predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    cls = cls.select("support", "tp", prec.alias("prec"), rec.alias("rec"), f1.alias("f1"))
    total = F.sum("support")
    return cls.agg(
        (F.sum("tp") / total).alias("accuracy"),
        (F.sum(F.col("prec") * F.col("support")) / total).alias("precision"),
        (F.sum(F.col("rec") * F.col("support")) / total).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("f1"))


def fit_and_compare(spark: SparkSession, train: DataFrame, test: DataFrame,
                    models: list[str] | None = None,
                    settings: dict | None = None) -> tuple[DataFrame, dict]:
    """Fit each model, score both sides, time fit and prediction.

    Returns the comparison table (one row per model, rounded 4 / 2 digits)
    and the fitted pipeline models keyed by name.  ``settings`` overrides the
    boosting rounds and the forest depth.
    """
    prep = Pipeline(stages=prepare_stages(train)).fit(train)
    needed = ["features", "label_idx"]
    n_train, n_test = train.count(), test.count()

    def prepared(side: DataFrame, n: int) -> DataFrame:
        """Only what the fits read, in partitions of bounded size, kept on the executors'
        disks: the heap is for the fits."""
        parts = max(1, -(-n // ROWS_PER_PARTITION))
        return prep.transform(side).select(needed).repartition(parts).persist(StorageLevel.DISK_ONLY)
    tr, te = prepared(train, n_train), prepared(test, n_test)
    rows, fitted = [], {}
    for name, est in estimators(n_train, **(settings or {})).items():
        if models and name not in models:
            continue
        t0 = time.perf_counter()
        model = est.fit(tr)
        fit_s = time.perf_counter() - t0
        train_m = classification_metrics(model.transform(tr)).first()
        t0 = time.perf_counter()
        scored = model.transform(te)
        scored.write.format("noop").mode("overwrite").save()
        latency_us = (time.perf_counter() - t0) / max(n_test, 1) * 1e6
        test_m = classification_metrics(model.transform(te)).first()
        fitted[name] = PipelineModel(stages=[*prep.stages, model])
        rows.append((name, *[round(float(train_m[k] or 0.0), 4) for k in
                             ("accuracy", "f1", "precision", "recall")],
                     *[round(float(test_m[k] or 0.0), 4) for k in
                       ("accuracy", "f1", "precision", "recall")],
                     round(latency_us, 2), round(fit_s, 2)))
    for frame in (tr, te):
        frame.unpersist()
    table = spark.createDataFrame(rows, COMPARISON_COLUMNS)
    return table, fitted


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | None:
    """Load a pipeline; None when it cannot be read (callers fall back to rules)."""
    try:
        return PipelineModel.load(path)
    except Exception:  # noqa: BLE001 - any load failure means rule mode
        return None


def model_level(df: DataFrame, model: PipelineModel | None) -> DataFrame:
    """R5 + R6: model mode when a model is available, rule mode otherwise.

    Model mode: level = upper-cased argmax class, risk = max probability,
    confidence = risk x 100 (2 digits), fault CPU for HIGH.  Rule mode: R1 /
    R3 with confidence 0 (ledger L2: the two modes are never mixed).
    """
    if model is None:
        risk = R.risk_score()
        zero = F.lit(0.0)
        return df.select("*", risk.alias("risk_score"), R.stored_level(risk).alias("risk_level"),
                         zero.alias("confidence"), R.stored_fault(risk).alias("fault_type"),
                         R.severity(R.stored_level(risk)).alias("severity_level"),
                         F.lit("rule").alias("mode"), F.lit(1).alias("votes"),
                         F.lit("NORMAL").alias("pem_status"), F.lit("NORMAL").alias("md_status"),
                         F.create_map(F.lit("xgboost"), R.vote(risk).cast("int")).alias("models"),
                         F.create_map(F.lit("normal"), zero, F.lit("moderate"), zero, F.lit("high"), zero)
                         .alias("probabilities"))
    labels = model.stages[1].labels  # alphabetical: the indexer's own order (ledger L1)
    scored = model.transform(df)
    scored = scored.withColumn("_prob", vector_to_array("probability"))
    names = F.array(*[F.lit(x.upper()) for x in labels])
    level = F.element_at(names, F.col("prediction").cast("int") + 1)
    risk = F.array_max("_prob")
    shown = F.create_map(*[x for i, c in enumerate(labels)
                           for x in (F.lit(c.lower()), F.round(F.get("_prob", F.lit(i)), 3))])
    return scored.select(*df.columns, risk.alias("risk_score"), level.alias("risk_level"),
                         F.round(risk * 100.0, 2).alias("confidence"),
                         F.when(level == "HIGH", "CPU").otherwise("NONE").alias("fault_type"),
                         R.severity(level).alias("severity_level"), F.lit("model").alias("mode"),
                         F.lit(1).alias("votes"), F.lit("NORMAL").alias("pem_status"),
                         F.lit("NORMAL").alias("md_status"),
                         F.create_map(F.lit("xgboost"), (level == "HIGH").cast("int")).alias("models"),
                         shown.alias("probabilities"))
