"""ML: metrics from the confusion matrix, accuracy floor, save / load round trip."""

import tempfile

from pyspark.sql import functions as F

from telewatch.operators import ml as M
from telewatch.operators import prep as P
from telewatch.sources import readings as RD

from .conftest import SF001


def test_metrics_from_confusion_matrix(spark):
    # y, p: 2 classes + one never predicted
    pairs = [(0, 0)] * 4 + [(0, 1)] + [(1, 1)] * 3 + [(1, 0)] * 2 + [(2, 1)] * 2
    df = spark.createDataFrame([(float(y), float(p)) for y, p in pairs], "label_idx double, prediction double")
    m = M.classification_metrics(df).first()
    # class 0: tp 4, support 5, predicted 6; class 1: tp 3, support 5, predicted 6;
    # class 2: tp 0, support 2, predicted 0 (precision 0)
    n = 12
    prec = (5 * 4 / 6 + 5 * 3 / 6 + 2 * 0) / n
    rec = (5 * 4 / 5 + 5 * 3 / 5) / n
    f1 = (5 * (2 * (4 / 6) * (4 / 5) / (4 / 6 + 4 / 5)) + 5 * (2 * (3 / 6) * (3 / 5) / (3 / 6 + 3 / 5))) / n
    assert abs(m["accuracy"] - 7 / 12) < 1e-12
    assert abs(m["precision"] - prec) < 1e-12
    assert abs(m["recall"] - rec) < 1e-12
    assert abs(m["f1"] - f1) < 1e-12


def test_logistic_regression_floor_and_round_trip(spark):
    t = RD.with_process_ids(RD.training_rows(spark, SF001))
    s = P.stratified_split(t)
    table, fitted = M.fit_and_compare(spark, s.filter("split = 'train'"), s.filter("split = 'test'"),
                                      models=["Logistic Regression"])
    row = table.first()
    assert row["Model"] == "Logistic Regression"
    assert row["Test Acc"] >= 0.9 and row["Train Acc"] >= 0.9
    path = tempfile.mkdtemp(prefix="telewatch-model-") + "/lr"
    M.save_model(fitted["Logistic Regression"], path)
    loaded = M.load_model(path)
    rows = RD.training_rows(spark, SF001)
    a = M.model_level(rows, fitted["Logistic Regression"]).select("id", "risk_level")
    b = M.model_level(rows, loaded).select("id", "risk_level")
    assert a.exceptAll(b).count() == 0
    assert set(r[0] for r in b.select("risk_level").distinct().collect()) <= {"HIGH", "MODERATE", "NORMAL"}
    rule = M.model_level(rows, M.load_model(path + "-missing"))
    assert rule.filter(F.col("mode") != "rule").count() == 0
    assert rule.filter((F.col("risk_level") == "HIGH") != (F.col("risk_score") > 0.6)).count() == 0


def test_boosted_trees_serve_probabilities(spark):
    """Softmax margins are the class probabilities, also of the saved pipeline, which
    scales with the population statistics of the train side."""
    t = RD.with_process_ids(RD.training_rows(spark, SF001))
    s = P.stratified_split(t)
    train = s.filter("split = 'train'")
    table, fitted = M.fit_and_compare(spark, train, s.filter("split = 'test'"), models=["XGBoost"],
                                      settings={"rounds": 3})
    assert table.columns == M.COMPARISON_COLUMNS and table.first()["Test Acc"] > 0.9
    out = M.model_level(RD.training_rows(spark, SF001), fitted["XGBoost"])
    rows = out.select("risk_score", "confidence", "probabilities").collect()
    assert all(abs(sum(r["probabilities"].values()) - 1) < 0.01 and 0 < r["risk_score"] <= 1 for r in rows)
    assert {k for r in rows for k in r["probabilities"]} == {"high", "moderate", "normal"}
    z = fitted["XGBoost"].stages[0].transform(train).agg(F.avg("_z_cpu_percent"), F.stddev_pop("_z_cpu_percent")).first()
    assert abs(z[0]) < 1e-9 and abs(z[1] - 1) < 1e-9
    path = tempfile.mkdtemp(prefix="telewatch-model-") + "/boosted"
    M.save_model(fitted["XGBoost"], path)
    again = M.model_level(RD.training_rows(spark, SF001), M.load_model(path))
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    est = M.estimators(100)
    assert est["XGBoost"].getOrDefault("rounds") == 100 and est["Random Forest"].getMaxDepth() == 30
    assert est["MLP Neural Net"].getOrDefault("hidden") == [64, 32]


def test_prepared_frames_leave_the_heap_to_the_fits(spark, monkeypatch):
    t = RD.with_process_ids(RD.training_rows(spark, SF001))
    levels, made = [], M.estimators

    def watched(*args, **kwargs):
        est = made(*args, **kwargs)["Logistic Regression"]

        class Watched(type(est)):
            def _fit(self, df):
                levels.append(df.storageLevel)
                return est._fit(df)
        return {"Logistic Regression": Watched()}
    monkeypatch.setattr(M, "estimators", watched)
    M.fit_and_compare(spark, t, t)
    assert [(x.useDisk, x.useMemory) for x in levels] == [(True, False)]
