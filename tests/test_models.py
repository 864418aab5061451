"""Training, evaluation, storage and scoring of the models."""

import pytest
from pyspark.sql import functions as F

from helpers import TODAY, hospital
from wardflow.operators import features as X
from wardflow.operators import models as M
from wardflow.sources.derived import HospitalTables


@pytest.fixture(scope="module")
def tables(spark):
    return HospitalTables(spark, "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def risk(tables):
    return M.train_risk(tables, TODAY, trees=10, depth=8)


def test_medians_interpolate_and_count_copies(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (10.0, 1), (11.0, 1), (None, 9)],
                               "x double, n bigint")
    assert X.medians(df, ["x"]) == {"x": 6.0}
    assert X.medians(df.withColumn("n", F.when(F.col("x") == 1, 9).otherwise(F.col("n"))),
                     ["x"], "n") == {"x": 1.0}
    filled = X.median_fill(df, ["x"]).filter("n = 9").first()
    assert filled.x == 6.0


def test_split_is_stable_and_near_a_fifth(spark):
    df = spark.range(10_000)
    train, test = X.split(df, ["id"])
    again = X.split(df.repartition(7), ["id"])[1]
    assert train.count() + test.count() == 10_000
    assert 0.18 < test.count() / 10_000 < 0.22
    assert not test.exceptAll(again).count()
    assert X.split(df, ["id"], seed=1)[1].exceptAll(test).count()


def test_report_of_known_counts(spark):
    rows = [(0.0, 0.0)] * 6 + [(0.0, 1.0)] * 2 + [(1.0, 0.0)] + [(1.0, 1.0)] * 3
    scored = spark.createDataFrame(rows, "label double, prediction double").withColumn(
        "_weight", F.lit(1.0))
    found = {(r.metric, r.label): r.value
             for r in M.classification_report(scored, 0.75).collect()}
    assert found["precision", "0"] == pytest.approx(6 / 7)
    assert found["recall", "0"] == pytest.approx(6 / 8)
    assert found["precision", "1"] == pytest.approx(3 / 5)
    assert found["recall", "1"] == pytest.approx(3 / 4)
    assert found["f1", "1"] == pytest.approx(2 / 3)
    assert found["support", "0"] == 8
    assert found["accuracy", None] == pytest.approx(9 / 12)
    assert found["recall", "weighted avg"] == pytest.approx(9 / 12)
    assert found["roc_auc", None] == 0.75


def test_report_without_a_class(spark):
    scored = spark.createDataFrame([(0.0, 0.0, 1.0)], "label double, prediction double, "
                                                      "_weight double")
    found = {(r.metric, r.label): r.value for r in M.classification_report(scored, 0).collect()}
    assert found["precision", "1"] == found["recall", "1"] == found["f1", "1"] == 0


@pytest.mark.parametrize("score, risk, compliance, pressure", [
    (0.29, "Low Risk", "High Compliance", None), (0.3, "Medium Risk", "Medium Compliance", None),
    (0.6, "Medium Risk", "Low Compliance", None), (0.7, "High Risk", "Low Compliance", None),
    (119.9, None, None, "Normal"), (120.0, None, None, "Elevated"),
    (130.0, None, None, "Hypertension Stage 1"), (140.0, None, None, "Hypertension Stage 2")])
def test_bands(spark, score, risk, compliance, pressure):
    df = spark.createDataFrame([(score,)], "s double")
    for bands, label in ((M.RISK_BANDS, risk), (M.COMPLIANCE_BANDS, compliance),
                         (M.PRESSURE_BANDS, pressure)):
        if label:
            assert df.select(M.band(F.col("s"), bands)).first()[0] == label


def test_risk_model(tables, risk):
    rows = M.score_risk(tables, risk.model, TODAY).collect()
    assert len(rows) == 1500 == len({r.patient_id for r in rows})
    for r in rows:
        p = r.risk_probability
        assert 0 <= p <= 1
        assert r.risk_category == ("Low Risk" if p < 0.3 else
                                   "Medium Risk" if p < 0.7 else "High Risk")
    report = {(r.metric, r.label): r.value
              for r in M.evaluate_classifier(risk.model, risk.test, "copies").collect()}
    assert report["roc_auc", None] > 0.8
    constant = report["support", "1"] / (report["support", "0"] + report["support", "1"])
    assert report["accuracy", None] > constant
    assert report["support", "0"] + report["support", "1"] == risk.test.agg(
        F.sum("copies")).first()[0]


def test_followup_model_ignores_unseen_genders(spark, tables):
    trained = M.train_followup(tables, TODAY, trees=5, depth=5)
    rows = M.score_followup(tables, trained.model, TODAY)
    assert rows.count() == 1500
    unseen = X.followup_features_serving(tables, TODAY).withColumn("gender", F.lit("Other"))
    vector = trained.model.transform(unseen).first()["gender_vector"]
    assert vector.numNonzeros() == 0
    report = {r.metric: r.value for r in
              M.evaluate_classifier(trained.model, trained.test).collect() if not r.label}
    assert report["roc_auc"] > 0.6


def test_vitals_model(tables):
    trained = M.train_vitals(tables, rounds=3)
    rows = M.score_vitals(tables, trained.model, TODAY).collect()
    assert len(rows) == 1500
    assert all(90 < r.predicted_bp_systolic < 160 for r in rows)
    rmse = M.evaluate_regressor(trained.model, trained.test).first().value
    assert rmse < 1.05 * trained.test.agg(F.stddev("label")).first()[0]


def test_model_is_trained_once_and_reloaded(spark, tables, risk, tmp_path):
    calls = []

    def train():
        calls.append(1)
        return risk

    path = f"{tmp_path}/models/risk"
    assert not M.is_saved(spark, path)
    first = M.fit_or_load(spark, path, train)
    second = M.fit_or_load(spark, path, train)
    assert len(calls) == 1
    M.fit_or_load(spark, path, train, retrain=True)
    assert len(calls) == 2
    a, b = (M.score_risk(tables, m, TODAY) for m in (first, second))
    assert not a.exceptAll(b).count()


def test_only_absent_models_are_trained(spark, tables, risk, tmp_path, monkeypatch):
    trained = []
    for name in ("risk", "followup", "vitals"):
        monkeypatch.setattr(M, f"train_{name}",
                            lambda *args, name=name: trained.append(name) or risk)
    M.fit_or_load(spark, f"{tmp_path}/risk", lambda: risk)
    assert set(M.load_models(spark, tables, str(tmp_path), TODAY)) == {
        "risk", "followup", "vitals"}
    assert trained == ["followup", "vitals"]


def test_too_few_rows_are_refused(spark):
    with pytest.raises(M.NotEnoughRows):
        M.train_risk(hospital(spark), TODAY)
