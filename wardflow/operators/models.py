"""The three models: training, evaluation, storage and batch scoring.

The pregnancy-risk label is a function of its inputs and of past complications,
so that model learns a rule. The vitals model is trained on the age at the
reading and scores with the age today.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import (OneHotEncoder, SQLTransformer, StandardScaler, StandardScalerModel,
                                StringIndexer, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardflow.operators import boosting
from wardflow.operators import features as X
from wardflow.session import settle

Tables = Mapping[str, DataFrame]

# Size limits, seeds and the bands of the scores. A score below
# the limit gets the label.
MIN_ROWS = 10
ROUNDS = 100
SEED = 42
BOOST_DEPTH = 3
BOOST_RATE = 0.1
RISK_BANDS = ((0.3, "Low Risk"), (0.7, "Medium Risk"), (None, "High Risk"))
COMPLIANCE_BANDS = ((0.3, "High Compliance"), (0.6, "Medium Compliance"),
                    (None, "Low Compliance"))
PRESSURE_BANDS = ((120, "Normal"), (130, "Elevated"), (140, "Hypertension Stage 1"),
                  (None, "Hypertension Stage 2"))

# Slices of the range of scores whose weights are added up apart.
SLICES = 1024

RISK_NUMBERS = ["age", *X.READINGS, *X.CONDITIONS]
RISK_KEYS = ["patient_id", *X.READINGS, *X.CONDITIONS, "had_complications"]
FOLLOWUP_KEYS = ["visit_id"]
VITALS_KEYS = ["vital_id"]
VITALS_NUMBERS = ["age_at_recording", *X.PREVIOUS]


class NotEnoughRows(ValueError):
    """Fewer training rows than a model needs."""


@dataclass(frozen=True)
class Trained:
    """A fitted pipeline and the rows it has not seen."""

    model: PipelineModel
    test: DataFrame


def band(score: Column, bands: tuple[tuple[float | None, str], ...]) -> Column:
    """Label of the first band whose limit lies above the score."""
    label = F
    for limit, name in bands[:-1]:
        label = label.when(score < limit, name)
    return label.otherwise(bands[-1][1])


# -- training -----------------------------------------------------------------

def prepared(train: DataFrame, numbers: list[str], copies: str | None = None,
             category: str | None = None) -> PipelineModel:
    """The fitted stages from raw columns to ``features``, without a learner."""
    return Pipeline(stages=_prepared(train, numbers, copies, category)).fit(train)


def _prepared(train: DataFrame, numbers: list[str], copies: str | None = None,
              category: str | None = None) -> list:
    """Stages from raw columns to ``features``.

    Missing numbers become the median of the training rows, and are scaled. A
    category becomes one column per value; one not seen in training has none.
    """
    medians = X.medians(train, numbers, copies)
    filled = ", ".join(f"coalesce(CAST({c} AS DOUBLE), {float(medians[c] or 0)!r}D) AS {c}_filled"
                       for c in numbers)
    stages = [
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"{c}_filled" for c in numbers], outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True),
    ]
    inputs = ["scaled"]
    if category:
        stages += [
            SQLTransformer(statement=f"SELECT *, coalesce({category}, '{X.UNKNOWN}') AS "
                                     f"{category}_filled FROM __THIS__"),
            StringIndexer(inputCol=f"{category}_filled", outputCol=f"{category}_index",
                          handleInvalid="keep"),
            # The last index is that of unseen values; leaving it out gives
            # them no column.
            OneHotEncoder(inputCol=f"{category}_index", outputCol=f"{category}_vector",
                          dropLast=True),
        ]
        inputs.append(f"{category}_vector")
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def _train(rows: DataFrame, name: str, keys: list[str], numbers: list[str],
           learner: Estimator | Callable[[PipelineModel, DataFrame], Transformer],
           copies: str | None = None, category: str | None = None,
           stratified: bool = True) -> Trained:
    # The learner passes over its rows many times.
    rows = settle(rows, name)
    held = rows.count() if copies is None else rows.agg(F.sum(copies)).first()[0]
    if (held or 0) < MIN_ROWS:
        raise NotEnoughRows(f"{name}: {held or 0} rows, at least {MIN_ROWS} are needed")
    if stratified:
        train, test = X.stratified_split(rows, keys, "label", seed=SEED)
    else:
        train, test = X.split(rows, keys, seed=SEED)
    stages = _prepared(train, numbers, copies, category)
    if isinstance(learner, Estimator):
        return Trained(Pipeline(stages=[*stages, learner]).fit(train), test)
    made = Pipeline(stages=stages).fit(train)
    return Trained(PipelineModel([*made.stages, learner(made, train)]), test)


def _forest(label: str, trees: int, depth: int, copies: str | None = None) -> RandomForestClassifier:
    # Every row's node in every tree is kept: else each level walks all trees from the root
    # for every row. The trees are the same.
    forest = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=SEED,
                                    cacheNodeIds=True)
    return forest.setWeightCol(copies) if copies else forest


def risk_rows(t: Tables, as_of: date | None = None) -> DataFrame:
    return X.risk_features(t, as_of).withColumn("label", F.col("high_risk").cast("double"))


def followup_rows(t: Tables, as_of: date | None = None) -> DataFrame:
    return X.followup_features(t, as_of).withColumn(
        "label", F.col("missed_followup").cast("double"))


def vitals_rows(t: Tables) -> DataFrame:
    """Labelled rows; those without the next pressure are left out."""
    return (X.vitals_lag_features(t).dropna(subset=["blood_pressure_systolic"])
            .withColumn("label", F.col("blood_pressure_systolic").cast("double")))


def test_rows(rows: DataFrame, keys: list[str], stratified: bool = True) -> DataFrame:
    """The rows that training leaves out."""
    rows = settle(rows, "labelled")
    return (X.stratified_split(rows, keys, "label", seed=SEED) if stratified
            else X.split(rows, keys, seed=SEED))[1]


def train_risk(t: Tables, as_of: date | None = None, trees: int = ROUNDS,
               depth: int = 10) -> Trained:
    """Random forest for the pregnancy risk."""
    return _train(risk_rows(t, as_of), "risk", RISK_KEYS, RISK_NUMBERS,
                  _forest("label", trees, depth, "copies"), copies="copies")


def train_followup(t: Tables, as_of: date | None = None, trees: int = ROUNDS,
                   depth: int = 10) -> Trained:
    """Random forest for a missed follow-up."""
    return _train(followup_rows(t, as_of), "followup", FOLLOWUP_KEYS, X.FOLLOWUP_NUMBERS,
                  _forest("label", trees, depth), category="gender")


def train_vitals(t: Tables, rounds: int = ROUNDS) -> Trained:
    """Boosted trees for the next systolic pressure."""
    return _train(vitals_rows(t), "vitals", VITALS_KEYS, VITALS_NUMBERS,
                  lambda made, train: _boosted(made, train, rounds), stratified=False)


def _boosted(made: PipelineModel, train: DataFrame, rounds: int) -> SQLTransformer:
    """The stage that predicts by boosted trees, which are SQL text over the scaled numbers."""
    rows = made.transform(train).select(*VITALS_KEYS, "label",
                                        vector_to_array("features").alias("numbers"))
    trees = boosting.fit(rows, "numbers", "label", VITALS_KEYS, rounds, BOOST_DEPTH, BOOST_RATE,
                         SEED)
    scaler = next(s for s in made.stages if isinstance(s, StandardScalerModel))
    # As the scaler does it, so that a number at a limit falls on the same side.
    scaled = ", ".join(
        f"({c}_filled - {float(mean)!r}D) * {1 / float(std) if std else 0.0!r}D AS {c}_scaled"
        for c, mean, std in zip(VITALS_NUMBERS, scaler.mean, scaler.std, strict=True))
    predicted = trees.sql([f"{c}_scaled" for c in VITALS_NUMBERS])
    return SQLTransformer(statement=f"SELECT *, {predicted} AS prediction "
                                    f"FROM (SELECT *, {scaled} FROM __THIS__)")


# -- evaluation ---------------------------------------------------------------

def evaluate_classifier(model: PipelineModel, test: DataFrame,
                        copies: str | None = None) -> DataFrame:
    """Rows (metric, label, value): report per class, averages, accuracy, ROC AUC."""
    weight = F.lit(1.0) if copies is None else F.col(copies).cast("double")
    scored = model.transform(test).select("label", "prediction", weight.alias("_weight"),
                                          _probability().alias("_score"))
    scored = settle(scored, "scored")
    return classification_report(scored, roc_auc(scored, "_score", "_weight"))


def roc_auc(scored: DataFrame, score: str, weight: str) -> float | None:
    """Area under the ROC curve of rows with a 0/1 ``label``: exact, ties count half.

    Weighted ranks by prefix sums on two levels: weights are added up per distinct
    score, in slices of equal width of the scores' range, then per slice. Within a slice
    a window adds up the scores before one, so no task orders all scores. None without
    rows of both labels.
    """
    real = F.col("label") == 1
    exact = F.col(weight).cast("double")
    by_score = (scored.filter(F.col(score).isNotNull() & F.col("label").isin(0, 1))
                .groupBy(F.col(score).cast("double").alias("_s"))
                .agg(F.sum(F.when(real, exact).otherwise(0.0)).alias("one"),
                     F.sum(F.when(real, 0.0).otherwise(exact)).alias("zero")))
    by_score = settle(by_score, "scores")
    low, high = by_score.agg(F.min("_s"), F.max("_s")).first()
    if low is None:
        return None
    width = (high - low) or 1.0
    cut = by_score.withColumn("_slice", F.floor((F.col("_s") - low) / width * SLICES))
    sums = {r["_slice"]: (r["one"], r["zero"]) for r in cut.groupBy("_slice").agg(
        F.sum("one").alias("one"), F.sum("zero").alias("zero")).collect()}
    ones, zeros = (sum(s[i] for s in sums.values()) for i in (0, 1))
    if not ones or not zeros:
        return None
    before = (Window.partitionBy("_slice").orderBy("_s")
              .rowsBetween(Window.unboundedPreceding, -1))
    below = F.coalesce(F.sum("zero").over(before), F.lit(0.0)) + F.col("zero") / 2
    within = cut.withColumn("_below", below).agg(
        F.sum(F.col("one") * F.col("_below")).alias("area")).first()["area"]
    earlier = area = 0.0
    for slice_ in sorted(sums):
        area += sums[slice_][0] * earlier
        earlier += sums[slice_][1]
    return (within + area) / (ones * zeros)


def classification_report(scored: DataFrame, roc_auc: float | None) -> DataFrame:
    """The report of rows with ``label``, ``prediction`` and ``_weight``."""
    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_weight"))), F.lit(0.0))

    real, said = F.col("label"), F.col("prediction")
    counts = scored.agg(*[
        column.alias(f"{name}_{c}") for c in (0, 1) for name, column in (
            ("hit", total((real == c) & (said == c))), ("said", total(said == c)),
            ("real", total(real == c)))])

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    rows, by_class = [], {}
    for c in (0, 1):
        hit, guessed, support = (F.col(f"{n}_{c}") for n in ("hit", "said", "real"))
        by_class[c] = {"precision": ratio(hit, guessed), "recall": ratio(hit, support),
                       "f1": ratio(2 * hit, guessed + support), "support": support}
        rows += [(metric, str(c), value) for metric, value in by_class[c].items()]
    everything = F.col("real_0") + F.col("real_1")
    for metric in ("precision", "recall", "f1"):
        zero, one = by_class[0][metric], by_class[1][metric]
        rows.append((metric, "macro avg", (zero + one) / 2))
        rows.append((metric, "weighted avg", ratio(
            zero * F.col("real_0") + one * F.col("real_1"), everything)))
    rows.append(("accuracy", None, ratio(F.col("hit_0") + F.col("hit_1"), everything)))
    rows.append(("roc_auc", None, F.lit(roc_auc).cast("double")))
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(metric).alias("metric"), F.lit(label).cast("string").alias("label"),
                 value.alias("value")) for metric, label, value in rows])))


def evaluate_regressor(model: PipelineModel, test: DataFrame) -> DataFrame:
    """One row with the root mean squared error."""
    rmse = RegressionEvaluator(labelCol="label", metricName="rmse").evaluate(model.transform(test))
    return test.sparkSession.range(1).select(
        F.lit("rmse").alias("metric"), F.lit(None).cast("string").alias("label"),
        F.lit(float(rmse)).alias("value"))


# -- storage ------------------------------------------------------------------

def _saved_folder(spark: SparkSession, path: str) -> str | None:
    """The folder of the last model that was saved whole, by the note written after it."""
    try:
        note = spark.read.text(f"{path}/current").first()
    except AnalysisException:
        return None
    return f"{path}/{note['value']}" if note else None


def is_saved(spark: SparkSession, path: str) -> bool:
    return _saved_folder(spark, path) is not None


def fit_or_load(spark: SparkSession, path: str, train: Callable[[], Trained],
                retrain: bool = False) -> PipelineModel:
    """The model saved at ``path``; trained and saved there if there is none.

    Every save has a folder of its own, so one that broke off is never loaded.
    """
    folder = None if retrain else _saved_folder(spark, path)
    if folder is None:
        name = uuid.uuid4().hex
        folder = f"{path}/{name}"
        train().model.write().save(folder)
        (spark.range(1).select(F.lit(name).alias("value")).write.mode("overwrite")
         .text(f"{path}/current"))
    return PipelineModel.load(folder)


def load_models(spark: SparkSession, t: Tables, folder: str, as_of: date | None = None,
                retrain: bool = False) -> dict[str, PipelineModel]:
    """All three models from one folder, those that are absent trained first."""
    trainers = {"risk": lambda: train_risk(t, as_of),
                "followup": lambda: train_followup(t, as_of),
                "vitals": lambda: train_vitals(t)}
    return {name: fit_or_load(spark, f"{folder}/{name}", train, retrain)
            for name, train in trainers.items()}


# -- scoring ------------------------------------------------------------------

def _probability() -> Column:
    return vector_to_array("probability")[1]


def score_risk(t: Tables, model: PipelineModel, as_of: date | None = None) -> DataFrame:
    """Every patient's risk probability and category."""
    scored = model.transform(X.risk_features_serving(t, as_of))
    return scored.select(
        "patient_id", _probability().alias("risk_probability"),
        band(_probability(), RISK_BANDS).alias("risk_category"))


def score_followup(t: Tables, model: PipelineModel, as_of: date | None = None) -> DataFrame:
    """Every patient's probability of missing a follow-up, and compliance level."""
    scored = model.transform(X.followup_features_serving(t, as_of))
    return scored.select(
        "patient_id", _probability().alias("miss_probability"),
        band(_probability(), COMPLIANCE_BANDS).alias("compliance_level"))


def score_vitals(t: Tables, model: PipelineModel, as_of: date | None = None) -> DataFrame:
    """The next systolic pressure of every patient with a reading, and its status."""
    scored = model.transform(X.vitals_features_serving(t, as_of))
    return scored.select(
        "patient_id", F.col("prediction").alias("predicted_bp_systolic"),
        band(F.col("prediction"), PRESSURE_BANDS).alias("bp_status"))
