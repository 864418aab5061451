"""The registered queries, each over the derived tables of one test folder."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date, datetime
from functools import lru_cache, reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.operators import features, models, profile, quality, reports, search, updates
from wardflow.operators.dashboard import Dashboard
from wardflow.session import run_dir, settle, shared_dir, tune
from wardflow.sources import derived
from wardflow.sources.clustered import ClusteredTable
from wardflow.sources.derived import HospitalTables
from wardflow.sources.tables import JSON_OPTIONS, json_rows
from wardflow.streaming import vitals as feed

TODAY = date(2002, 1, 1)
NOW = datetime(2002, 1, 1)
SPLIT_TIME = datetime(2000, 1, 1)
PATIENT = "P00000001"
AUDITED = ["patients", "medical_history", "vitals", "medications", "appointments", "doctors",
           "delivery_information", "follow_up_visits"]

Query = Callable[[SparkSession, str], DataFrame]


def _profile_json(t: Mapping[str, DataFrame], patient_id: str | None = None) -> DataFrame:
    """The profile as it is sent: every list as a JSON array."""
    pages = profile.patient_profile(t, patient_id)
    return pages.withColumns({
        section: F.to_json(section, JSON_OPTIONS) for section in profile.SECTIONS})


def _append_vitals(t: HospitalTables) -> DataFrame:
    new, _ = quality.validate_vitals(t["raw_vitals"], t["patients"])
    return updates.append_vitals(new, t["vitals"], NOW)


def _append_patients(t: HospitalTables) -> DataFrame:
    new, _ = quality.validate_patients(t["raw_patients"])
    return updates.append_patients(new, t["patients"], "", NOW)


def _append_patients_batches(t: HospitalTables) -> DataFrame:
    """The table after three batches with the same row numbers, the last one run twice."""
    new, _ = quality.validate_patients(t["raw_patients"])
    table = t["patients"]
    for batch in ("1", "2", "3", "3"):
        # Written, so that the next batch does not make it again.
        added = settle(updates.append_patients(new, table, batch, NOW), "appended")
        table = table.unionByName(added, allowMissingColumns=True)
    return table.select("patient_id", "first_name", "last_name", "date_of_birth")


def _partial_update(t: HospitalTables) -> tuple[DataFrame, DataFrame]:
    changes = derived.changes_as_maps(t["raw_changes"])
    return updates.partial_update(t["patients"], changes, NOW)


def _delete_by_key(t: HospitalTables) -> DataFrame:
    keys = t["delivery_information"].select(F.col("delivery_id").alias("vital_id"))
    return updates.delete_by_key(t["vitals"], keys, "vital_id")


def _split(t: HospitalTables) -> DataFrame:
    train, test = features.split(features.risk_features(t, TODAY), models.RISK_KEYS)
    return (train.withColumn("part", F.lit("train"))
            .unionByName(test.withColumn("part", F.lit("test"))))


def _stratified(t: HospitalTables) -> DataFrame:
    train, test = features.stratified_split(features.risk_features(t, TODAY), models.RISK_KEYS,
                                            "high_risk")
    return (train.withColumn("part", F.lit("train"))
            .unionByName(test.withColumn("part", F.lit("test"))))


def _rule_metrics(t: HospitalTables) -> DataFrame:
    """The report of a score made by rule, so that SQL can check it."""
    rows = features.risk_features(t, TODAY)
    score = (F.coalesce("age", F.lit(0)) * 7 + F.coalesce("heart_rate", F.lit(0)) * 3) % 101
    scored = settle(rows.select(
        F.col("high_risk").cast("double").alias("label"), (score / 100.0).alias("score"),
        F.when(score >= 50, 1.0).otherwise(0.0).alias("prediction"),
        F.col("copies").cast("double").alias("_weight")), "rule-scores")
    report = models.classification_report(scored, models.roc_auc(scored, "score", "_weight"))
    return report.withColumn("value", F.round("value", 9))


def _prepared_numbers(t: HospitalTables) -> DataFrame:
    """The follow-up model's inputs as its pipeline makes them, to six places."""
    rows = features.followup_features(t, TODAY)
    made = models.prepared(rows, features.FOLLOWUP_NUMBERS, category="gender")
    width = len(features.FOLLOWUP_NUMBERS)
    inputs = vector_to_array("features")
    return made.transform(rows).select(
        "visit_id", *[F.round(inputs[i], 6).alias(f"scaled_{c}")
                      for i, c in enumerate(features.FOLLOWUP_NUMBERS)],
        *[inputs[width + i].alias(f"gender_{i}") for i in range(3)])


# -- clustered files ------------------------------------------------------------

BUCKETS = 16


def _clustered(t: HospitalTables, names: list[str]) -> dict[str, ClusteredTable]:
    folder = run_dir(t.spark, "clustered")
    return {n: ClusteredTable.create(t[n], f"{folder}/{n}", "patient_id", BUCKETS)
            for n in names}


def _profile_lookup(t: HospitalTables) -> DataFrame:
    """One patient's profile from clustered files, one bucket of each table read."""
    kept = _clustered(t, ["patients", *profile.SECTIONS])
    return _profile_json({n: table.lookup(PATIENT) for n, table in kept.items()}, PATIENT)


def _search_indexed(t: HospitalTables, term: str) -> DataFrame:
    return search.PatientIndex.build(t["patients"], run_dir(t.spark, "index"), BUCKETS).search(term)


def _partial_update_written(t: HospitalTables) -> DataFrame:
    """The update written back: only the buckets of changed patients are rewritten."""
    patients = t["patients"].withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    folder = run_dir(t.spark, "written-back")
    table = ClusteredTable.create(patients, folder, "patient_id", BUCKETS)
    updates.write_back_changes(table, derived.changes_as_maps(t["raw_changes"]), NOW)
    return ClusteredTable(t.spark, folder).rows()


def _delete_written(t: HospitalTables) -> DataFrame:
    folder = run_dir(t.spark, "written-back")
    table = ClusteredTable.create(t["vitals"], folder, "vital_id", BUCKETS)
    table.delete(t["delivery_information"].select(F.col("delivery_id").alias("vital_id")))
    return ClusteredTable(t.spark, folder).rows()


def _maintained(t: HospitalTables) -> Dashboard:
    """A dashboard of a part of the rows that got the rest in two batches."""
    numbers = {"vitals": "vital_id", "medical_history": "history_id",
               "delivery_information": "delivery_id", "follow_up_visits": "visit_id"}

    def until(part: int) -> dict[str, DataFrame]:
        return {"patients": t["patients"],
                **{n: t[n].filter(F.col(c) % 3 <= part) for n, c in numbers.items()}}

    kept = Dashboard.create(until(0), TODAY, run_dir(t.spark, "dashboard"), BUCKETS)
    for part in (1, 2):
        batch = [t[n].filter(F.col(c) % 3 == part).select("patient_id") for n, c in numbers.items()]
        kept.refresh(until(part), reduce(DataFrame.unionByName, batch))
    return kept


def _filled(t: HospitalTables) -> DataFrame:
    return features.median_fill(features.risk_features(t, TODAY), features.READINGS, "copies")


# -- streams ------------------------------------------------------------------

def _order_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table with the orders arriving as a stream of files."""
    # The pattern fits a folder of files as well as a single file.
    orders = (spark.readStream.schema(derived.SOURCES["orders"])
              .parquet(f"{sf_dir}/orders.parquet*"))
    return derived.derive(spark, name, {"orders": orders})


def _check_vitals_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    checked = feed.validate_vitals_stream(_order_stream(spark, sf_dir, "raw_vitals"),
                                          t["patients"])
    out = run_dir(spark, "checked-vitals")
    feed.write_checked(checked, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(checked.schema).parquet(f"{out}/rows").select(*checked.columns)


def _abnormal_vitals_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = feed.abnormal_vitals_stream(_order_stream(spark, sf_dir, "vitals"))
    out = run_dir(spark, "abnormal-vitals")
    feed.write_changes(summary, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return feed.current_summary(spark, f"{out}/rows")


# -- models -------------------------------------------------------------------

def _model(t: HospitalTables, name: str, train: Callable[[], models.Trained]) -> PipelineModel:
    """The model of this session and test folder, trained when first needed."""
    folder = f"{shared_dir(t.spark)}/models-{t.spark.sparkContext.applicationId}"
    return models.fit_or_load(t.spark, f"{folder}/{t.sf_dir.strip('/').replace('/', '-')}/{name}",
                              train)


def _risk_model(t: HospitalTables) -> PipelineModel:
    return _model(t, "risk", lambda: models.train_risk(t, TODAY))


def _followup_model(t: HospitalTables) -> PipelineModel:
    return _model(t, "followup", lambda: models.train_followup(t, TODAY))


def _vitals_model(t: HospitalTables) -> PipelineModel:
    return _model(t, "vitals", lambda: models.train_vitals(t))


MODELS = {
    "risk_scores": lambda t: models.score_risk(t, _risk_model(t), TODAY),
    "risk_metrics": lambda t: models.evaluate_classifier(
        _risk_model(t), models.test_rows(models.risk_rows(t, TODAY), models.RISK_KEYS),
        "copies"),
    "followup_scores": lambda t: models.score_followup(t, _followup_model(t), TODAY),
    "followup_metrics": lambda t: models.evaluate_classifier(
        _followup_model(t),
        models.test_rows(models.followup_rows(t, TODAY), models.FOLLOWUP_KEYS)),
    "vitals_scores": lambda t: models.score_vitals(t, _vitals_model(t), TODAY),
    "vitals_metrics": lambda t: models.evaluate_regressor(
        _vitals_model(t), models.test_rows(models.vitals_rows(t), models.VITALS_KEYS, stratified=False)),
}


@lru_cache(maxsize=8)
def tables(spark: SparkSession, sf_dir: str) -> HospitalTables:
    """The tables of a test folder, opened once per session."""
    return HospitalTables(tune(spark), sf_dir)


def _over(build: Callable[[HospitalTables], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(tables(spark, sf_dir))


def queries() -> dict[str, Query]:
    batch = {
        "high_risk": lambda t: reports.high_risk(t, TODAY),
        "high_risk_bands": lambda t: reports.with_risk_band(reports.high_risk(t, TODAY)),
        "missed_follow_ups": lambda t: reports.missed_follow_ups(t, TODAY),
        "missed_follow_ups_bands":
            lambda t: reports.with_overdue_band(reports.missed_follow_ups(t, TODAY)),
        "abnormal_vitals": reports.abnormal_vitals,
        "delivery_methods": reports.delivery_methods,
        "demographics": lambda t: reports.demographics(t, TODAY),
        "age_distribution": lambda t: reports.age_distribution(t, TODAY),
        "dashboard_totals": lambda t: reports.dashboard_totals(t, TODAY),
        "dashboard_totals_maintained": lambda t: _maintained(t).totals(),
        "age_distribution_maintained": lambda t: _maintained(t).age_distribution(),
        "patient_profile": _profile_json,
        "one_patient_profile": lambda t: _profile_json(t, PATIENT),
        "patients": reports.patients,
        "patient": lambda t: reports.patient(t, PATIENT),
        "patients_json": lambda t: json_rows(reports.patients(t)),
        "search_patients": lambda t: reports.search_patients(t, "Pat 00000001"),
        "search_patients_by_birth": lambda t: reports.search_patients(t, "1990-0"),
        "search_patients_indexed": lambda t: _search_indexed(t, "Pat 00000001"),
        "search_patients_by_birth_indexed": lambda t: _search_indexed(t, "1990-0"),
        "search_patients_short_indexed": lambda t: _search_indexed(t, "7"),
        "one_patient_profile_lookup": _profile_lookup,
        "recent_vitals": reports.recent_vitals,
        "appointment_split": lambda t: reports.appointment_split(t, SPLIT_TIME),
        "deliveries_by_patient": reports.deliveries_by_patient,
        "monthly_visits": reports.monthly_visits,
        "filter_high_risk": lambda t: reports.filter_patients(t, "high-risk", TODAY),
        "filter_missed_follow_up":
            lambda t: reports.filter_patients(t, "missed-followup", TODAY),
        "filter_recent_delivery":
            lambda t: reports.filter_patients(t, "recent", TODAY, recent_days=365),
        "patients_page": lambda t: reports.page(t["patients"], "patient_id", 20, "P00000020"),
        "risk_features": lambda t: features.risk_features(t, TODAY),
        "risk_features_filled": _filled,
        "risk_features_split": _split,
        "risk_features_stratified": _stratified,
        "risk_rule_metrics": _rule_metrics,
        "followup_features_prepared": _prepared_numbers,
        "risk_features_serving": lambda t: features.risk_features_serving(t, TODAY),
        "followup_features": lambda t: features.followup_features(t, TODAY),
        "followup_features_serving": lambda t: features.followup_features_serving(t, TODAY),
        "vitals_lag_features": features.vitals_lag_features,
        "vitals_features_serving": lambda t: features.vitals_features_serving(t, TODAY),
        "check_vitals": lambda t: quality.check_vitals(t["raw_vitals"], t["patients"]),
        "append_vitals": _append_vitals,
        "check_patients": lambda t: quality.check_patients(t["raw_patients"]),
        "append_patients": _append_patients,
        "append_patients_batches": _append_patients_batches,
        "partial_update": lambda t: _partial_update(t)[0],
        "partial_update_rejected": lambda t: _partial_update(t)[1].drop("fields"),
        "audit": lambda t: quality.audit(t, AUDITED),
        "delete_by_key": _delete_by_key,
        "partial_update_written": _partial_update_written,
        "delete_by_key_written": _delete_written,
    }
    streams = {
        "check_vitals_stream": _check_vitals_stream,
        "abnormal_vitals_stream": _abnormal_vitals_stream,
    }
    return {**{name: _over(build) for name, build in (batch | MODELS).items()},
            **{name: lambda spark, sf_dir, run=run: run(tune(spark), sf_dir)
               for name, run in streams.items()}}
