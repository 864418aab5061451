"""The hospital tables: columns, types, keys and lengths."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    """One declared table.

    ``columns`` is a Spark DDL column list. ``lengths`` are the VARCHAR limits,
    ``references`` the foreign keys as column -> (table, column).
    """

    name: str
    key: str
    columns: str
    required: tuple[str, ...]
    lengths: dict[str, int] = field(default_factory=dict)
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns)


_OF_PATIENT = {"patient_id": ("patients", "patient_id")}

# The declared columns, keys, lengths and defaults.
TABLES = {table.name: table for table in (
    Table(
        "patients", "patient_id",
        "patient_id string, first_name string, last_name string, date_of_birth date, "
        "gender string, email string, phone string, address string, city string, "
        "state string, zip_code string, insurance_provider string, insurance_id string, "
        "emergency_contact_name string, emergency_contact_phone string, "
        "created_at timestamp, updated_at timestamp",
        required=("patient_id", "first_name", "last_name", "date_of_birth"),
        lengths={"patient_id": 50, "first_name": 100, "last_name": 100, "gender": 20,
                 "email": 100, "phone": 20, "address": 255, "city": 100, "state": 50,
                 "zip_code": 20, "insurance_provider": 100, "insurance_id": 100,
                 "emergency_contact_name": 100, "emergency_contact_phone": 20}),
    Table(
        "medical_history", "history_id",
        "history_id bigint, patient_id string, condition_name string, "
        "diagnosis_date date, treatment string, notes string",
        required=("history_id", "patient_id", "condition_name"),
        lengths={"patient_id": 50, "condition_name": 100, "treatment": 255},
        references=_OF_PATIENT),
    Table(
        "vitals", "vital_id",
        "vital_id bigint, patient_id string, recorded_at timestamp, "
        "temperature decimal(5,2), heart_rate int, blood_pressure_systolic int, "
        "blood_pressure_diastolic int, respiratory_rate int, "
        "oxygen_saturation decimal(5,2), notes string",
        required=("vital_id", "patient_id", "recorded_at"),
        lengths={"patient_id": 50}, references=_OF_PATIENT),
    Table(
        "medications", "medication_id",
        "medication_id bigint, patient_id string, medication_name string, dosage string, "
        "frequency string, start_date date, end_date date, prescribing_doctor string, "
        "notes string",
        required=("medication_id", "patient_id", "medication_name"),
        lengths={"patient_id": 50, "medication_name": 100, "dosage": 50, "frequency": 50,
                 "prescribing_doctor": 100},
        references=_OF_PATIENT),
    Table(
        "appointments", "appointment_id",
        "appointment_id bigint, patient_id string, doctor_id int, "
        "appointment_date timestamp_ntz, reason string, status string, notes string",
        required=("appointment_id", "patient_id", "appointment_date"),
        lengths={"patient_id": 50, "reason": 255, "status": 50},
        references=_OF_PATIENT, defaults={"status": "Scheduled"}),
    Table(
        "doctors", "doctor_id",
        "doctor_id int, first_name string, last_name string, specialization string, "
        "email string, phone string",
        required=("doctor_id", "first_name", "last_name"),
        lengths={"first_name": 100, "last_name": 100, "specialization": 100, "email": 100,
                 "phone": 20}),
    Table(
        "delivery_information", "delivery_id",
        "delivery_id bigint, patient_id string, delivery_date date, delivery_method string, "
        "complications string, birth_weight decimal(5,2), apgar_score string, "
        "attending_doctor string, notes string",
        required=("delivery_id", "patient_id"),
        lengths={"patient_id": 50, "delivery_method": 100, "apgar_score": 20,
                 "attending_doctor": 100},
        references=_OF_PATIENT),
    Table(
        "follow_up_visits", "visit_id",
        "visit_id bigint, patient_id string, visit_date date, doctor_id int, reason string, "
        "diagnosis string, treatment_plan string, follow_up_required boolean, "
        "follow_up_date date, notes string",
        required=("visit_id", "patient_id", "visit_date"),
        lengths={"patient_id": 50, "reason": 255},
        references={**_OF_PATIENT, "doctor_id": ("doctors", "doctor_id")}),
    Table(
        "lab_results", "result_id",
        "result_id bigint, patient_id string, test_name string, test_date date, "
        "result_value string, normal_range string, is_abnormal boolean, notes string",
        required=("result_id", "patient_id", "test_name", "test_date"),
        lengths={"patient_id": 50, "test_name": 100, "result_value": 100,
                 "normal_range": 100},
        references=_OF_PATIENT),
)}
