"""For each registered query, SQL that gives the same rows in DuckDB.

Every text starts from the test tables: the derivations come first as WITH
clauses. The SQL spells the semantics out row by row (joins that fan out,
EXISTS tests), where the Spark side aggregates before it joins.
"""

from __future__ import annotations

from wardflow.sources.derived import oracle_ctes

TODAY = "DATE '2002-01-01'"
NOW = "TIMESTAMP '2002-01-01 00:00:00'"
SPLIT_TIME = "TIMESTAMP '2000-01-01 00:00:00'"


def _years(end: str) -> str:
    def day(d: str) -> str:
        return f"(year({d})*10000 + month({d})*100 + day({d}))"
    return f"CAST(({day(end)} - {day('date_of_birth')}) // 10000 AS INTEGER)"


_AGE = _years(TODAY)
_NAME = "first_name || ' ' || last_name AS patient_name"
_BAND = f"""CASE WHEN {_AGE} < 18 THEN 'Under 18' WHEN {_AGE} <= 30 THEN '18-30'
  WHEN {_AGE} <= 45 THEN '31-45' WHEN {_AGE} <= 65 THEN '46-65' ELSE 'Over 65' END AS age_group"""
_READINGS = ("temperature, heart_rate, blood_pressure_systolic, blood_pressure_diastolic, "
             "respiratory_rate, oxygen_saturation")
_PRESSURE = "(coalesce(blood_pressure_systolic > 140, false) OR coalesce(blood_pressure_diastolic > 90, false))"
_TROUBLE = "coalesce(complications <> '', false)"


def _flag(condition: str, name: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END AS {name}"


def _latest(ties: bool) -> str:
    if ties:
        return """latest AS (SELECT * FROM vitals v WHERE recorded_at =
  (SELECT max(recorded_at) FROM vitals w WHERE w.patient_id = v.patient_id))"""
    return ("latest AS (SELECT * FROM vitals QUALIFY row_number() OVER "
            "(PARTITION BY patient_id ORDER BY recorded_at DESC, vital_id DESC) = 1)")


_HIGH_RISK = f"""STEP {_latest(True)},
risk AS (
  SELECT p.patient_id, {_NAME}, date_of_birth, {_AGE} AS age, blood_pressure_systolic,
    blood_pressure_diastolic, complications, {_AGE} > 35 AS old, {_PRESSURE} AS pressed
  FROM patients p LEFT JOIN latest USING (patient_id)
  LEFT JOIN delivery_information USING (patient_id)),
high_risk AS (
  SELECT patient_id, patient_name, date_of_birth, age, blood_pressure_systolic,
    blood_pressure_diastolic, complications,
    CASE WHEN old THEN 'Age Risk' WHEN pressed THEN 'Hypertension Risk'
      ELSE 'Previous Complications' END AS risk_category,
    CASE WHEN old AND pressed THEN 1 WHEN pressed THEN 2 WHEN old THEN 3 ELSE 4 END AS risk_rank
  FROM risk WHERE old OR pressed OR {_TROUBLE})
"""
_MISSED = f"""missed AS (
  SELECT p.patient_id, {_NAME}, phone, email, f.visit_date AS last_visit_date,
    f.follow_up_date AS scheduled_follow_up,
    CAST({TODAY} - f.follow_up_date AS INTEGER) AS days_overdue
  FROM follow_up_visits f JOIN patients p USING (patient_id)
  WHERE f.follow_up_required AND f.follow_up_date < {TODAY} AND NOT EXISTS (
    FROM follow_up_visits later
    WHERE later.patient_id = f.patient_id AND later.visit_date > f.follow_up_date))
"""
_JOINED = f"""joined AS (
  SELECT p.patient_id, {_BAND}, city, state, lower(condition_name) AS condition_name,
    delivery_id, delivery_date
  FROM patients p LEFT JOIN medical_history USING (patient_id)
  LEFT JOIN delivery_information USING (patient_id))
"""


def _mean(column: str) -> str:
    return f"CAST(sum({column}) AS DOUBLE) / count({column})"


def _count(condition: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT)"


_COUNTS = {"high_temp_count": "temperature > 37.5", "high_hr_count": "heart_rate > 100",
           "high_bp_systolic_count": "blood_pressure_systolic > 140",
           "high_bp_diastolic_count": "blood_pressure_diastolic > 90",
           "low_oxygen_count": "oxygen_saturation < 95"}
_SUMMARY = f"""summary AS (
  SELECT patient_id, count(*) AS total_measurements, {_mean('temperature')} AS avg_temperature,
    {_mean('heart_rate')} AS avg_heart_rate, {_mean('blood_pressure_systolic')} AS avg_systolic,
    {_mean('blood_pressure_diastolic')} AS avg_diastolic,
    {_mean('oxygen_saturation')} AS avg_oxygen,
    {', '.join(f'{_count(c)} AS {n}' for n, c in _COUNTS.items())}
  FROM vitals GROUP BY patient_id
  HAVING {' OR '.join(f'{_count(c)} >= 2' for c in _COUNTS.values())})
"""


def _shown(column: str) -> str:
    return f"CASE WHEN {column} <> 0 THEN CAST({column} AS VARCHAR) ELSE 'N/A' END AS {column}"


# -- features -----------------------------------------------------------------

def _named(word: str) -> str:
    return f"condition_name ILIKE '%{word}%'"


_FLAGS = ", ".join([_flag(_named("hypertension"), "has_hypertension"),
                    _flag(_named("diabetes"), "has_diabetes"),
                    _flag(_named("asthma"), "has_asthma")])
_RISK_FEATURES = f"""STEP {_latest(True)},
training AS (
  SELECT p.patient_id, {_AGE} AS age, {_READINGS}, {_FLAGS},
    {_flag(_TROUBLE, 'had_complications')},
    {_flag(f"{_AGE} > 35 OR {_PRESSURE} OR {_TROUBLE} OR {_named('hypertension')} OR {_named('diabetes')}", 'high_risk')}
  FROM patients p LEFT JOIN latest USING (patient_id)
  LEFT JOIN medical_history USING (patient_id)
  LEFT JOIN delivery_information USING (patient_id)
  WHERE lower(gender) = 'female'),
features AS (SELECT *, count(*) AS copies FROM training GROUP BY ALL)
"""
_CONTACT = ", ".join([_flag("coalesce(city, '') <> ''", "has_address"),
                      _flag("coalesce(phone, '') <> ''", "has_phone"),
                      _flag("coalesce(email, '') <> ''", "has_email"),
                      _flag("coalesce(insurance_provider, '') <> ''", "has_insurance")])
_LAGS = {"prev_temperature": "temperature", "prev_heart_rate": "heart_rate",
         "prev_bp_systolic": "blood_pressure_systolic",
         "prev_bp_diastolic": "blood_pressure_diastolic",
         "prev_respiratory_rate": "respiratory_rate",
         "prev_oxygen_saturation": "oxygen_saturation"}
_RISK_TABLES = "patients vitals medical_history delivery_information"
_FILLED = ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM training)) AS {c}"
    for c in _READINGS.split(", "))
_DRAW_KEYS = f"patient_id, {_READINGS}, has_hypertension, has_diabetes, has_asthma, had_complications"
_DRAW_TEXT = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in _DRAW_KEYS.split(", "))
_DRAW = f"CAST(('0x' || substr(md5('42|' || {_DRAW_TEXT}), 1, 8)) AS BIGINT) % 100"

# -- checks and updates -------------------------------------------------------

_WHOLE = r"'^\s*[+-]?[0-9]+\s*$'"
_NUMBER = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"


def _reading(column: str, label: str, low: int, high: int, form: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return (f"WHEN NOT regexp_matches({text}, {form}) THEN 'Invalid {label.lower()} value' "
            f"WHEN TRY_CAST({text} AS DOUBLE) NOT BETWEEN {low} AND {high} "
            f"THEN '{label} out of range ({low}-{high})'")


_CHECKED_VITALS = f"""checked AS (
  SELECT r.*, CASE {_reading('temperature', 'Temperature', 30, 45, _NUMBER)}
    {_reading('heart_rate', 'Heart rate', 30, 220, _WHOLE)}
    {_reading('blood_pressure_systolic', 'Systolic blood pressure', 70, 250, _WHOLE)}
    {_reading('blood_pressure_diastolic', 'Diastolic blood pressure', 40, 150, _WHOLE)}
    WHEN r.patient_id NOT IN (SELECT patient_id FROM patients) THEN 'Patient not found'
    WHEN recorded_at IS NULL THEN 'Invalid recorded_at value' END AS reject_reason
  FROM raw_vitals r)
"""


def _real_date(column: str) -> str:
    return (f"(regexp_matches({column}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') "
            f"AND TRY_CAST({column} AS DATE) IS NOT NULL)")


_CHECKED_PATIENTS = f"""checked AS (
  SELECT *, CASE WHEN first_name IS NULL THEN 'Missing required field: first_name'
    WHEN last_name IS NULL THEN 'Missing required field: last_name'
    WHEN date_of_birth IS NULL THEN 'Missing required field: date_of_birth'
    WHEN length(first_name) > 100 THEN 'Invalid first_name'
    WHEN length(last_name) > 100 THEN 'Invalid last_name'
    WHEN NOT {_real_date('date_of_birth')} THEN 'Invalid date_of_birth format'
    WHEN length(gender) > 20 THEN 'Too long: gender'
    WHEN length(email) > 100 THEN 'Too long: email' END AS reject_reason
  FROM raw_patients)
"""
_CHECKED_CHANGES = f"""checked AS (
  SELECT *, CASE WHEN patient_id NOT IN (SELECT patient_id FROM patients) THEN 'Patient not found'
    WHEN sets_last_name AND (last_name IS NULL OR length(last_name) > 100) THEN 'Invalid last_name'
    WHEN sets_date_of_birth AND NOT {_real_date('date_of_birth')} THEN 'Invalid date_of_birth format'
    WHEN NOT (sets_phone OR sets_city OR sets_last_name OR sets_date_of_birth OR sets_nickname)
      THEN 'No fields to update'
    WHEN sets_nickname THEN 'Unknown field' END AS reject_reason
  FROM raw_changes)
"""


def _last_set(column: str) -> str:
    """The value last set for a patient's column, else the old one."""
    change = (f"FROM checked c WHERE c.patient_id = p.patient_id AND reject_reason IS NULL "
              f"AND sets_{column}")
    value = f"CAST({column} AS DATE)" if column == "date_of_birth" else column
    return (f"CASE WHEN EXISTS ({change}) THEN (SELECT arg_max(struct_pack(v := {value}), change_id).v "
            f"{change}) ELSE p.{column} END AS {column}")


_AUDITED = "patients medical_history vitals medications appointments doctors delivery_information follow_up_visits"


def _audit() -> str:
    """Every rule of the declared tables that the derived columns can break."""
    required = {
        "patients": "patient_id first_name last_name date_of_birth",
        "medical_history": "history_id patient_id condition_name",
        "vitals": "vital_id patient_id recorded_at",
        "medications": "medication_id patient_id medication_name",
        "appointments": "appointment_id patient_id appointment_date",
        "doctors": "doctor_id first_name last_name",
        "delivery_information": "delivery_id patient_id",
        "follow_up_visits": "visit_id patient_id visit_date"}
    lengths = {
        "patients": "patient_id 50 first_name 100 last_name 100 gender 20 email 100 phone 20 "
                    "city 100 state 50 insurance_provider 100",
        "medical_history": "patient_id 50 condition_name 100",
        "vitals": "patient_id 50",
        "medications": "patient_id 50 medication_name 100",
        "appointments": "patient_id 50 reason 255 status 50",
        "doctors": "first_name 100 last_name 100",
        "delivery_information": "patient_id 50 delivery_method 100 attending_doctor 100",
        "follow_up_visits": "patient_id 50"}
    parts = []
    for table in _AUDITED.split():
        def row(rule: str, column: str, source: str) -> str:
            return (f"SELECT '{table}' AS table_name, '{rule}' AS rule, '{column}' AS column_name, "
                    f"count(*) AS violations FROM {source}")
        columns = required[table].split()
        parts += [row("not_null", c, f"{table} WHERE {c} IS NULL") for c in columns]
        limits = lengths[table].split()
        parts += [row("length", c, f"{table} WHERE length({c}) > {n}")
                  for c, n in zip(limits[::2], limits[1::2])]
        key = columns[0]
        parts.append(row("unique", key,
                         f"(SELECT {key} FROM {table} GROUP BY {key} HAVING count(*) > 1)"))
        if "patient_id" in columns[1:]:
            parts.append(row("foreign_key", "patient_id",
                             f"{table} ANTI JOIN patients USING (patient_id)"))
    return "\nUNION ALL\n".join(parts)


def _json_list(table: str, columns: str, order: str) -> str:
    """A child table as one JSON array per patient, missing values as null.

    DuckDB drops the last zero of a decimal; the replacement puts it back.
    """
    entry = (f"regexp_replace(CAST(to_json(struct_pack({columns})) AS VARCHAR), "
             r"""'("(temperature|oxygen_saturation|birth_weight)":[0-9]+\.[0-9])([,}])', '\10\3', 'g')""")
    return (f"{table}_json AS (SELECT patient_id, '[' || string_agg({entry}, ',' ORDER BY {order}) "
            f"|| ']' AS entries FROM {table} GROUP BY patient_id)")


def _iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S')"


_PROFILE = "STEP " + ",\n".join([
    _json_list("medical_history", "history_id := history_id, patient_id := patient_id, "
               "condition_name := condition_name, diagnosis_date := diagnosis_date",
               "history_id"),
    _json_list("vitals", f"vital_id := vital_id, patient_id := patient_id, "
               f"recorded_at := {_iso('recorded_at')}, temperature := temperature, "
               "heart_rate := heart_rate, blood_pressure_systolic := blood_pressure_systolic, "
               "blood_pressure_diastolic := blood_pressure_diastolic, "
               "respiratory_rate := respiratory_rate, oxygen_saturation := oxygen_saturation",
               "recorded_at DESC, vital_id DESC"),
    _json_list("medications", "medication_id := medication_id, patient_id := patient_id, "
               "medication_name := medication_name, start_date := start_date, "
               "end_date := end_date", "medication_id"),
    _json_list("appointments", "appointment_id := appointment_id, patient_id := patient_id, "
               f"doctor_id := doctor_id, appointment_date := {_iso('appointment_date')}, "
               "reason := reason, status := status",
               "appointment_date DESC, appointment_id DESC"),
    _json_list("delivery_information", "delivery_id := delivery_id, patient_id := patient_id, "
               "delivery_date := delivery_date, delivery_method := delivery_method, "
               "complications := complications, birth_weight := birth_weight, "
               "attending_doctor := attending_doctor", "delivery_id"),
]) + """
SELECT p.*, CAST(0 AS BIGINT) AS page, coalesce(m.entries, '[]') AS medical_history,
  coalesce(v.entries, '[]') AS vitals, coalesce(d.entries, '[]') AS medications,
  coalesce(a.entries, '[]') AS appointments, coalesce(i.entries, '[]') AS delivery_information
FROM patients p LEFT JOIN medical_history_json m USING (patient_id)
LEFT JOIN vitals_json v USING (patient_id) LEFT JOIN medications_json d USING (patient_id)
LEFT JOIN appointments_json a USING (patient_id)
LEFT JOIN delivery_information_json i USING (patient_id)"""
_PROFILE_TABLES = "patients medical_history vitals medications appointments delivery_information"
_OVERDUE = """CASE WHEN days_overdue > 30 THEN 'danger' WHEN days_overdue > 14 THEN 'warning'
  ELSE 'info' END AS overdue_band"""
_RISK_BAND = """CASE risk_category WHEN 'Age Risk' THEN 'warning' WHEN 'Hypertension Risk' THEN 'danger'
  WHEN 'Previous Complications' THEN 'danger' ELSE 'success' END AS risk_band"""


# -- checks of the model chain ----------------------------------------------------

_DRAW_48 = f"CAST(('0x' || substr(md5('42|' || {_DRAW_TEXT}), 1, 12)) AS BIGINT)"
_STRATIFIED = f"""
SELECT * EXCLUDE (_place, _rows), CASE WHEN _place <= (2 * _rows * 20 + 100) // 200 THEN 'test'
  ELSE 'train' END AS part
FROM (SELECT *, row_number() OVER (PARTITION BY high_risk ORDER BY {_DRAW_48}) AS _place,
  count(*) OVER (PARTITION BY high_risk) AS _rows FROM features)"""


def _rule_metrics() -> str:
    rows = []
    for c in (0, 1):
        rows += [f"SELECT 'precision', '{c}', p{c} FROM m", f"SELECT 'recall', '{c}', r{c} FROM m",
                 f"SELECT 'f1', '{c}', f{c} FROM m", f"SELECT 'support', '{c}', real{c} FROM m"]
    for name, short in (("precision", "p"), ("recall", "r"), ("f1", "f")):
        rows += [f"SELECT '{name}', 'macro avg', ({short}0 + {short}1) / 2 FROM m",
                 f"SELECT '{name}', 'weighted avg', ({short}0 * real0 + {short}1 * real1) "
                 f"/ (real0 + real1) FROM m"]
    rows += ["SELECT 'accuracy', NULL, (hit0 + hit1) / (real0 + real1) FROM m",
             "SELECT 'roc_auc', NULL, area FROM curve"]

    def total(condition: str) -> str:
        return f"coalesce(sum(copies) FILTER (WHERE {condition}), 0)::DOUBLE"

    counts = ", ".join(
        f"{total(f'label = {c} AND said = {c}')} AS hit{c}, {total(f'said = {c}')} AS said{c}, "
        f"{total(f'label = {c}')} AS real{c}" for c in (0, 1))
    shares = ", ".join(
        f"coalesce(hit{c} / nullif(said{c}, 0), 0) AS p{c}, "
        f"coalesce(hit{c} / nullif(real{c}, 0), 0) AS r{c}, "
        f"coalesce(2 * hit{c} / nullif(said{c} + real{c}, 0), 0) AS f{c}" for c in (0, 1))
    return f"""{_RISK_FEATURES}, scored AS (
  SELECT high_risk AS label, copies,
    (coalesce(age, 0) * 7 + coalesce(heart_rate, 0) * 3) % 101 AS score FROM features),
judged AS (SELECT *, CASE WHEN score >= 50 THEN 1 ELSE 0 END AS said FROM scored),
counts AS (SELECT {counts} FROM judged),
m AS (SELECT *, {shares} FROM counts),
curve AS (
  SELECT sum(a.copies * b.copies * CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score
    THEN 0.5 ELSE 0.0 END)::DOUBLE / sum(a.copies * b.copies)::DOUBLE AS area
  FROM (SELECT score, sum(copies) AS copies FROM scored WHERE label = 1 GROUP BY 1) a,
    (SELECT score, sum(copies) AS copies FROM scored WHERE label = 0 GROUP BY 1) b),
said(metric, label, value) AS ({" UNION ALL ".join(rows)})
SELECT metric, label, round(value, 9) AS value FROM said"""


_FOLLOWUP = f"""
SELECT p.patient_id, f.visit_id, {_AGE} AS age, coalesce(gender, 'Unknown') AS gender, {_CONTACT},
  CAST(f.follow_up_date - f.visit_date AS INTEGER) AS days_between_visits,
  {_flag(f'''f.follow_up_required AND f.follow_up_date < {TODAY} AND NOT EXISTS (
    FROM follow_up_visits later
    WHERE later.patient_id = p.patient_id AND later.visit_date > f.follow_up_date)''', 'missed_followup')}
FROM patients p JOIN follow_up_visits f ON p.patient_id = f.patient_id"""
_FOLLOWUP_NUMBERS = ("age has_address has_phone has_email has_insurance "
                     "days_between_visits").split()


def _followup_prepared() -> str:
    filled = ", ".join(f"coalesce({c}::DOUBLE, (SELECT median({c}) FROM rows)) AS {c}"
                       for c in _FOLLOWUP_NUMBERS)
    scaled = ", ".join(
        f"round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0), 6) "
        f"AS scaled_{c}" for c in _FOLLOWUP_NUMBERS)
    # Categories by falling frequency, equal ones by name.
    return f"""STEP rows AS ({_FOLLOWUP}),
kinds AS (SELECT gender, row_number() OVER (ORDER BY count(*) DESC, gender) AS place
  FROM rows GROUP BY gender),
filled AS (SELECT visit_id, gender, {filled} FROM rows)
SELECT visit_id, {scaled},
  {", ".join(f"CASE WHEN place = {i + 1} THEN 1.0 ELSE 0.0 END::DOUBLE AS gender_{i}"
             for i in range(3))}
FROM filled JOIN kinds USING (gender)"""


def oracles(derived: bool = True) -> dict[str, str]:
    """The SQL by query name; without derivations it expects the hospital tables."""
    def _query(tables: str, body: str) -> str:
        # STEP marks a body that opens with WITH clauses of its own.
        steps = body.startswith("STEP ")
        body = body.removeprefix("STEP ")
        if not derived:
            return f"WITH {body}" if steps else body
        return f"{oracle_ctes(*tables.split())}{',' if steps else ''}\n{body}"

    found = {
        "high_risk": _query("patients vitals delivery_information",
                            _HIGH_RISK + "FROM high_risk"),
        "high_risk_bands": _query("patients vitals delivery_information",
                                  _HIGH_RISK + f"SELECT *, {_RISK_BAND} FROM high_risk"),
        "missed_follow_ups": _query("patients follow_up_visits", f"STEP {_MISSED} FROM missed"),
        "missed_follow_ups_bands": _query("patients follow_up_visits",
                                          f"STEP {_MISSED} SELECT *, {_OVERDUE} FROM missed"),
        "abnormal_vitals": _query("patients vitals", f"""STEP {_SUMMARY}
SELECT {_NAME}, s.* FROM summary s JOIN patients USING (patient_id)"""),
        "delivery_methods": _query("delivery_information", f"""
SELECT min(attending_doctor) AS attending_doctor, count(*) AS total_deliveries,
  {_count("lower(delivery_method) = 'vaginal'")} AS vaginal_deliveries,
  {_count("lower(delivery_method) = 'c-section'")} AS c_section_deliveries,
  ((20000 * {_count("lower(delivery_method) = 'c-section'")} + count(*)) // (2 * count(*))) / 100.0
    AS c_section_rate,
  {_mean('birth_weight')} AS avg_birth_weight
FROM delivery_information GROUP BY lower(attending_doctor)"""),
        "demographics": _query("patients medical_history delivery_information", f"""STEP {_JOINED}
SELECT age_group, min(city) AS city, min(state) AS state, count(*) AS patient_count,
  count(DISTINCT condition_name) AS unique_conditions,
  count(DISTINCT delivery_id) AS delivery_count, count(DISTINCT patient_id) AS distinct_patients
FROM joined GROUP BY age_group, lower(city), lower(state)"""),
        "age_distribution": _query("patients medical_history delivery_information",
                                   f"""STEP {_JOINED}
SELECT age_group, count(*) AS patient_count FROM joined GROUP BY age_group"""),
        "dashboard_totals": _query(
            "patients vitals medical_history delivery_information follow_up_visits",
            f"""{_HIGH_RISK}, {_MISSED}, {_JOINED}
SELECT (SELECT count(*) FROM joined) AS total_patients,
  (SELECT count(*) FROM high_risk) AS high_risk, (SELECT count(*) FROM missed) AS missed_follow_ups,
  (SELECT count(DISTINCT delivery_id) FROM joined) AS deliveries,
  (SELECT count(DISTINCT delivery_id) FROM joined
   WHERE date_trunc('month', delivery_date) = date_trunc('month', {TODAY})) AS deliveries_this_month"""),
        "patient_profile": _query(_PROFILE_TABLES, _PROFILE),
        "one_patient_profile": _query(_PROFILE_TABLES,
                                      _PROFILE + " WHERE p.patient_id = 'P00000001'"),
        "patients": _query("patients", "FROM patients"),
        "patient": _query("patients", "FROM patients WHERE patient_id = 'P00000001'"),
        "patients_json": _query("patients",
                                "SELECT CAST(to_json(p) AS VARCHAR) AS json FROM patients p"),
        "search_patients": _query("patients", """FROM patients
WHERE contains(lower(first_name || ' ' || last_name), 'pat 00000001')
  OR contains(CAST(date_of_birth AS VARCHAR), 'pat 00000001')"""),
        "search_patients_short_indexed": _query("patients", """FROM patients
WHERE contains(lower(first_name || ' ' || last_name), '7')
  OR contains(CAST(date_of_birth AS VARCHAR), '7')"""),
        "search_patients_by_birth": _query("patients", """FROM patients
WHERE contains(lower(first_name || ' ' || last_name), '1990-0')
  OR contains(CAST(date_of_birth AS VARCHAR), '1990-0')"""),
        "recent_vitals": _query("vitals", f"""
SELECT patient_id, CAST(row_number() OVER newest AS INTEGER) AS position, vital_id, recorded_at,
  {_shown('temperature')}, {_shown('heart_rate')},
  CASE WHEN blood_pressure_systolic <> 0 AND blood_pressure_diastolic <> 0
    THEN blood_pressure_systolic || '/' || blood_pressure_diastolic ELSE 'N/A' END AS blood_pressure,
  {_shown('respiratory_rate')}, {_shown('oxygen_saturation')}
FROM vitals WINDOW newest AS (PARTITION BY patient_id ORDER BY recorded_at DESC, vital_id DESC)
QUALIFY row_number() OVER newest <= 5"""),
        "appointment_split": _query("appointments", f"""STEP sides AS (
  SELECT *, CASE WHEN appointment_date >= {SPLIT_TIME} THEN 'upcoming' ELSE 'past' END AS period
  FROM appointments)
SELECT *, CASE period
    WHEN 'upcoming' THEN row_number() OVER (PARTITION BY patient_id, period ORDER BY appointment_date, appointment_id)
    ELSE row_number() OVER (PARTITION BY patient_id, period ORDER BY appointment_date DESC, appointment_id DESC)
  END AS position
FROM sides QUALIFY period = 'upcoming' OR position <= 3"""),
        "deliveries_by_patient": _query("delivery_information", """
SELECT *, row_number() OVER (PARTITION BY patient_id
  ORDER BY delivery_date DESC NULLS LAST, delivery_id DESC) AS position
FROM delivery_information"""),
        "monthly_visits": _query("follow_up_visits", """
SELECT CAST(date_trunc('month', visit_date) AS DATE) AS month, count(*) AS visits
FROM follow_up_visits GROUP BY 1"""),
        "filter_high_risk": _query("patients vitals delivery_information", _HIGH_RISK +
                                   "FROM patients SEMI JOIN high_risk USING (patient_id)"),
        "filter_missed_follow_up": _query("patients follow_up_visits", f"""STEP {_MISSED}
FROM patients SEMI JOIN missed USING (patient_id)"""),
        "filter_recent_delivery": _query("patients delivery_information", f"""
FROM patients WHERE patient_id IN (SELECT patient_id FROM delivery_information
  WHERE delivery_date BETWEEN {TODAY} - 365 AND {TODAY})"""),
        "patients_page": _query("patients", """
FROM patients WHERE patient_id > 'P00000020' ORDER BY patient_id LIMIT 20"""),

        "risk_features": _query(_RISK_TABLES, _RISK_FEATURES + "FROM features"),
        "risk_features_filled": _query(
            _RISK_TABLES, _RISK_FEATURES + f"SELECT * REPLACE ({_FILLED}) FROM features"),
        "risk_features_split": _query(_RISK_TABLES, _RISK_FEATURES + f"""
SELECT *, CASE WHEN {_DRAW} < 20 THEN 'test' ELSE 'train' END AS part FROM features"""),
        "risk_features_stratified": _query(_RISK_TABLES, _RISK_FEATURES + _STRATIFIED),
        "risk_rule_metrics": _query(_RISK_TABLES, _rule_metrics()),
        "risk_features_serving": _query("patients vitals medical_history", f"""STEP {_latest(False)},
held AS (
  SELECT patient_id, max(has_hypertension) AS has_hypertension, max(has_diabetes) AS has_diabetes,
    max(has_asthma) AS has_asthma
  FROM (SELECT patient_id, {_FLAGS} FROM medical_history) GROUP BY patient_id)
SELECT p.patient_id, {_AGE} AS age, {_READINGS}, coalesce(has_hypertension, 0) AS has_hypertension,
  coalesce(has_diabetes, 0) AS has_diabetes, coalesce(has_asthma, 0) AS has_asthma
FROM patients p LEFT JOIN latest USING (patient_id) LEFT JOIN held USING (patient_id)"""),
        "followup_features": _query("patients follow_up_visits", _FOLLOWUP),
        "followup_features_prepared": _query("patients follow_up_visits", _followup_prepared()),
        "followup_features_serving": _query("patients follow_up_visits", f"""STEP latest AS (
  FROM follow_up_visits QUALIFY row_number() OVER
    (PARTITION BY patient_id ORDER BY visit_date DESC, visit_id DESC) = 1)
SELECT p.patient_id, {_AGE} AS age, gender, {_CONTACT},
  CAST(follow_up_date - visit_date AS INTEGER) AS days_between_visits
FROM patients p LEFT JOIN latest USING (patient_id)"""),
        "vitals_lag_features": _query("patients vitals", f"""STEP lagged AS (
  SELECT patient_id, vital_id, recorded_at, blood_pressure_systolic,
    {', '.join(f'lag({old}) OVER earlier AS {new}' for new, old in _LAGS.items())}
  FROM vitals WINDOW earlier AS (PARTITION BY patient_id ORDER BY recorded_at, vital_id))
SELECT patient_id, vital_id, recorded_at, coalesce(gender, 'Unknown') AS gender,
  {_years('recorded_at')} AS age_at_recording, {', '.join(_LAGS)}, blood_pressure_systolic
FROM lagged JOIN patients USING (patient_id)
WHERE prev_temperature IS NOT NULL AND prev_heart_rate IS NOT NULL
  AND prev_bp_systolic IS NOT NULL AND prev_bp_diastolic IS NOT NULL"""),
        "vitals_features_serving": _query("patients vitals", f"""STEP {_latest(False)}
SELECT p.patient_id, {_AGE} AS age_at_recording,
  {', '.join(f'{old} AS {new}' for new, old in _LAGS.items())}
FROM patients p JOIN latest USING (patient_id)"""),

        "check_vitals": _query("raw_vitals patients", f"STEP {_CHECKED_VITALS} FROM checked"),
        "check_vitals_stream": _query("raw_vitals patients",
                                      f"STEP {_CHECKED_VITALS} FROM checked"),
        "abnormal_vitals_stream": _query("vitals", f"STEP {_SUMMARY} FROM summary"),
        "append_vitals": _query("raw_vitals patients vitals", f"""STEP {_CHECKED_VITALS}
SELECT (SELECT max(vital_id) FROM vitals) + row_number() OVER (ORDER BY row_id) AS vital_id,
  patient_id, recorded_at, CAST(temperature AS DECIMAL(5,2)) AS temperature,
  CAST(heart_rate AS INTEGER) AS heart_rate, blood_pressure_systolic, blood_pressure_diastolic
FROM checked WHERE reject_reason IS NULL"""),
        "check_patients": _query("raw_patients", f"STEP {_CHECKED_PATIENTS} FROM checked"),
        "append_patients": _query("raw_patients patients", f"""STEP {_CHECKED_PATIENTS}
SELECT 'P' || upper(substr(sha256('|' || CAST(row_id AS VARCHAR)), 1, 32)) AS patient_id,
  first_name, last_name, CAST(date_of_birth AS DATE) AS date_of_birth, gender, email,
  {NOW} AS created_at, {NOW} AS updated_at
FROM checked WHERE reject_reason IS NULL"""),
        "append_patients_batches": _query("raw_patients patients", f"""STEP {_CHECKED_PATIENTS}
SELECT patient_id, first_name, last_name, date_of_birth FROM patients
UNION ALL
SELECT 'P' || upper(substr(sha256(batch || '|' || CAST(row_id AS VARCHAR)), 1, 32)),
  first_name, last_name, CAST(date_of_birth AS DATE)
FROM checked CROSS JOIN (VALUES ('1'), ('2'), ('3')) b(batch) WHERE reject_reason IS NULL"""),
        "partial_update": _query("raw_changes patients", f"""STEP {_CHECKED_CHANGES},
renewed AS (
  SELECT patient_id, first_name, {_last_set('last_name')}, {_last_set('date_of_birth')}, gender,
    email, {_last_set('phone')}, {_last_set('city')}, state, insurance_provider
  FROM patients p)
SELECT n.*, CASE WHEN n.last_name IS DISTINCT FROM p.last_name
    OR n.date_of_birth IS DISTINCT FROM p.date_of_birth
    OR n.phone IS DISTINCT FROM p.phone OR n.city IS DISTINCT FROM p.city
  THEN {NOW} END AS updated_at
FROM renewed n JOIN patients p ON n.patient_id = p.patient_id"""),
        "partial_update_rejected": _query("raw_changes patients", f"""STEP {_CHECKED_CHANGES}
SELECT change_id, patient_id, reject_reason FROM checked WHERE reject_reason IS NOT NULL"""),
        "audit": _query(_AUDITED, _audit()),
        "delete_by_key": _query("vitals delivery_information", """
FROM vitals ANTI JOIN delivery_information ON vital_id = delivery_id"""),
    }
    # Other ways to the same rows.
    return found | {other: found[name] for other, name in {
        "search_patients_indexed": "search_patients",
        "dashboard_totals_maintained": "dashboard_totals",
        "age_distribution_maintained": "age_distribution",
        "search_patients_by_birth_indexed": "search_patients_by_birth",
        "one_patient_profile_lookup": "one_patient_profile",
        "partial_update_written": "partial_update",
        "delete_by_key_written": "delete_by_key",
    }.items()}
