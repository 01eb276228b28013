"""Column names and fixed values of the hospital-visit preset.

Every operator takes column names as parameters; this module only holds the
defaults. All values below are fixed values: they decide the results and must
stay as they are.
"""

from __future__ import annotations

# Keys and labels.
ID_COLUMN = "encounter_id"
ENTITY_COLUMN = "patient_nbr"
IDENTIFIER_COLUMNS = (ID_COLUMN, ENTITY_COLUMN)
TARGET_COLUMN = "readmitted"
BINARY_TARGET_COLUMN = "readmitted_30d"
CLASS_LABELS = ("NO", ">30", "<30")
POSITIVE_LABEL = "<30"

# Columns a raw table must have, and columns that hold counts.
REQUIRED_COLUMNS = (
    "encounter_id", "patient_nbr", "readmitted", "age", "race", "gender",
    "time_in_hospital", "num_lab_procedures", "num_medications",
    "number_outpatient", "number_emergency", "number_inpatient",
)
COUNT_COLUMNS = (
    "time_in_hospital", "num_lab_procedures", "num_medications",
    "number_outpatient", "number_emergency", "number_inpatient",
    "number_diagnoses",
)
UTILIZATION_COLUMNS = (
    "time_in_hospital", "num_lab_procedures", "num_procedures",
    "num_medications", "number_outpatient", "number_emergency",
    "number_inpatient",
)

# Medication columns (status columns, then two more by role).
STATUS_COLUMNS = (
    "metformin", "repaglinide", "nateglinide", "chlorpropamide",
    "glimepiride", "acetohexamide", "glipizide", "glyburide", "tolbutamide",
    "pioglitazone", "rosiglitazone", "acarbose", "miglitol", "troglitazone",
    "tolazamide", "examide", "citoglipton", "insulin", "glyburide-metformin",
    "glipizide-metformin", "glimepiride-pioglitazone",
    "metformin-rosiglitazone", "metformin-pioglitazone",
)
MEDICATION_ROLE_COLUMNS = STATUS_COLUMNS + ("change", "diabetesmed")
STATUS_VALUES = ("NO", "STEADY", "UP", "DOWN")
CHANGED_VALUES = ("UP", "DOWN")

# Feature definitions.
DIAGNOSES_ALIASES = ("num_diagnoses", "number_diagnoses")
HOME_DISPOSITION_IDS = (1, 6, 8)
# (column, divisor, weight); None stands for the diagnoses column.
SEVERITY_TERMS = (
    ("time_in_hospital", 14.0, 0.30),
    (None, 16.0, 0.25),
    ("number_inpatient", 10.0, 0.20),
    ("number_outpatient", 10.0, 0.15),
    ("number_emergency", 10.0, 0.10),
)
VISIT_COUNT_COLUMNS = ("number_inpatient", "number_outpatient", "number_emergency")
ENGINEERED_FEATURES = (
    "recurrency", "patient_severity", "medication_change_ratio",
    "utilization_intensity", "complex_discharge_flag", "age_bucket_risk",
)
MONITORED_COLUMNS = (
    "time_in_hospital", "num_medications", "number_diagnoses",
    "utilization_intensity", "patient_severity", "medication_change_ratio",
    "recurrency", "complex_discharge_flag", "age_bucket_risk",
)

# Text of the data dictionary.
COLUMN_DESCRIPTIONS = {
    "encounter_id": "Encounter-level identifier for each hospital visit.",
    "patient_nbr": "Patient-level identifier shared across multiple encounters.",
    "readmitted": "Readmission label indicating timing of return admission.",
    "age": "Age bucket at time of encounter.",
    "race": "Self-reported race category.",
    "gender": "Patient gender category.",
    "time_in_hospital": "Length of stay in days.",
    "num_lab_procedures": "Number of laboratory procedures during encounter.",
    "num_medications": "Number of medications prescribed during encounter.",
    "number_outpatient": "Prior outpatient visits count.",
    "number_emergency": "Prior emergency visits count.",
    "number_inpatient": "Prior inpatient visits count.",
}
ROLE_DESCRIPTIONS = {
    "medication-status": "Medication exposure or medication-change indicator for the encounter.",
    "diagnosis-like": "Diagnosis code feature captured during or around the encounter.",
    "identifier": "Identifier-like field used for entity tracking and deduplication checks.",
    "target": "Prediction target field.",
    "numeric": "Numeric feature likely suitable for descriptive statistics and scaling decisions.",
    "categorical": "Categorical feature representing grouped or coded patient/encounter context.",
}

# The typed fields of one raw visit row.
LONG_FIELDS = (
    "encounter_id", "patient_nbr", "admission_type_id",
    "discharge_disposition_id", "admission_source_id", "time_in_hospital",
    "num_lab_procedures", "num_procedures", "num_medications",
    "number_outpatient", "number_emergency", "number_inpatient",
    "number_diagnoses",
)
TEXT_FIELDS = (
    "race", "gender", "age", "weight", "payer_code", "medical_specialty",
    "diag_1", "diag_2", "diag_3", "max_glu_serum", "A1Cresult",
) + STATUS_COLUMNS + ("change", "diabetesMed", "readmitted")
INTEGER_INPUTS = LONG_FIELDS[2:] + ("recurrency", "complex_discharge_flag", "age_bucket_risk")
FLOAT_INPUTS = ("patient_severity", "medication_change_ratio", "utilization_intensity")
