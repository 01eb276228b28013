"""Split and feature queries with their SQL texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.operators import features as fe
from cohortry.operators import split as sp
from cohortry.plans.visits import (
    FEATURES_SQL, INTAKE_SQL, STATUS_LINES, VISITS_SQL, intake, split_sql, visits,
)
from cohortry.presets import ENGINEERED_FEATURES, ENTITY_COLUMN
from cohortry.sources.scratch import keep_methods_compiled, settle

STATUSES = list(STATUS_LINES)


def _hash_split(spark, sf, exact=False):
    return sp.split_by_entity(intake(spark, sf), seed=42, exact=exact)


def split_by_entity_hash(spark, sf):
    return _hash_split(spark, sf).select("encounter_id", "split")


def split_by_entity_exact(spark, sf):
    return _hash_split(spark, sf, exact=True).select("encounter_id", "split")


def split_entity_overlap(spark, sf):
    """Overlap of a row-wise split, which does leak entities."""
    rows = sp.split_by_entity(intake(spark, sf), entity="encounter_id", seed=42)
    return sp.entity_overlap(rows, "patient_nbr")


def split_shared_entities(spark, sf):
    rows = sp.split_by_entity(intake(spark, sf), entity="encounter_id", seed=42)
    return sp.shared_entities(rows.where("split = 'train'"), rows.where("split = 'test'"),
                              "patient_nbr")


def split_manifest(spark, sf):
    return sp.split_manifest(_hash_split(spark, sf), labels=("readmitted",))


def engineered(spark, sf, once=False):
    """The feature table of the visits, split included; statuses found on train. With
    ``once`` the visits are written, and orders and lines are joined a single time."""
    keep_methods_compiled(spark)
    rows = sp.split_by_entity(visits(spark, sf), seed=42, check=False)
    # Checks, statuses, group sizes and features all read the visits.
    rows = settle(rows) if once else rows
    sp.check_entities(rows, ENTITY_COLUMN)
    statuses = fe.detect_status_columns(rows.where("split = 'train'"))
    # The split has already checked the entity key.
    return fe.engineer_features(rows, status_columns=statuses, check=False).frame


def recurrency(spark, sf):
    return fe.with_recurrency(_hash_split(spark, sf)).select("encounter_id", "split", "recurrency")


def engineered_features(spark, sf):
    frame = engineered(spark, sf)
    rounded = {c: F.round(F.col(c).cast("double"), 5) for c in
               ("patient_severity", "medication_change_ratio", "utilization_intensity")}
    whole = {c: F.col(c).cast("int") for c in ("complex_discharge_flag", "age_bucket_risk")}
    return frame.withColumns({**rounded, **whole}).select("encounter_id", *ENGINEERED_FEATURES)


def status_columns(spark, sf):
    rows = visits(spark, sf).withColumnRenamed("race", "acarbose")
    return fe.status_column_flags(rows)


def feature_fallbacks(spark, sf):
    return fe.fallback_counts(visits(spark, sf), STATUSES)


def feature_stats(spark, sf):
    found = fe.feature_stats(engineered(spark, sf))
    return found.withColumns({c: F.round(c, 5) for c in
                              ("mean", "std", "min", "max", "missing_rate")})


def feature_lineage(spark, sf):
    """Lineage rows with the row count behind each column."""
    rows = sp.split_by_entity(visits(spark, sf), seed=42)
    built = fe.engineer_features(rows, status_columns=STATUSES, check=False)
    filled = built.frame.agg(*[F.count(F.col(c)).alias(c) for c in built.frame.columns])
    counted = filled.unpivot([], list(built.frame.columns), "column", "filled_rows")
    return built.lineage().join(counted, "column").select(
        "column", "origin", "model_candidate", F.array_join("sources", "|").alias("sources"),
        "filled_rows")


QUERIES = {f.__name__: f for f in (
    split_by_entity_hash, split_by_entity_exact, split_entity_overlap, split_shared_entities,
    split_manifest, recurrency, engineered_features, status_columns, feature_fallbacks,
    feature_stats, feature_lineage)}

_ROW_SPLIT = f"row_split AS (SELECT *, {split_sql('encounter_id')} AS split FROM intake)"
_ENTITY_SPLIT = f"entity_split AS (SELECT *, {split_sql('patient_nbr')} AS split FROM intake)"


def _lineage_sql() -> str:
    sources = {
        "recurrency": "patient_nbr",
        "patient_severity": "time_in_hospital|number_diagnoses|number_inpatient|"
                            "number_outpatient|number_emergency",
        "medication_change_ratio": "|".join(STATUSES),
        "utilization_intensity": "number_inpatient|number_outpatient|number_emergency",
        "complex_discharge_flag": "discharge_disposition_id", "age_bucket_risk": "age"}
    raw = ["race", "gender", "age", "discharge_disposition_id", "charge", "time_in_hospital",
           "num_medications", "number_diagnoses", "num_lab_procedures", "number_outpatient",
           "number_emergency", "number_inpatient", *STATUSES, "split"]
    rows = [("encounter_id", "identifier", False, ""), ("patient_nbr", "identifier", False, ""),
            ("readmitted", "target", False, ""), *[(c, "raw", True, "") for c in raw],
            *[(c, "engineered", True, s) for c, s in sources.items()]]
    return f"WITH {FEATURES_SQL} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{o}' AS origin, {m} AS model_candidate, '{s}' AS sources, "
        f"count({c}) AS filled_rows FROM features" for c, o, m, s in rows)


ORACLES = {
    "split_by_entity_hash":
        f"WITH {INTAKE_SQL}, {_ENTITY_SPLIT} SELECT encounter_id, split FROM entity_split",
    "split_by_entity_exact": f"""WITH {INTAKE_SQL}, e AS (SELECT DISTINCT patient_nbr,
md5('42:' || CAST(patient_nbr AS VARCHAR)) AS h FROM intake),
r AS (SELECT *, row_number() OVER (ORDER BY h) AS place, count(*) OVER () AS n FROM e),
c AS (SELECT *, CAST(floor(0.7::DOUBLE * n) AS BIGINT) AS n_train FROM r),
d AS (SELECT *, n_train + CAST(floor(0.5::DOUBLE * (n - n_train)) AS BIGINT) AS n_val FROM c)
SELECT encounter_id, CASE WHEN place <= n_train THEN 'train' WHEN place <= n_val THEN 'val'
ELSE 'test' END AS split FROM intake JOIN d USING (patient_nbr)""",
    "split_entity_overlap": f"""WITH {INTAKE_SQL}, {_ROW_SPLIT},
f AS (SELECT patient_nbr, bool_or(split = 'train') AS a, bool_or(split = 'val') AS b,
      bool_or(split = 'test') AS c FROM row_split GROUP BY 1)
SELECT count(*) FILTER (WHERE a AND b) AS train_val, count(*) FILTER (WHERE a AND c) AS train_test,
count(*) FILTER (WHERE b AND c) AS val_test FROM f""",
    "split_shared_entities": f"""WITH {INTAKE_SQL}, {_ROW_SPLIT}
SELECT patient_nbr FROM row_split WHERE split = 'train'
INTERSECT SELECT patient_nbr FROM row_split WHERE split = 'test'""",
    "split_manifest": f"""WITH {INTAKE_SQL}, {_ENTITY_SPLIT},
s AS (SELECT split, count(*) AS r, count(DISTINCT patient_nbr) AS e FROM entity_split GROUP BY 1)
SELECT 'size' AS section, split, 'rows' AS key, r AS value FROM s
UNION ALL SELECT 'size', split, 'entities', e FROM s
UNION ALL SELECT 'size', 'total', 'rows', CAST(sum(r) AS BIGINT) FROM s
UNION ALL SELECT 'size', 'total', 'entities', CAST(sum(e) AS BIGINT) FROM s
UNION ALL SELECT 'readmitted', split, trim(readmitted), count(*) FROM entity_split GROUP BY ALL
UNION ALL SELECT 'leakage', 'total', 'shared_entities', 0""",
    "recurrency": f"""WITH {INTAKE_SQL}, {_ENTITY_SPLIT} SELECT encounter_id, split,
CAST(count(*) OVER (PARTITION BY split, patient_nbr) - 1 AS INTEGER) AS recurrency
FROM entity_split""",
    "engineered_features": f"""WITH {FEATURES_SQL} SELECT encounter_id, recurrency,
round(patient_severity::DOUBLE, 5) AS patient_severity,
round(medication_change_ratio::DOUBLE, 5) AS medication_change_ratio,
round(utilization_intensity::DOUBLE, 5) AS utilization_intensity,
CAST(complex_discharge_flag AS INTEGER) AS complex_discharge_flag,
CAST(age_bucket_risk AS INTEGER) AS age_bucket_risk FROM features""",
    "status_columns": f"""WITH {VISITS_SQL}, cells AS (
SELECT 'acarbose' AS c, race AS s FROM visits
{' '.join(f"UNION ALL SELECT '{c}', {c} FROM visits" for c in STATUSES)})
SELECT c AS "column", coalesce(bool_or(upper(trim(s)) IN ('NO', 'STEADY', 'UP', 'DOWN')), false)
AS has_status FROM cells GROUP BY 1""",
    "feature_fallbacks": f"""WITH {FEATURES_SQL} SELECT
(SELECT count(*) FROM statuses WHERE seen = 0) AS medication_change_ratio_zero_denominator,
count(*) FILTER (WHERE try_cast(discharge_disposition_id AS DOUBLE) IS NULL)
  AS complex_discharge_flag_missing_or_malformed,
count(*) FILTER (WHERE NOT regexp_matches(age, '^\\[\\d+-\\d+\\)$'))
  AS age_bucket_risk_missing_or_malformed FROM visits""",
    "feature_stats": f"""WITH {FEATURES_SQL}, cells AS ({' UNION ALL '.join(
        f"SELECT split, '{c}' AS feature, {c}::DOUBLE AS x FROM features"
        for c in ENGINEERED_FEATURES)})
SELECT split, feature, round(avg(x), 5) AS mean, round(stddev_samp(x), 5) AS std,
round(min(x), 5) AS min, round(max(x), 5) AS max, count(*) FILTER (WHERE x IS NULL) AS missing_count,
round(count(*) FILTER (WHERE x IS NULL) / count(*), 5) AS missing_rate
FROM cells GROUP BY ALL""",
    "feature_lineage": _lineage_sql(),
}
