"""Feature building on a visit table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry import presets
from cohortry.functions import features as fx
from cohortry.functions.tokens import is_null, parse_number, sql_name, sql_text
from cohortry.operators.schema import feature_lineage, first_present, require_columns
from cohortry.operators.skew import attach_group_size


def status_column_flags(df: DataFrame, candidates=presets.STATUS_COLUMNS) -> DataFrame:
    """Per candidate column: does it hold at least one known status?"""
    present = [c for c in candidates if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "column string, has_status boolean")
    one_row = df.selectExpr(*[f"coalesce(bool_or({fx.has_status(c)}), false) AS c{i}"
                              for i, c in enumerate(present)])
    rows = [f"struct({sql_text(c)} AS column, c{i} AS has_status)" for i, c in enumerate(present)]
    return one_row.selectExpr(f"inline(array({', '.join(rows)}))")


def detect_status_columns(df: DataFrame, candidates=presets.STATUS_COLUMNS) -> list[str]:
    """Names of the columns that hold statuses, in candidate order.

    Run it on the train split and pass the result on for the other splits.
    """
    found = {r["column"] for r in status_column_flags(df, candidates).collect() if r["has_status"]}
    return [c for c in candidates if c in found]


def with_recurrency(df: DataFrame, entity: str = presets.ENTITY_COLUMN,
                    within: str | None = "split", check: bool = True) -> DataFrame:
    """Other rows of the same entity, counted within one split."""
    require_columns(df, [entity], "recurrency")
    if check and df.where(is_null(df, entity)).limit(1).count():
        raise ValueError(f"column {entity} has missing values")
    keys = [within, entity] if within and within in df.columns else [entity]
    # Entities with one row need no size row: they have no other rows.
    sized = attach_group_size(df, keys, "_rows", at_least=2)
    return (sized.withColumn("recurrency", F.coalesce(F.col("_rows") - 1, F.lit(0)).cast("int"))
            .drop("_rows"))


@dataclass(frozen=True)
class FeatureTable:
    frame: DataFrame
    status_columns: list[str]
    ignored_columns: list[str]
    source_map: dict[str, list[str]]
    original_columns: list[str]

    def lineage(self) -> DataFrame:
        return feature_lineage(self.frame, self.original_columns, self.source_map)


def engineer_features(df: DataFrame, entity: str = presets.ENTITY_COLUMN,
                      status_columns=None, within: str | None = "split",
                      check: bool = True) -> FeatureTable:
    """All six features. Five are one projection, the sixth is a keyed join."""
    original = list(df.columns)
    diagnoses = first_present(df)
    require_columns(df, [n for n, _, _ in presets.SEVERITY_TERMS if n], "patient_severity")
    require_columns(df, ["discharge_disposition_id", "age"], "feature building")
    wanted = detect_status_columns(df) if status_columns is None else list(status_columns)
    statuses = [c for c in wanted if c in df.columns]
    frame = with_recurrency(df, entity, within, check).withColumns({
        "patient_severity": fx.severity(df, diagnoses),
        "medication_change_ratio": fx.change_ratio(statuses),
        "utilization_intensity": fx.utilization(df),
        "complex_discharge_flag": fx.complex_discharge(df, "discharge_disposition_id"),
        "age_bucket_risk": fx.age_bucket("age"),
    })
    sources = {
        "recurrency": [entity],
        "patient_severity": [n or diagnoses for n, _, _ in presets.SEVERITY_TERMS],
        "medication_change_ratio": statuses,
        "utilization_intensity": list(presets.VISIT_COUNT_COLUMNS),
        "complex_discharge_flag": ["discharge_disposition_id"],
        "age_bucket_risk": ["age"],
    }
    return FeatureTable(frame, statuses, sorted(set(wanted) - set(statuses)), sources, original)


def fallback_counts(df: DataFrame, status_columns: list[str],
                    disposition: str = "discharge_disposition_id", age: str = "age") -> DataFrame:
    """How often a feature had to use its fallback value; one row."""
    return df.agg(
        F.count_if(fx.observed_statuses(status_columns) == 0)
         .alias("medication_change_ratio_zero_denominator"),
        F.count_if(parse_number(df, disposition).isNull())
         .alias("complex_discharge_flag_missing_or_malformed"),
        F.count_if(~fx.age_is_known(age)).alias("age_bucket_risk_missing_or_malformed"),
    )


def feature_stats(df: DataFrame, features=presets.ENGINEERED_FEATURES,
                  by: str = "split") -> DataFrame:
    """Mean, sample std, min, max and missing values per split and feature."""
    cells = [f"struct({sql_text(f)} AS feature, CAST({sql_name(f)} AS DOUBLE) AS x)"
             for f in features]
    missing = F.count_if(F.col("x").isNull() | F.isnan("x"))
    return (df.selectExpr(by, f"inline(array({', '.join(cells)}))").groupBy(by, "feature").agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"),
        missing.alias("missing_count"), (missing / F.count(F.lit(1))).alias("missing_rate")))
