"""The engineered visit features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry import presets
from cohortry.functions.tokens import (
    number_or_sql, number_sql, sql_double, sql_list, sql_name, strip_sql, stripped, stripped_sql,
)


def severity(df: DataFrame, diagnoses: str, terms=presets.SEVERITY_TERMS) -> Column:
    """Weighted sum of counts, each scaled and held within 0..1."""
    parts = []
    for name, divisor, weight in terms:
        scaled = f"{number_or_sql(df, name or diagnoses)} / {sql_double(divisor)}"
        parts.append(f"{sql_double(weight)} * least(greatest({scaled}, 0D), 1D)")
    return F.expr(f"CAST({' + '.join(parts)} AS FLOAT)")


def utilization(df: DataFrame, columns=presets.VISIT_COUNT_COLUMNS) -> Column:
    return F.expr(f"CAST({' + '.join(number_or_sql(df, c) for c in columns)} AS FLOAT)")


def has_status(name: str, values=presets.STATUS_VALUES) -> str:
    """SQL: is the column's text, in any case, one of the values?"""
    return f"coalesce(upper({stripped_sql(name)}) IN ({sql_list(values)}), false)"


def _status_count(columns: list[str], values) -> str:
    return " + ".join([f"CAST({has_status(c, values)} AS INT)" for c in columns] or ["0"])


def observed_statuses(columns: list[str]) -> Column:
    return F.expr(_status_count(columns, presets.STATUS_VALUES))


def change_ratio(columns: list[str]) -> Column:
    """Share of known statuses that report a change; 0 when none is known.

    Every text is brought to its plain form once, by one short lambda for all columns:
    a comparison per column and list makes a method that the JVM no longer compiles.
    """
    if not columns:
        return F.lit(0.0).cast("float")
    # Those that report a change stand last.
    values = sorted(presets.STATUS_VALUES, key=lambda v: v in presets.CHANGED_VALUES)
    unchanged = sum(v not in presets.CHANGED_VALUES for v in values)
    texts = ", ".join(f"CAST({sql_name(c)} AS STRING)" for c in columns)
    places = f"transform(array({texts}), t -> array_position(array({sql_list(values)}), upper({strip_sql('t')})))"
    return F.expr(
        f"aggregate({places}, named_struct('seen', 0, 'changed', 0), (a, p) -> named_struct("
        f"'seen', a.seen + IF(p > 0, 1, 0), 'changed', a.changed + IF(p > {unchanged}, 1, 0)), "
        "a -> CAST(coalesce(CAST(a.changed AS DOUBLE) / nullif(CAST(a.seen AS DOUBLE), 0D), 0D) AS FLOAT))")


def complex_discharge(df: DataFrame, name: str, home_ids=presets.HOME_DISPOSITION_IDS) -> Column:
    """0 for a home-like disposition, 1 for all else, unknown included."""
    homes = ", ".join(sql_double(i) for i in home_ids)
    return F.expr(f"CAST(CASE WHEN {number_sql(df, name)} IN ({homes}) THEN 0 ELSE 1 END AS TINYINT)")


def _age_floor(name: str) -> str:
    pattern = r"^\[(\d+)-(\d+)\)$"
    return f"try_cast(regexp_extract({stripped_sql(name)}, r'{pattern}', 1) AS BIGINT)"


def age_is_known(name: str) -> Column:
    return F.expr(f"{_age_floor(name)} IS NOT NULL")


def age_bucket(name: str) -> Column:
    """Decade of a ``[a-b)`` bucket, -1 when the text has another shape."""
    return F.expr(f"CAST(coalesce({_age_floor(name)} DIV 10, -1) AS SMALLINT)")


def binary_target(name: str, positive: str = presets.POSITIVE_LABEL) -> Column:
    return (stripped(name) == positive).cast("byte")


def class_index(name: str, labels=presets.CLASS_LABELS) -> Column:
    """Position of the label in a fixed order; null for an unknown label."""
    place = f"array_position(array({sql_list(labels)}), {stripped_sql(name)})"
    return F.expr(f"CAST(nullif({place}, 0) - 1 AS DOUBLE)")
