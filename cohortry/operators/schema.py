"""Column lists and roles. All of this reads the schema only, never the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry import presets
from cohortry.functions.tokens import is_numeric, quoted


def without_repeats(names) -> list[str]:
    return list(dict.fromkeys(names))


def require_columns(df: DataFrame, names, purpose: str) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise KeyError(f"{purpose} needs columns that are not there: {', '.join(absent)}")


def required_column_status(df: DataFrame, names=presets.REQUIRED_COLUMNS) -> DataFrame:
    rows = [(n, n in df.columns) for n in names]
    return df.sparkSession.createDataFrame(rows, "column string, present boolean")


def select_listed(df: DataFrame, names) -> DataFrame:
    require_columns(df, names, "selection")
    return df.select(*[quoted(n) for n in names])


def drop_present(df: DataFrame, names) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def select_with_defaults(df: DataFrame, names) -> DataFrame:
    """The listed columns; those the table lacks come out as null."""
    return df.select(*[quoted(n) if n in df.columns else F.lit(None).cast("string").alias(n)
                       for n in names])


def first_present(df: DataFrame, aliases=presets.DIAGNOSES_ALIASES) -> str:
    for name in aliases:
        if name in df.columns:
            return name
    raise KeyError(f"none of the columns is there: {', '.join(aliases)}")


def numeric_and_categorical(df: DataFrame, names=None) -> tuple[list[str], list[str]]:
    names = list(df.columns if names is None else names)
    require_columns(df, names, "type split")
    numeric = [n for n in names if is_numeric(df.schema[n].dataType)]
    return numeric, [n for n in names if n not in numeric]


def column_role(name: str, numeric: bool) -> str:
    """The name decides first, the type last."""
    key = name.strip().lower()
    if key == presets.TARGET_COLUMN:
        return "target"
    if key in presets.IDENTIFIER_COLUMNS:
        return "identifier"
    if key.startswith("diag_") or "diagnosis" in key:
        return "diagnosis-like"
    if key in presets.MEDICATION_ROLE_COLUMNS:
        return "medication-status"
    return "numeric" if numeric else "categorical"


def column_roles(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, column_role(f.name, is_numeric(f.dataType)), f.dataType.simpleString())
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "column_index int, column string, role string, dtype string")


@dataclass(frozen=True)
class FeatureCandidacy:
    identifiers: list[str]
    targets: list[str]
    excluded: list[str]
    candidates: list[str]


def feature_candidacy(df: DataFrame, identifiers=presets.IDENTIFIER_COLUMNS,
                      targets=(presets.TARGET_COLUMN, presets.BINARY_TARGET_COLUMN),
                      also_exclude=()) -> FeatureCandidacy:
    ids = [n for n in identifiers if n in df.columns]
    goals = [n for n in targets if n in df.columns]
    excluded = without_repeats([*ids, *also_exclude])
    kept = [n for n in df.columns if n not in excluded and n not in goals]
    return FeatureCandidacy(ids, goals, excluded, kept)


def model_inputs(df: DataFrame, listed=(), targets=(presets.TARGET_COLUMN,
                 presets.BINARY_TARGET_COLUMN), identifiers=presets.IDENTIFIER_COLUMNS) -> list[str]:
    """Columns a model may read: the listed ones, or else all but keys and targets."""
    barred = {*targets, *identifiers}
    names = [n for n in (listed or df.columns) if n in df.columns and n not in barred]
    if not names:
        raise ValueError("no model input column is left")
    return without_repeats(names)


def feature_lineage(df: DataFrame, original: list[str], source_map: dict[str, list[str]],
                    identifiers=presets.IDENTIFIER_COLUMNS,
                    targets=(presets.TARGET_COLUMN, presets.BINARY_TARGET_COLUMN)) -> DataFrame:
    """One row per column: where it came from and whether a model may use it."""
    rows = []
    for i, name in enumerate(df.columns):
        engineered = name in presets.ENGINEERED_FEATURES
        is_id, is_target = name in identifiers, name in targets
        origin = ("engineered" if engineered else "identifier" if is_id
                  else "target" if is_target else "raw" if name in original else "added")
        rows.append((i, name, origin, not (is_id or is_target), source_map.get(name, [])))
    return df.sparkSession.createDataFrame(
        rows, "column_index int, column string, origin string, model_candidate boolean, "
              "sources array<string>")


def clamp_top_n(n: int) -> int:
    return max(1, min(int(n), 10))
