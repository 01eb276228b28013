"""Entity-disjoint train/val/test split.

The split of a row is a function of its entity key and the seed alone, so it is
a projection: no shuffle, no join, and no entity can land in two splits.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry import presets
from cohortry.functions.tokens import is_null, label_text, quoted
from cohortry.operators.hashrank import kth_hashes, seeded_hash, share_border
from cohortry.operators.schema import require_columns

SPLITS = ("train", "val", "test")


def check_sizes(train: float, val: float, test: float) -> None:
    if min(train, val, test) <= 0:
        raise ValueError("split sizes must be positive")
    if abs(train + val + test - 1.0) > 1e-9:
        raise ValueError(f"split sizes must sum to 1.0, not {train + val + test:.6f}")


def check_entities(df: DataFrame, entity: str) -> None:
    require_columns(df, [entity], "entity split")
    rows, missing = df.agg(F.count(F.lit(1)), F.count_if(is_null(df, entity))).first()
    if missing:
        raise ValueError(f"column {entity} has {missing} missing value(s)")
    if not rows:
        raise ValueError("an empty table cannot be split")


def split_by_entity(df: DataFrame, entity: str = presets.ENTITY_COLUMN, train: float = 0.70,
                    val: float = 0.15, test: float = 0.15, seed: int = 42,
                    exact: bool = False, check: bool = True) -> DataFrame:
    """The table with a ``split`` column.

    Default: entity hashes, evenly spread, are cut at the sizes;
    entity counts then meet the sizes up to chance. ``exact``: floor(train * n)
    entities go to train and so on. The cuts are then the two hashes at those
    ranks, so assigning rows stays a projection.
    """
    check_sizes(train, val, test)
    if check:
        check_entities(df, entity)
    hashed = seeded_hash(quoted(entity), seed)
    if not exact:
        split = (F.when(hashed < share_border(train), F.lit("train"))
                 .when(hashed < share_border(train + val), F.lit("val"))
                 .otherwise(F.lit("test")))
        return df.withColumn("split", split)
    entities = df.select(hashed.alias("h")).distinct()
    n = entities.count()
    n_train = math.floor(train * n)
    n_val = math.floor(val / (val + test) * (n - n_train))
    cuts = [r for r in (n_train, n_train + n_val) if r > 0]
    at = dict(zip(cuts, kth_hashes(entities, cuts) if cuts else []))
    last_train, last_val = at.get(n_train, ""), at.get(n_train + n_val, "")
    split = (F.when(hashed <= F.lit(last_train), F.lit("train"))
             .when(hashed <= F.lit(last_val), F.lit("val")).otherwise(F.lit("test")))
    return df.withColumn("split", split)


def _entity_flags(df: DataFrame, entity: str) -> DataFrame:
    return df.where(quoted(entity).isNotNull()).groupBy(quoted(entity).alias("entity")).agg(
        *[F.bool_or(F.col("split") == s).alias(s) for s in SPLITS])


def entity_overlap(df: DataFrame, entity: str = presets.ENTITY_COLUMN) -> DataFrame:
    """Entities shared by each pair of splits, one row."""
    pairs = (("train", "val"), ("train", "test"), ("val", "test"))
    return _entity_flags(df, entity).agg(
        *[F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in pairs])


def shared_entities(left: DataFrame, right: DataFrame, entity: str) -> DataFrame:
    """Entities found in both tables."""
    return left.select(quoted(entity)).intersect(right.select(quoted(entity)))


def require_no_overlap(df: DataFrame, entity: str = presets.ENTITY_COLUMN) -> None:
    found = entity_overlap(df, entity).first().asDict()
    if any(found.values()):
        text = ", ".join(f"{pair}={n}" for pair, n in found.items())
        raise ValueError(f"entities are shared between splits: {text}")


def split_manifest(df: DataFrame, entity: str = presets.ENTITY_COLUMN,
                   labels=(presets.TARGET_COLUMN, presets.BINARY_TARGET_COLUMN)) -> DataFrame:
    """Rows (section, split, key, value): sizes, label counts, leakage check.

    Distinct entities are counted over one row per (split, entity), so no
    distinct aggregate expands the table.
    """
    per_entity = (df.groupBy("split", quoted(entity).alias("entity"))
                  .agg(F.count(F.lit(1)).alias("n")))
    sizes = per_entity.groupBy("split").agg(F.sum("n").alias("rows"),
                                            F.count("entity").alias("entities"))
    totals = sizes.agg(F.lit("total").alias("split"), F.sum("rows").alias("rows"),
                       F.sum("entities").alias("entities"))
    sized = sizes.unionByName(totals).select(
        "split", F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value"))
                                    for k in ("rows", "entities")])))
    parts = [sized.select(F.lit("size").alias("section"), "split", "key", "value")]
    for label in labels:
        if label in df.columns:
            counted = (df.groupBy("split", label_text(label).alias("key"))
                       .agg(F.count(F.lit(1)).alias("value")))
            parts.append(counted.select(F.lit(label).alias("section"), "split", "key", "value"))
    shared = entity_overlap(df, entity).select(
        F.lit("leakage").alias("section"), F.lit("total").alias("split"),
        F.lit("shared_entities").alias("key"),
        (F.col("train_val") + F.col("train_test") + F.col("val_test")).alias("value"))
    return reduce(DataFrame.unionByName, [*parts, shared])

