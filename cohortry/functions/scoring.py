"""Decoding of predictions and probabilities, as column expressions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.functions.tokens import finite, strip

# Prediction texts that mean 1.
POSITIVE_TEXTS = ("1", "true", "yes", "<30")


def decode_label(index: Column, labels: list[str] | None) -> Column:
    """Class name at an index; an index without a name stays as text."""
    as_text = index.cast("string")
    if not labels:
        return as_text
    named = F.get(F.array(*[F.lit(x) for x in labels]), index.cast("int"))
    return F.coalesce(named, as_text)


def prediction_to_int(raw: Column) -> Column:
    text = F.lower(strip(raw.cast("string")))
    return F.when(text.isin(*POSITIVE_TEXTS), F.lit(1)).otherwise(F.lit(0))


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def class_shares(df_columns: list[str], probability: str, raw: str) -> Column:
    """Probabilities per class as an array. A model that only has margins (one
    boosted model per class) gets the logistic of each margin, scaled to sum 1."""
    if probability in df_columns:
        return vector_to_array(probability)
    each = F.transform(vector_to_array(raw), lambda m: sigmoid(F.lit(2.0) * m))
    total = F.aggregate(each, F.lit(0.0), lambda a, b: a + b)
    return F.transform(each, lambda p: p / total)


def shares_by_label(shares: Column, labels: list[str]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), shares)


def positive_share(shares: Column) -> Column:
    """The second class's share; the last one of a model that saw one class."""
    return F.coalesce(F.try_element_at(shares, F.lit(2)), F.try_element_at(shares, F.lit(-1)))


def positive_share_of_map(shares: Column) -> Column:
    """The share of the positive class, by either of its names, else 0."""
    return F.coalesce(shares["1"], shares["<30"], F.lit(0.0))


def numeric_entries(raw: Column) -> Column:
    """Entries of a string map that are numbers."""
    parsed = F.transform_values(raw, lambda _, v: v.try_cast("double"))
    return F.map_filter(parsed, lambda _, v: v.isNotNull())

