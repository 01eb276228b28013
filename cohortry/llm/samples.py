"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import hashed_unit, join_groups, ready
from cohortry.sources.scratch import settle


def held_out(key: Column) -> Column:
    """Rows that no model may learn from: a quarter, by the checksum of the id."""
    name = F.coalesce(key.cast("string"), F.lit("")).cast("binary")
    return F.crc32(name) % 4 == 2


def bounded_sample(rows: DataFrame, label: str, per_label: int, key: str = "doc_id") -> DataFrame:
    """About ``per_label`` rows of each label, or all where there are fewer.

    A row is taken when the number hashed from its id lies below per_label / rows
    of its label, so the choice is a filter: no label's rows are gathered or
    ranked, and partitions do not matter. A label exceeds its bound by a tenth
    with probability below one in a thousand at 1000 rows, and never by half. Null
    ids and labels are left out.
    """
    ready(rows.sparkSession)
    known = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    sizes = settle(known.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n")))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    sized = join_groups(known.withColumn("_label", F.col(label)), sizes, "_label", "_n", total)
    taken = hashed_unit(F.lit("sample"), F.col(key).cast("string")) < F.lit(per_label) / F.col("_n")
    return settle(sized.where(taken).select(*rows.columns))
