"""Attach a per-key number to every row when single keys may be huge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.tokens import quoted, sql_name
from cohortry.sources.scratch import settle

HOT_KEYS = 10_000
BROADCAST_BYTES = 32 * 1024 * 1024
_ROW_OVERHEAD = 64


def _bytes_of(sizes: DataFrame, keys: list[str]) -> int:
    """Upper estimate of the table's size in memory, from its actual keys."""
    lengths = " + ".join(f"octet_length(CAST({sql_name(k)} AS STRING))" for k in keys)
    return sizes.selectExpr(f"coalesce(sum({lengths} + {_ROW_OVERHEAD}), 0)").first()[0]


def attach_group_size(df: DataFrame, keys: list[str], name: str, at_least: int = 1,
                      hot_keys: int = HOT_KEYS,
                      broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every row with the number of rows that share its key; null for groups
    smaller than ``at_least`` and for rows with a null key.

    A window over the key would put all rows of one key into one task. Sizes
    are counted with map-side combine instead, written once, measured, and
    joined back. A size table below ``broadcast_bytes`` is broadcast, and no row
    is shuffled. Beyond that the join is shuffled, all but the groups with more
    than 1/``hot_keys`` of the counted rows: there are at most ``hot_keys`` of
    them, so they are broadcast, and their rows pass the shuffle under keys of
    their own that no size row has, one for each task that read them. A repeated
    task has the same number, and even equal rows are spread. What is left for
    one join key is at most that share of the rows.
    """
    known = " AND ".join(f"{sql_name(k)} IS NOT NULL" for k in keys)
    sizes = settle(df.where(known).groupBy(*[quoted(k) for k in keys])
                   .agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= at_least))
    rows = [quoted(c) for c in df.columns]
    if _bytes_of(sizes, keys) <= broadcast_bytes:
        return (df.join(F.broadcast(sizes), keys, "left")
                .select(*rows, F.col("_size").alias(name)))
    counted = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    hot = (sizes.where(F.col("_size") * F.lit(hot_keys) > F.lit(counted))
           .withColumnRenamed("_size", "_hot"))
    spread = F.spark_partition_id() + F.lit(1)
    marked = (df.withColumn("_spread", spread).join(F.broadcast(hot), keys, "left")
              .withColumn("_salt", F.expr("CASE WHEN _hot IS NOT NULL THEN _spread ELSE 0 END")))
    joined = marked.join(sizes.withColumn("_salt", F.lit(0)), [*keys, "_salt"], "left")
    return joined.select(*rows, F.coalesce("_hot", "_size").alias(name))
