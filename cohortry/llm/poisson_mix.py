"""Mixing sources to target weights by Poisson replication.

A document's number of copies is the inverse of a Poisson distribution at a
number hashed from its id. The mean is what its source needs to reach its target
share, so no source has to be counted out or sampled exactly; each document is
decided by itself, and a repeated task decides the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import hashed_unit, join_groups, marked, ready, unmarked
from cohortry.sources.scratch import settle

#: Share of a source in the mix: its share of the documents to this power.
POWER = 0.7
#: Copies made of one row by one explode; more are made in blocks of this many.
BLOCK = 1000


def target_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER,
                 epochs: float = 1.0, source: str = "source") -> DataFrame:
    """(mix_source, n, rate): documents per source and mean copies of each.

    ``weights`` names target shares; sources that it leaves out get none. Without
    it, shares are the documents' shares to the given power. The mix has about
    ``epochs`` times as many rows as ``docs``. A null source is a source of its own.
    """
    sizes = docs.groupBy(F.col(source).alias("mix_source")).agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("n", F.lit(float(power))))
    else:
        wanted = docs.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in weights.items()], "wanted string, weight double")
        sizes = (sizes.join(wanted, F.col("mix_source").eqNullSafe(F.col("wanted")), "left")
                 .drop("wanted").fillna(0.0, ["weight"]))
    sizes = settle(sizes)
    n, weight = sizes.agg(F.sum("n"), F.sum("weight")).first()
    share = (epochs * n / weight) if weight else 0.0
    # Rounded, so that the order in which a sum was made cannot change a count.
    rate = F.round(F.lit(share) * F.col("weight") / F.col("n"), 9)
    return sizes.select("mix_source", F.col("n").cast("bigint").alias("n"), rate.alias("rate"))


@lru_cache(maxsize=4096)
def _table(rate: float) -> tuple[int, np.ndarray]:
    """(first count, cumulated probabilities from there on): 14 deviations to
    either side, where nothing of 52-bit numbers is left."""
    width = 14 * math.sqrt(rate) + 60
    low, high = max(0, int(rate - width)), int(rate + width)
    counts = np.arange(low, high + 1)
    logs = counts * math.log(rate) - rate - np.array([math.lgamma(k + 1) for k in counts])
    return low, np.cumsum(np.exp(logs))


def inverse_poisson(units: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """The smallest k with P(X <= k) > u, for each pair (u, rate)."""
    out = np.zeros(len(units), np.int64)
    for rate in np.unique(rates[rates > 0]):
        at = rates == rate
        low, below = _table(float(rate))
        out[at] = low + np.searchsorted(below, units[at], side="right")
    return out


def _copies(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for units, rates in batches:
        yield pd.Series(inverse_poisson(units.to_numpy(), rates.fillna(0.0).to_numpy()))


def replicate(docs: DataFrame, rates: DataFrame, seed: int = 42, key: str = "doc_id",
              source: str = "source") -> DataFrame:
    """Each row of ``docs`` as often as its count says, in a globally shuffled
    order by ``place``: its columns under names that begin with 'in_', and rate,
    n_copies, copy (from 0) and place.

    The count depends on seed and id only: rows that share an id share the
    count. A null id counts as the text 'null'. Rows whose source has no rate
    get no copies. Texts play no part and may be null, empty or long. ``rates``
    is a small written table; a hot source is no hot key (see join_groups).
    """
    ready(docs.sparkSession)
    total = rates.agg(F.sum("n")).first()[0] or 0
    named = docs.select(*marked(docs)).withColumn(
        "name", F.coalesce(F.concat(F.lit("="), f"in_{source}"), F.lit("~")))
    by_name = rates.select(
        F.coalesce(F.concat(F.lit("="), "mix_source"), F.lit("~")).alias("name"), "n", "rate")
    rows = join_groups(named, by_name, "name", "n", total)
    identity = F.coalesce(F.col(f"in_{key}").cast("string"), F.lit("null"))
    copies_of = F.pandas_udf(_copies, "bigint")
    counted = rows.withColumn("n_copies", copies_of(hashed_unit(F.lit(str(seed)), identity), "rate"))
    copies = (counted.where("n_copies > 0")
              .withColumn("block", F.explode(F.expr(f"sequence(0, (n_copies - 1) div {BLOCK})")))
              .withColumn("copy", F.explode(F.expr(
                  f"sequence(block * {BLOCK}, least(n_copies, (block + 1) * {BLOCK}) - 1)"))))
    place = F.md5(F.concat_ws(":", F.lit(f"order {seed}"), identity, F.col("copy")).cast("binary"))
    # The place is a hash, so a hash partitioning of it and a sort inside each
    # partition is a global shuffle; no range has to be sampled for it.
    return (copies.withColumn("place", place).drop("name", "n", "block")
            .repartition("place").sortWithinPartitions("place"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 42,
        epochs: float = 1.0) -> DataFrame:
    """``docs`` mixed to target weights (see target_rates): the same columns,
    whatever their names, with as many copies of a row as it was given. An empty
    table stays empty."""
    return replicate(docs, target_rates(docs, weights, epochs=epochs), seed).select(
        *unmarked(docs.columns))
