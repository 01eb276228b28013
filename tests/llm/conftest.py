"""Small tables with the cases that every operator must bear."""

import pytest

from odd_rows import ODD, SHAPE


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SHAPE).repartition(3)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with columns named like the operators' own ones."""
    from pyspark.sql import functions as F
    names = ("row", "run", "digest", "copies", "size", "shard", "slot", "kept", "node", "label",
             "n", "rate", "spans", "items", "score", "text_hash", "doc", "parts", "curve", "place",
             "_row", "_text", "lang_pred", "held_out", "mix_n", "c0", "c1")
    return odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
