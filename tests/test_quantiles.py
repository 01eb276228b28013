"""Exact quantiles, running sums and hash ranks against brute force."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortry.operators import metrics as m
from cohortry.operators.hashrank import (
    kth_hashes, number_rows_by_hash, seeded_hash, seeded_row_hash,
)
from cohortry.operators.learn import undersample
from cohortry.operators.quality import duplicate_row_count, numeric_summary
from cohortry.operators.quantiles import exact_quantiles
from cohortry.operators.skew import attach_group_size

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60), st.integers(1, 20))
def test_quantiles_equal_numpy(spark, values, small):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    got = exact_quantiles(df, ["x"], SHARES, small=small)["x"]
    assert got == pytest.approx(np.quantile(values, SHARES).tolist(), rel=1e-12, abs=1e-9)


def test_quantiles_of_skewed_and_odd_columns(spark):
    rng = np.random.default_rng(3)
    hot = np.where(rng.random(3000) < 0.4, 7.0, rng.normal(size=3000))
    rows = [(float(h), None, float("nan"), 5.0, float("inf") if i == 0 else float(i))
            for i, h in enumerate(hot)]
    df = spark.createDataFrame(rows, "hot double, none double, nan double, same double, inf double")
    got = exact_quantiles(df, df.columns, SHARES)
    assert got["hot"] == pytest.approx(np.quantile(hot, SHARES).tolist(), rel=1e-12)
    assert got["none"] is None and got["nan"] is None
    assert got["same"] == [5.0] * len(SHARES)
    assert got["inf"] == pytest.approx(np.quantile(np.arange(1, 3000), SHARES).tolist())


def test_infinities_are_ranked_on_demand(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, inf)], "x double")
    assert exact_quantiles(df, ["x"], (0.25, 0.5), infinite=True)["x"] == [1.75, 2.5]
    row = numeric_summary(df).first()
    assert (row.p25, row.p50, row.max) == (1.75, 2.5, inf)
    both = spark.createDataFrame([(v,) for v in (-inf, -inf, 5.0, inf)], "x double")
    assert exact_quantiles(both, ["x"], (0.0, 1.0), infinite=True)["x"] == [-inf, inf]


def test_scores_that_are_all_infinite(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1, inf), (0, inf), (0, -inf)], "label int, score double")
    assert m.roc_auc(df).first()[0] == 0.75
    only = spark.createDataFrame([(1, inf), (0, inf)], "label int, score double")
    assert m.roc_auc(only).first()[0] == 0.5 and m.pr_curve(only).count() == 2


def auc_by_pairs(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y == 1]
    neg = [s for y, s in zip(labels, scores) if y == 0]
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return won / (len(pos) * len(neg))


@pytest.mark.parametrize("digits", [0, 1, 6])
def test_auc_equals_pair_counting(spark, digits):
    rng = np.random.default_rng(digits)
    labels = rng.integers(0, 2, 400)
    scores = np.round(rng.random(400) + 0.2 * labels, digits)
    df = spark.createDataFrame([(int(y), float(s)) for y, s in zip(labels, scores)],
                               "label int, score double")
    assert m.roc_auc(df).first()[0] == pytest.approx(auc_by_pairs(labels, scores), abs=1e-12)


def test_pr_curve_by_hand(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, score double")
    rows = m.pr_curve(df).orderBy(F.asc_nulls_last("threshold")).collect()
    assert [r.threshold for r in rows] == [0.1, 0.35, 0.4, 0.8, None]
    assert [r.precision for r in rows] == pytest.approx([0.5, 2 / 3, 0.5, 1.0, 1.0])
    assert [r.recall for r in rows] == pytest.approx([1.0, 1.0, 0.5, 0.5, 0.0])


def test_auc_of_no_rows_is_null(spark):
    assert m.roc_auc(spark.createDataFrame([], "label int, score double")).first()[0] is None


def test_kth_hash_and_numbering(spark):
    df = spark.range(500).repartition(5)
    hashed = seeded_hash(F.col("id"), 42)
    want = sorted(hashlib.md5(f"42:{i}".encode()).hexdigest() for i in range(500))
    assert kth_hashes(df.select(hashed.alias("h")), [1, 77, 500]) == [want[0], want[76], want[499]]
    with pytest.raises(ValueError):
        kth_hashes(df.select(hashed.alias("h")), [501])
    numbered = number_rows_by_hash(df.withColumn("h", hashed), hashed, "n").orderBy("n").collect()
    assert [r.n for r in numbered] == list(range(500))
    assert [r.h for r in numbered] == want


def test_ranks_and_numbers_of_a_hot_key(spark):
    """A third of the keys are null and many rows are equal: no task gets them all."""
    rows = [(None if i % 3 == 0 else i, i // 2) for i in range(1200)] + [(7, 7)] * 300
    df = spark.createDataFrame(rows, "k int, x int").repartition(5)
    hashed = df.withColumn("h", seeded_row_hash(df, F.col("k"), 42))
    want = sorted(r.h for r in hashed.select("h").collect())
    ranks = [1, 400, 777, 1200, 1500]
    got = kth_hashes(hashed.select("h"), ranks, bucket_rows=20)
    assert got == [want[r - 1] for r in ranks]
    numbered = number_rows_by_hash(df, seeded_row_hash(df, F.col("k"), 42), "n", bucket_rows=20)
    assert sorted(r.n for r in numbered.collect()) == list(range(1500))
    assert [tuple(r) for r in numbered.select("k", "x", "n").orderBy("n").collect()] == [
        tuple(r) for r in numbered.select("k", "x", "n").orderBy("n").collect()]
    under = undersample(df.withColumn("label", F.when(F.col("x") < 50, 1).otherwise(0)), "k")
    assert {r.label: r["count"] for r in under.groupBy("label").count().collect()} == {
        0: 400, 1: 400}


def test_undersampling_equal_rows(spark):
    df = spark.createDataFrame([(1, 0)] * 5000 + [(i, 1) for i in range(2500)], "k int, label int")
    got = undersample(df.repartition(4), "k").groupBy("label").count().collect()
    assert sorted(map(tuple, got)) == [(0, 2500), (1, 2500)]


@pytest.mark.parametrize("hot_keys,broadcast_bytes", [(1, 0), (3, 0), (1000, 0), (1000, 10**9)])
def test_group_sizes_with_a_hot_key(spark, hot_keys, broadcast_bytes):
    keys = [0] * 400 + [i % 50 + 1 for i in range(300)] + [1000 + i for i in range(100)]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "row int, k int")
    limits = {"hot_keys": hot_keys, "broadcast_bytes": broadcast_bytes}
    rows = attach_group_size(df, ["k"], "n", **limits).collect()
    assert len(rows) == len(keys) and len({r.row for r in rows}) == len(keys)
    assert all(r.n == keys.count(r.k) for r in rows)
    rows = attach_group_size(df, ["k"], "n", at_least=2, **limits).collect()
    assert len(rows) == len(keys)
    assert all(r.n == (keys.count(r.k) if keys.count(r.k) > 1 else None) for r in rows)


def test_hot_copies_without_broadcast(spark):
    """Many copies of one row, with joins that have to shuffle."""
    df = spark.createDataFrame([("a", 1)] * 900 + [(None, i) for i in range(300)] + [("b", 2)] * 2,
                               "x string, y int").repartition(6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert duplicate_row_count(df).first()[0] == 900
        sized = attach_group_size(df, ["x"], "n", hot_keys=2, broadcast_bytes=0)
        counts = {(r.x, r.n): r["count"] for r in sized.groupBy("x", "n").count().collect()}
        assert counts == {("a", 900): 900, ("b", 2): 2, (None, None): 300}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
