"""Every registered query against its SQL text on the smallest tables."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

import __spark_entry__ as entry_points  # noqa: E402
import oracle  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_sql_text_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "missing_rate" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert oracle.difference(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0
