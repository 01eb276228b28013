"""Compare a registered query with its SQL text on one scale folder."""

from __future__ import annotations

import decimal
import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else a text that shows where the results differ."""
    relation = con.sql(sql)
    names = sorted(relation.columns)
    if sorted(spark_df.columns) != names:
        return f"columns {sorted(spark_df.columns)} != {names}"
    at = [relation.columns.index(n) for n in names]
    expected = Counter(tuple((type(plain(r[i])).__name__, plain(r[i])) for i in at)
                       for r in relation.fetchall())
    got = Counter(tuple((type(plain(v)).__name__, plain(v)) for v in
                        (r.asDict(recursive=True)[n] for n in names)) for r in spark_df.collect())
    if expected == got:
        return None
    return (f"{sum(got.values())} rows against {sum(expected.values())}; columns {names}\n"
            f"only Spark: {[tuple(v for _, v in k) for k in list((got - expected))[:4]]}\n"
            f"only SQL:   {[tuple(v for _, v in k) for k in list((expected - got))[:4]]}")
