"""Exact quantiles of many columns by radix selection, without sort or sketch.

``percentile`` keeps every distinct value of a column in one task, a sort needs
one range-partitioned shuffle per column, and a sketch over a whole table merges
in one task. Here values are counted by their leading digits, with map-side
combine; the counts tell which cells hold the wanted ranks, and only those cells
are cut finer, until they are small or hold one value. The driver sees the counts
of cells, a number that depends on columns and ranks but not on rows.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.tokens import finite_sql, sql_double, sql_name

#: First cells: this many for each doubling of a value's size.
CELLS_PER_DOUBLING = 16
#: Cells that one cell is cut into in every further pass.
FAN = 2048
#: Cells of at most this many rows are ranked value by value.
SMALL = 100_000
#: Buckets for running sums: the tasks of such a sum, whatever the cluster's size.
BUCKETS = 1024
_ZERO = 1100 * CELLS_PER_DOUBLING


def _first_cell(v: str) -> str:
    """A number that never falls as the value grows; infinities have their own."""
    size = f"CAST(floor(log2(abs({v})) * {CELLS_PER_DOUBLING}) AS INT) + {_ZERO}"
    return (f"CASE WHEN {v} = 0 THEN 0 WHEN abs({v}) = DOUBLE('Infinity') "
            f"THEN CAST(signum({v}) AS INT) * {3 * _ZERO} "
            f"WHEN {v} > 0 THEN {size} ELSE -({size}) END")


def _cell_counts(values: DataFrame) -> dict[int, list[tuple]]:
    """Per column (from v0, v1, ...) its first cells in order, as (least value,
    largest value, rows)."""
    pairs = [f"struct({c[1:]} AS at, {_first_cell(c)} AS cell, {c} AS v)" for c in values.columns]
    rows = (values.selectExpr(f"inline(array({', '.join(pairs)}))").where("v IS NOT NULL")
            .groupBy("at", "cell").agg(F.min("v").alias("low"), F.max("v").alias("high"),
                                       F.count(F.lit(1)).alias("n")).collect())
    cells: dict[int, list[tuple]] = {}
    for r in sorted(rows, key=lambda r: (r["at"], r["cell"])):
        cells.setdefault(r["at"], []).append((r["low"], r["high"], r["n"]))
    return cells


def _numbers(df: DataFrame, columns: list[str], infinite: bool) -> DataFrame:
    number = lambda c: f"CAST({sql_name(c)} AS DOUBLE)"
    known = (lambda v: f"nullif({v}, DOUBLE('NaN'))") if infinite else finite_sql
    return df.selectExpr(*[f"{known(number(c))} AS v{i}" for i, c in enumerate(columns)])


def bucket_borders(df: DataFrame, column: str, buckets: int | None = None) -> list[float]:
    """Ascending borders that cut a column into about ``buckets`` buckets. They
    decide the balance of tasks only. Infinities are values like others."""
    buckets = buckets or BUCKETS
    cells = _cell_counts(_numbers(df, [column], True)).get(0, [])
    total = sum(n for *_, n in cells)
    borders: list[float] = []
    for low, high, n in cells:
        parts = max(1, round(buckets * n / total)) if math.isfinite(low) else 1
        borders += [low + (high - low) * k / parts for k in range(parts)]
    return sorted(set(borders))


def add_bucket(df: DataFrame, column: str, borders: list[float], name: str = "bucket"
               ) -> DataFrame:
    """Number of the last border at or below a value, by binary search; null for
    null and NaN. Borders are constants of the plan, so a recomputed task puts a
    row into the same bucket."""
    inner = [x for x in borders[1:] if math.isfinite(x)]
    inf = float("inf")
    out = Bucketizer(inputCol=column, outputCol="_bucket", splits=[-inf, *inner, inf],
                     handleInvalid="keep").transform(df) if inner else df.withColumn(
        "_bucket", F.expr(f"CASE WHEN NOT isnan({sql_name(column)}) THEN 0 END"))
    known = F.expr(f"{sql_name(column)} IS NOT NULL AND NOT isnan({sql_name(column)})")
    return out.withColumn(name, F.when(known, F.col("_bucket").cast("int"))).drop("_bucket")


def _interpolate(low: float, high: float, t: float) -> float:
    if low == high or not t:
        return low
    return low + (high - low) * t if t < 0.5 else high - (high - low) * (1 - t)


def _locate(cells: list[tuple], rank: int) -> tuple[tuple, int]:
    """The cell that holds a rank, and the rank inside it."""
    ends = list(accumulate(n for *_, n in cells))
    i = bisect_right(ends, rank)
    return cells[i], rank - (ends[i - 1] if i else 0)


def _finer(values: DataFrame, open_cells: list[tuple]) -> dict[tuple, list[tuple]]:
    """Cells (column, low, high) cut into FAN parts of equal width each."""
    spark = values.sparkSession
    table = spark.createDataFrame([(k, *c) for k, c in enumerate(open_cells)],
                                  "cell int, at int, low double, high double")
    # A part's number never falls as the value grows, whatever is rounded. Halves
    # are subtracted, so that the width of a cell is always finite.
    part = f"CAST(floor((v / 2 - low / 2) / (high / 2 - low / 2) * {FAN}) AS INT)"
    rows = (_long(values, {at for at, *_ in open_cells})
            .join(F.broadcast(table), ["at"]).where("v BETWEEN low AND high")
            .withColumn("part", F.expr(part)).groupBy("cell", "part")
            .agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count(F.lit(1)).alias("n")))
    out: dict[tuple, list[tuple]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["cell"], r["part"])):
        out.setdefault(open_cells[r["cell"]], []).append((r["least"], r["most"], r["n"]))
    return out


def _long(values: DataFrame, wanted: set[int]) -> DataFrame:
    pairs = [f"struct({i} AS at, v{i} AS v)" for i in sorted(wanted)]
    return values.selectExpr(f"inline(array({', '.join(pairs)}))").where("v IS NOT NULL")


def _ranked(values: DataFrame, asked: list[tuple]) -> dict[tuple, float]:
    """Values at (column, low, high, rank) of small cells."""
    table = values.sparkSession.createDataFrame(
        sorted({a[:3] for a in asked}), "at int, low double, high double")
    near = _long(values, {a[0] for a in asked}).join(F.broadcast(table), "at").where(
        "v BETWEEN low AND high")
    upto = F.sum("n").over(Window.partitionBy("at", "low", "high").orderBy("v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    counted = near.groupBy("at", "low", "high", "v").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "upto", upto)
    ranks = values.sparkSession.createDataFrame(asked, "at int, low double, high double, rank long")
    hit = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
    return {(r["at"], r["low"], r["high"], r["rank"]): r["v"] for r in counted.join(
        F.broadcast(ranks), ["at", "low", "high"]).where(hit)
        .select("at", "low", "high", "rank", "v").collect()}


def exact_quantiles(df: DataFrame, columns, probabilities, infinite: bool = False,
                    small: int = SMALL) -> dict[str, list[float] | None]:
    """Linear-interpolated quantiles per column, None for an empty column.

    Null and NaN are left out, and the infinities unless ``infinite`` ranks them
    as the values that they are. Runs at once and returns a few numbers per column.
    """
    columns = list(columns)
    values = _numbers(df, columns, infinite)
    cells = _cell_counts(values) if columns else {}
    totals = {at: sum(n for *_, n in c) for at, c in cells.items()}
    ranks = {at: sorted({r for p in probabilities for r in (
        math.floor(p * (total - 1)), math.ceil(p * (total - 1)))}) for at, total in totals.items()}
    found: dict[tuple[int, int], float] = {}
    # Where each wanted rank (column, rank) is: its cell, and its rank in there.
    places = {(at, r): _locate(cells[at], r) for at, rs in ranks.items() for r in rs}
    while True:
        for key, ((low, high, _), _) in list(places.items()):
            if low == high:
                found[key] = low
                del places[key]
        wide = sorted({(at, cell[0], cell[1]) for (at, _), (cell, _) in places.items()
                       if cell[2] > small})
        if not wide:
            break
        finer = _finer(values, wide)
        for (at, r), (cell, inside) in list(places.items()):
            parts = finer.get((at, cell[0], cell[1]))
            if parts:
                places[at, r] = _locate(parts, inside)
    if places:
        asked = {key: (key[0], cell[0], cell[1], inside) for key, (cell, inside) in places.items()}
        values_at = _ranked(values, sorted(set(asked.values())))
        found.update({key: values_at[a] for key, a in asked.items()})

    result: dict[str, list[float] | None] = {}
    for i, name in enumerate(columns):
        if i not in totals:
            result[name] = None
            continue
        at = [p * (totals[i] - 1) for p in probabilities]
        result[name] = [_interpolate(found[i, math.floor(x)], found[i, math.ceil(x)],
                                     x - math.floor(x)) for x in at]
    return result
