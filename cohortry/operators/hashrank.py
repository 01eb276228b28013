"""The k-th smallest hash, and ranks by hash, without a global sort.

An md5 text is spread evenly, so its leading hex digits are ready-made buckets
of equal size: no sampling, and the same bucket on every recomputation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.tokens import quoted

BUCKET_ROWS = 1_000_000
#: Further digits by which a crowded prefix is cut: 4,096 counts for the driver.
FINER = 3


def prefix_digits(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Hex digits of a prefix that about ``bucket_rows`` rows share, at any size."""
    digits = 1
    while rows > bucket_rows * 16 ** digits:
        digits += 1
    return digits


def seeded_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def seeded_row_hash(df: DataFrame, key: Column, seed: int) -> Column:
    """The key's hash with the row's own behind it, for drawing rows: never null,
    and equal only for rows that are equal in all columns, which can stand for
    each other."""
    name = F.coalesce(seeded_hash(key, seed), seeded_hash(F.lit("null"), seed))
    return F.concat(name, F.hex(F.xxhash64(*[quoted(c) for c in df.columns])))


def share_border(share: float) -> str:
    """The text that splits hashes at a share of all hashes: those before it in
    text order are that share. No hash has to be turned into a number."""
    border = math.ceil(share * 2 ** 32)
    return f"{border:08x}" if border < 2 ** 32 else "g"


def _located(counts: list[tuple[str, int]], positions: set[int]) -> dict[int, tuple[str, int, int]]:
    """Per position (from 1): the prefix that holds it, the position inside, and the
    prefix's rows."""
    places, seen = {}, 0
    for prefix, n in sorted(counts):
        places |= {p: (prefix, p - seen, n) for p in positions if seen < p <= seen + n}
        seen += n
    return places


def kth_hashes(hashes: DataFrame, ranks: list[int], digits: int | None = None,
               bucket_rows: int = BUCKET_ROWS) -> list[str]:
    """Hashes at the given ranks (from 1) of a one-column table ``h``.

    The driver sees one count per prefix, of which there is about one for each
    ``bucket_rows`` rows; only the prefixes that hold a wanted rank are ranked, each
    in a task of its own. One that holds over twice as many rows, as that of a
    repeated key does, is first cut finer by further digits, FINER at a time, until
    it is small or holds one hash. Null hashes have no rank.
    """
    hashes = hashes.where("h IS NOT NULL")
    digits = digits or prefix_digits(hashes.count(), bucket_rows)

    def counted(rows: DataFrame, n: int) -> list[tuple[str, int]]:
        return [tuple(r) for r in rows.groupBy(F.substring("h", 1, n)).count().collect()]

    whole = counted(hashes, digits)
    places = _located(whole, set(ranks))
    if set(places) != set(ranks):
        raise ValueError(f"ranks {sorted(set(ranks) - set(places))} lie outside "
                         f"1..{sum(n for _, n in whole)}")
    length = hashes.agg(F.max(F.length("h"))).first()[0] if places else 0
    while crowded := {p for p, _, n in places.values()
                      if n > 2 * bucket_rows and len(p) < length}:
        for prefix in crowded:
            inside = {at: rank for rank, (p, at, _) in places.items() if p == prefix}
            finer = counted(hashes.where(F.col("h").startswith(prefix)), len(prefix) + FINER)
            found = _located(finer, set(inside))
            places |= {rank: found[at] for at, rank in inside.items()}
    # A prefix of full length is the hash.
    known = {rank: p for rank, (p, _, _) in places.items() if len(p) >= length}
    wanted = {(p, at) for p, at, _ in places.values() if len(p) < length}
    if wanted:
        prefixes = sorted({p for p, _ in wanted})
        prefix = F.coalesce(*[F.when(F.col("h").startswith(p), p) for p in prefixes])
        near = hashes.select("h", prefix.alias("prefix")).where("prefix IS NOT NULL")
        order = Window.partitionBy("prefix").orderBy("h")
        table = hashes.sparkSession.createDataFrame(sorted(wanted), "prefix string, position long")
        found = {(r["prefix"], r["position"]): r["h"] for r in near.withColumn(
            "position", F.row_number().over(order).cast("long")).join(
            F.broadcast(table), ["prefix", "position"]).collect()}
        known |= {rank: found[(p, at)] for rank, (p, at, _) in places.items() if (p, at) in found}
    return [known[rank] for rank in ranks]


def number_rows_by_hash(df: DataFrame, hashed: Column, name: str, digits: int | None = None,
                        bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows numbered 0, 1, 2, ... in hash order.

    Rank inside a prefix plus the count of all earlier prefixes. There is about
    one prefix for each ``bucket_rows`` rows, hence the broadcast of their counts. A
    prefix with over twice as many rows, as that of a repeated key, is cut into
    cells by a hash of the hash, and inside it rows are numbered cell by cell.
    """
    digits = digits or prefix_digits(df.count(), bucket_rows)
    keyed = df.withColumn("_h", hashed).withColumn("_prefix", F.substring("_h", 1, digits))
    crowded = [(r["_prefix"], prefix_digits(r["count"], bucket_rows)) for r in
               keyed.groupBy("_prefix").count().where(F.col("count") > 2 * bucket_rows).collect()]
    if crowded:
        cells = F.broadcast(df.sparkSession.createDataFrame(crowded, "_prefix string, _more int"))
        more = F.expr("substring(md5(CAST(_h AS BINARY)), 1, coalesce(_more, 0))")
        keyed = keyed.join(cells, "_prefix", "left").withColumn(
            "_prefix", F.concat("_prefix", more)).drop("_more")
    before = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = (keyed.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n"))
              .select("_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inside = F.row_number().over(Window.partitionBy("_prefix").orderBy("_h"))
    return (keyed.join(F.broadcast(starts), "_prefix")
            .withColumn(name, (inside - F.lit(1) + F.col("_start")).cast("long"))
            .drop("_prefix", "_h", "_start"))
