"""Sharding along a Hilbert curve over several metadata columns.

Each dimension is quantised to 2**BITS cells, the cells give a place on the
curve, rows are sorted by it, and the sorted sequence is cut into runs. Rows of
one shard then lie close together in all dimensions at once, so the cell ranges
of a shard rule it out for most filters on any of them. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.sources.scratch import settle

#: Sizes get 64 cells, so that all up to 2 GB, the most a value can have, are told apart.
BITS = 6
#: Names are hashed to the first 32 cells of theirs.
NAME_BITS = 5
_LOW_33 = (1 << 33) - 1


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """(place, next state) for state * 2**dims + corner.

    A state is a reflection ``e`` and a rotation ``d`` of the cube. Corners are
    visited in Gray code order; entry and direction of the sub-cubes follow from
    the trailing set bits of their places.
    """
    size = 1 << dims

    def turn(value: int, by: int) -> int:
        by %= dims
        return ((value >> by) | (value << (dims - by))) & (size - 1)

    def trailing_ones(value: int) -> int:
        return ((value ^ (value + 1)).bit_length() - 1) if value >= 0 else 0

    gray = [i ^ (i >> 1) for i in range(size)]
    place_of = {g: i for i, g in enumerate(gray)}
    places, following = [], []
    for state in range(size * dims):
        e, d = state % size, state // size
        for corner in range(size):
            w = place_of[turn(corner ^ e, d + 1)]
            start = 0 if w == 0 else gray[2 * ((w - 1) // 2)]
            axis = 0 if w == 0 else trailing_ones(w if w % 2 else w - 1) % dims
            places.append(w)
            following.append((e ^ turn(start, -(d + 1))) + ((d + axis + 1) % dims) * size)
    return places, following


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    """The place on the curve of a point whose coordinates are below 2**bits."""
    dims = len(cells)
    places, following = curve_tables(dims)
    place = F.array(*[F.lit(v) for v in places])
    state = F.array(*[F.lit(v) for v in following])
    corners = []
    for level in range(bits - 1, -1, -1):
        corner = F.lit(0)
        for i, cell in enumerate(cells):
            bit = F.shiftright(cell.cast("int"), level).bitwiseAND(F.lit(1))
            corner = corner.bitwiseOR(F.shiftleft(bit, i))
        corners.append(corner)
    start = F.struct(F.lit(0).cast("bigint").alias("index"), F.lit(0).alias("state"))
    end = F.aggregate(F.array(*corners), start, lambda acc, corner: F.struct(
        (acc["index"] * F.lit(1 << dims)
         + place[acc["state"] * F.lit(1 << dims) + corner]).alias("index"),
        state[acc["state"] * F.lit(1 << dims) + corner].alias("state")))
    return end["index"]


def name_cell(value: Column, bits: int = NAME_BITS) -> Column:
    """A name's cell, from its md5; null and empty share cell 0's hash."""
    digits = F.substring(F.md5(F.coalesce(value, F.lit("")).cast("binary")), 1, 8)
    return (F.conv(digits, 16, 10).cast("bigint") % F.lit(1 << bits)).cast("int")


def size_cell(size: Column, bits: int = BITS) -> Column:
    """Sizes by their logarithm, two cells for each doubling."""
    return F.least(F.floor(F.log2(size.cast("double")) * 2), F.lit((1 << bits) - 1)).cast("int")


def hilbert_shards(rows: DataFrame, cells: list[Column], n_shards: int, tie: list[str],
                   bits: int = BITS) -> DataFrame:
    """``rows`` plus curve (place on the curve), shard and slot (0, 1, 2, ... in
    each shard). Shard sizes differ by at most one row.

    Rows of equal place are ordered by ``tie``, so a place that holds a third of
    all rows is cut like any other. The sorted table is written once: a row's
    rank is the number of rows in the partitions before its own plus its place
    there. The table of those numbers has one row per partition, hence the
    broadcast. Rows equal in all of it get any order, fixed by the written table.
    """
    placed = rows.withColumn("curve", curve_index(cells, bits))
    order = ["curve", *tie]
    settled = settle(placed.orderBy(*order)
                     .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    starts, seen = [], 0
    for p, n in sorted(tuple(r) for r in settled.groupBy(part.alias("p")).count().collect()):
        starts.append((p, seen))
        seen += n
    before = settled.sparkSession.createDataFrame(starts, "_part bigint, _before bigint")
    ranked = settled.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(
        "_rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit(_LOW_33)))
    shard = F.expr(f"CAST(_rank * {n_shards} DIV {max(1, seen)} AS INT)")
    first = F.expr(f"(shard * {seen}L + {n_shards - 1}) DIV {n_shards}")
    return (ranked.withColumn("shard", shard).withColumn("slot", F.col("_rank") - first)
            .drop("_at", "_part", "_before", "_rank"))


def shard_ranges(sharded: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """Per shard: rows, and the smallest and largest cell of each dimension. A
    filter on a dimension needs only the shards whose range holds its cell."""
    return sharded.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[f(c).alias(f"{n}_{name}") for n, c in cells.items()
          for f, name in ((F.min, "low"), (F.max, "high"))])


def document_cells() -> dict[str, Column]:
    """The dimensions of a document table: size, language and source. Null and
    empty texts have size 1."""
    return {"size": size_cell(F.col("size")), "lang": name_cell(F.col("lang")),
            "source": name_cell(F.col("source"))}


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and curve of every
    row; law is 'rows', so grown_shard is null. Null text has size 1 and the
    checksum of no bytes. Null doc_id, lang and source are kept; other columns
    play no part. An empty table gives no rows."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", "lang", "source",
                         (F.octet_length(raw) + F.lit(1)).cast("bigint").alias("size"),
                         F.crc32(raw).alias("text_crc32"))
    cells = list(document_cells().values())
    sharded = hilbert_shards(narrow, cells, n_shards, ["doc_id", "text_crc32"])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                          "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
