"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group with more than 1/HOT_PARTS of all rows is hot; there are at most as many.
HOT_PARTS = 10_000
#: Rows and bytes of one Arrow batch: bounds of a Python worker's memory.
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ready(spark) -> None:
    """Make a session ready for Python tasks: Arrow batches of at most BATCH_ROWS
    rows and about BATCH_BYTES bytes, and this package on the tasks' path where it
    is not there anyway."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, most)
    package = Path(__file__).resolve().parent.parent
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    app = spark.sparkContext.applicationId
    if app in _shipped or str(package.parent) in known or not package.is_dir():
        return
    _shipped.add(app)
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    # Spark serves it from the driver to every executor, later ones included.
    spark.sparkContext.addPyFile(str(archive))


def released() -> None:
    """Give memory that was freed back to the system. Spark uses a Python worker
    again for later tasks, and it would else keep the pages of its largest one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow or an iterator UDF, giving memory back after every
    batch that it makes."""
    def task(batches: Iterator) -> Iterator:
        for out in run(batches):
            yield out
            del out
            released()
        released()
    return task


def marked(docs: DataFrame) -> list[Column]:
    """The columns under names that begin with 'in_', so that an operator's own
    names clash with none of them."""
    return [F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns]


def unmarked(names: list[str]) -> list[Column]:
    return [F.col(f"`in_{c}`").alias(c) for c in names]


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows LEFT JOIN groups on ``key``, safe for groups of any size.

    ``size`` tells how many of the ``total`` rows a group has. Groups with more
    than total/HOT_PARTS rows are at most HOT_PARTS, so that table has a proven
    bound and is broadcast: their rows stay where they are. All others are
    joined by a shuffle in which no key has more than total/HOT_PARTS rows.
    Both inputs are read twice, so they should be written tables. A table of at
    most HOT_PARTS groups is broadcast whole, and no row is moved.
    """
    if groups.limit(HOT_PARTS + 1).count() <= HOT_PARTS:
        return rows.join(F.broadcast(groups), key, "left")
    limit = max(1, total // HOT_PARTS)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = groups.where(F.col(size) <= limit)
    return (rows.join(hot, key).unionByName(
        rows.join(hot.select(key), key, "left_anti").join(cold, key, "left")))


def hashed_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts' texts joined by ':'; 52 bits."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2 ** 52))


def batches_of(rows: Iterable[tuple], schema: pa.Schema, at_most: int = 4096,
               most_bytes: int = 16 << 20, weigh=None) -> Iterator[pa.RecordBatch]:
    """Record batches from tuples. ``weigh`` gives a row's bytes where rows are large."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row) if weigh else 0
        if len(held) >= at_most or weight >= most_bytes:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


#: Words that a worker keeps with their hashes: some 10 MB.
KEPT_HASHES = 60_000


class WordHash(dict):
    """64-bit hash of each word of UTF-8 bytes; forgotten when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_HASHES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value
