"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition is sorted by digest and folded to one entry per text: a
run. Runs are cut into sorted blocks. In each round ``fan`` neighbouring runs
(two, unless the caller says otherwise: binomial rounds) exchange slices of the
digest range, so that each of them gets one slice of all of them. The receiver
gets blocks in order of their first digest and merges them as streams: what is
smaller than the next block's first digest is final, so at most one block of each
run is open. One entry per text goes on, with the best row and the number of
copies. After the last round every task holds one slice of all runs. A text with
any number of copies has one entry per run from the start, never one per row.

Only digests and numbers are moved, never texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import batches_of, join_groups, ready
from cohortry.sources.scratch import settle

#: The characters that do not count when texts are compared.
WHITE = " \t\n\v\f\r"
#: Runs that exchange slices in one round. A larger fan means fewer shuffles.
FAN = 2
#: Entries of one block of a run; a task holds one block of each run that it merges.
BLOCK = 4096
_ENTRY_DDL = ("digest binary, n_bytes bigint, verifier bigint, n_chars bigint, id bigint, "
              "row bigint, copies bigint")
_ENTRY = pa.schema([("digest", pa.binary()), *[(n, pa.int64()) for n in (
    "n_bytes", "verifier", "n_chars", "id", "row", "copies")]])
_BLOCKS_DDL = "slot bigint, first binary, body binary"
_BLOCKS = pa.schema([("slot", pa.int64()), ("first", pa.binary()), ("body", pa.binary())])
#: Order of entries: by text, the best row first. Null ids come last.
_BEST_FIRST = [("digest", "ascending"), ("n_bytes", "ascending"), ("verifier", "ascending"),
               ("n_chars", "descending"), ("id", "ascending"), ("row", "ascending")]


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document: digest and verifiers of the normalised text,
    code points of the original text, and the run that the row belongs to."""
    body = F.coalesce(F.col(text), F.lit(""))
    plain = F.translate(body, WHITE, "")
    return docs.select(
        F.col(key).cast("bigint").alias("id"),
        F.unhex(F.sha2(plain.cast("binary"), 256)).alias("digest"),
        F.octet_length(plain).cast("bigint").alias("n_bytes"),
        F.xxhash64(plain).alias("verifier"),
        F.char_length(body).cast("bigint").alias("n_chars"),
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge neighbours with the same text in a sorted stream: the first row of
    a group is its best one; copies add up. Holds one batch and one entry."""
    open_entry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if open_entry is None:
            rows = batch
        else:
            rows = pa.RecordBatch.from_arrays(
                [pa.concat_arrays(pair) for pair in zip(open_entry.columns, batch.columns)],
                names=batch.schema.names)
        n = rows.num_rows
        same = np.ones(n - 1, bool)
        for name in ("digest", "n_bytes", "verifier"):
            column = rows.column(name)
            same &= pc.equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        copies = np.add.reduceat(rows.column("copies").to_numpy(), starts)
        heads = rows.take(pa.array(starts))
        heads = pa.RecordBatch.from_arrays([*heads.columns[:-1], pa.array(copies, pa.int64())],
                                           names=heads.schema.names)
        open_entry = heads.slice(heads.num_rows - 1)
        yield heads.slice(0, heads.num_rows - 1)
    if open_entry is not None:
        yield open_entry


def _packed(entries: Iterable[pa.RecordBatch], run: int, slices: int) -> Iterator[tuple]:
    """A run's entries as blocks (slot, first digest, entries), cut where the slice
    of the digest range changes and after about BLOCK entries."""
    base = run // slices * slices
    slot, held, size = None, [], 0

    def block() -> tuple:
        whole = pa.Table.from_batches(held, _ENTRY).combine_chunks().to_batches()[0]
        return slot, whole.column(0)[0].as_py(), whole.serialize().to_pybytes()

    for batch in entries:
        if not batch.num_rows:
            continue
        top = np.frombuffer(b"".join(d[:4] for d in batch.column(0).to_pylist()), ">u4")
        slots = (top.astype(np.uint64) * np.uint64(slices)) >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(slots)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(slots)]):
            to = base + int(slots[a])
            if held and (to != slot or size >= BLOCK):
                yield block()
                held, size = [], 0
            slot, size = to, size + b - a
            held.append(batch.slice(a, b - a))
    if held:
        yield block()


def _leaf(slices: int):
    """For a stream sorted by run and text: each run folded and cut into blocks."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            runs = batch.column(0).to_numpy()
            rest = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(
                batch.columns[1:], _ENTRY)], schema=_ENTRY)
            cuts = (np.flatnonzero(np.diff(runs)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(runs)]):
                if b > a:
                    yield int(runs[a]), rest.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (block for number, own in groupby(pieces(batches), key=lambda p: p[0])
                  for block in _packed(_fold(piece for _, piece in own), number, slices))
        yield from batches_of(blocks, _BLOCKS, weigh=lambda r: len(r[2]) + 64)
    return run


def merge_blocks(blocks: Iterable[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """Entries in order, from blocks of several sorted runs that arrive in order of
    their first digest. Entries before the next block's first digest are final, so
    of each run only the block that reaches beyond it is held."""
    held = pa.Table.from_batches([], _ENTRY)
    for first, body in blocks:
        final = pc.sum(pc.less(held.column(0), pa.scalar(first, pa.binary()))).as_py() or 0
        if final:
            yield from held.slice(0, final).to_batches()
        block = pa.ipc.read_record_batch(pa.py_buffer(body), _ENTRY)
        rest = held.slice(final)
        held = pa.Table.from_batches([*rest.to_batches(), block], _ENTRY)
        if rest.num_rows:
            held = held.sort_by(_BEST_FIRST)
        held = held.combine_chunks()
    yield from held.to_batches()


def _round(next_slices: int | None):
    """For a stream of blocks sorted by slot and first digest: each slot's runs
    merged into one, cut into blocks for the next round, or as entries after the
    last one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        merged = ((slot, _fold(merge_blocks((first, body) for _, first, body in own)))
                  for slot, own in groupby(rows, key=lambda r: r[0]))
        if next_slices is None:
            for _, entries in merged:
                yield from entries
            return
        blocks = (block for slot, entries in merged
                  for block in _packed(entries, slot, next_slices))
        yield from batches_of(blocks, _BLOCKS, weigh=lambda r: len(r[2]) + 64)
    return run


def leaf_runs(settled: DataFrame, slices: int = FAN) -> DataFrame:
    """The sorted and folded runs of all input partitions, as blocks for the first
    round. Needs no exchange."""
    order = [F.desc(n) if d == "descending" else F.asc_nulls_last(n) for n, d in _BEST_FIRST]
    return (settled.withColumn("copies", F.lit(1).cast("bigint"))
            .sortWithinPartitions("run", *order).select("run", *_ENTRY.names)
            .mapInArrow(_leaf(slices), _BLOCKS_DDL))


def rounds(n_runs: int, fan: int = FAN) -> int:
    """Rounds after which ``fan`` to their power has reached the number of runs."""
    count = 1
    while fan ** count < n_runs:
        count += 1
    return count


def tree_merge(settled: DataFrame, n_runs: int, fan: int = FAN) -> DataFrame:
    """All texts once, with the row that stays and the number of copies."""
    level, count = leaf_runs(settled, fan), rounds(n_runs, fan)
    for t in range(1, count + 1):
        slices = fan ** t
        level = (level.repartitionById(-(-n_runs // slices) * slices, F.col("slot").cast("int"))
                 .sortWithinPartitions("slot", "first")
                 .mapInArrow(_round(None if t == count else slices * fan),
                             _ENTRY_DDL if t == count else _BLOCKS_DDL))
    return level


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text",
                fan: int = FAN) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without the characters of WHITE. Of
    equal texts the row with the most code points stays, then the smallest id,
    then one of the remaining equal rows. Null text counts as empty, so all
    empty rows are one group. A null id loses ties. An empty table gives no rows.
    Other columns of ``docs`` play no part, whatever their names.
    """
    ready(docs.sparkSession)
    settled = settle(digests(docs, key, text))
    first = settled.agg(F.max("run"), F.count(F.lit(1))).first()
    n_runs, total = (first[0] or 0) + 1, first[1]
    named = F.concat("digest", F.unhex(F.lpad(F.hex("verifier"), 16, "0")))
    best = settle(tree_merge(settled, n_runs, fan).where("copies > 1").select(
        named.alias("name"), F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), "copies"))
    rows = settled.select("id", "row", "digest", named.alias("name"))
    joined = join_groups(rows, best, "name", "copies", total)
    return joined.select(
        F.col("id").alias("doc_id"),
        F.expr("CASE WHEN copies IS NULL THEN id ELSE keep_id END").alias("keep_id"),
        F.coalesce("copies", F.lit(1).cast("bigint")).alias("group_size"),
        F.expr("keep_row IS NULL OR keep_row = row").alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
