"""Substring deduplication by Rabin-Karp hashes of all fixed-length word windows.

Each task hashes every window of its documents with a rolling polynomial. Of one
chunk of documents, a hash is sent once, with the smallest document that has it:
the chunk's other documents are already known to repeat it. Hashes travel packed
by hash range, one binary row per chunk and range, so a passage that a third of
all documents share costs one entry per chunk. Per range, the windows that also
start in a smaller document are found and go back to their documents, where they
merge into maximal removal intervals. A team is a fixed share of the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import WordHash, batches_of, ready

WINDOW = 50
#: Windows of one chunk, and about the most of one hash range.
CHUNK_WINDOWS = 500_000
RANGE_WINDOWS = 2_000_000
#: Documents whose removed places a task holds at once, about.
TEAM_ROWS = 2048
#: Odd multipliers of the two rolling hashes, modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
#: The white space that separates words: the other ASCII controls are word characters.
_BLANKS = bytes(32 if 9 <= c <= 13 else c for c in range(256))

_SENT = pa.schema([("range", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])
_SENT_DDL = "range bigint, kind int, body binary"
_BACK = pa.schema([("team", pa.int64()), ("body", pa.binary())])


def split_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, separated by blank, tab, newline and their like."""
    return [w for w in text.translate(_BLANKS).split(b" ") if w] if text else []


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, b, np.uint64)
        steps[:1] = 1
        out.append(np.multiply.accumulate(steps))
    return tuple(out)


class RollingHash:
    """Rabin-Karp hashes of all windows of a sequence at once: differences of
    prefix sums of x[i] * base**-i, shifted to the window's start."""

    def __init__(self, window: int):
        self.window, self.n = window, 0

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(values)
        if n > self.n:
            self.n = 2 * n
            self.tables = [_powers(b, self.n) for b in _BASES]
        out = []
        for up, down in self.tables:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(values * down[:n], out=sums[1:])
            h = (sums[self.window:] - sums[:n + 1 - self.window]) * up[:n + 1 - self.window]
            out.append(h ^ (h >> np.uint64(29)))
        return tuple(out)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Differences of a sequence, low bytes first, so that zeros lie together."""
    steps = np.diff(values, prepend=0).astype(f"<i{width}")
    return steps.view(np.uint8).reshape(-1, width).T.tobytes()


def _unplanes(packed: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(f"<i{width}").ravel().astype(np.int64))


def pack_places(docs: np.ndarray, rows: np.ndarray, places: np.ndarray) -> bytes:
    """Places of windows, each with its document and row, in a few bytes each."""
    order = np.lexsort((places, rows, docs))
    docs, rows, places = docs[order], rows[order], places[order]
    new = np.ones(len(order), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    parts = [_planes(docs[first], 8), rows[first].astype("<u4").tobytes(), _planes(first, 8),
             _planes(places, 4)]
    return b"".join(len(p).to_bytes(8, "little") for p in parts) + b"".join(parts)


def _parts(packed: bytes, n: int) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(packed, "<u8", n)).tolist()
    return [packed[8 * n + a:8 * n + b] for a, b in zip([0, *ends], ends)]


def unpack_places(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, their rows, where their places begin, and all places."""
    docs, rows, first, places = _parts(packed, 4)
    return (_unplanes(docs, 8), np.frombuffer(rows, "<u4").astype(np.int64), _unplanes(first, 8),
            _unplanes(places, 4))


def _groups(values: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Values by key, for the keys that occur: work does not grow with the number
    of keys there might be."""
    order = np.argsort(keys, kind="stable")
    values, keys = values[order], keys[order]
    cuts = np.flatnonzero(np.diff(keys)) + 1
    for k, part in zip(keys[np.append(0, cuts)] if len(keys) else (), np.split(values, cuts)):
        yield int(k), part


class _Chunk:
    """Windows of some documents, in ascending order of document."""

    def __init__(self, window: int, ranges: int):
        self.roll, self.ranges = RollingHash(window), ranges
        self.window = window
        self.known = WordHash()
        self.clear()

    def clear(self) -> None:
        self.docs: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, doc: int, row: int, words: list[bytes]) -> None:
        if len(words) < self.window:
            return
        known = self.known
        values = np.array([known[w] for w in words], np.uint64)
        first, second = self.roll(values)
        self.docs.append((doc, row, first, second))
        self.size += len(first)

    def rows(self) -> Iterator[tuple]:
        """What is sent: kind 0, entries of one range; kind 1, places of a
        document whose windows start in a smaller one of this chunk."""
        if not self.docs:
            return
        self.docs.sort(key=lambda d: (d[0], d[1]))
        ids = np.array([d[0] for d in self.docs], np.int64)
        rows = np.array([d[1] for d in self.docs], np.int64)
        counts = np.array([len(d[2]) for d in self.docs])
        hashes = np.concatenate([d[2] for d in self.docs])
        ranges = (np.concatenate([d[3] for d in self.docs]) >> np.uint64(32)).astype(np.int64)
        ranges = (ranges * self.ranges) >> 32
        self.clear()
        starts = np.concatenate([[0], np.cumsum(counts)])
        owner = np.repeat(np.arange(len(ids)), counts)
        order = np.argsort(hashes)
        h, r = hashes[order], ranges[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        least = np.minimum.reduceat(ids[owner[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
        settled = ids[owner[order]] > least
        again = np.sort(order[settled])
        to = rows[owner[again]] % self.ranges
        for k, at in _groups(again, to):
            yield k, 1, pack_places(ids[owner[at]], rows[owner[at]], at - starts[owner[at]])
        # The smallest document's own repeats share its fate: each is sent.
        open_ = order[~settled]
        for k, at in _groups(open_, ranges[open_]):
            at = np.sort(at)
            begin = np.flatnonzero(np.diff(owner[at], prepend=-1))
            which = owner[at[begin]]
            # Places count from the chunk's first window; starts say where each
            # document's windows begin in it, and how many entries it has here.
            parts = [_planes(ids[which], 8), rows[which].astype("<u4").tobytes(),
                     _planes(starts[which], 8), _planes(begin, 8), _planes(at, 4),
                     hashes[at].tobytes()]
            yield k, 0, b"".join(len(p).to_bytes(8, "little") for p in parts) + b"".join(parts)


def _send(window: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(window, ranges)

        def all_rows() -> Iterable[tuple]:
            for batch in batches:
                for doc, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                    chunk.add(doc, row, split_words(text))
                    if chunk.size >= CHUNK_WINDOWS:
                        yield from chunk.rows()
            yield from chunk.rows()

        yield from batches_of(all_rows(), _SENT, weigh=lambda r: len(r[2]) + 64)
    return run


def _decide(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one range: the windows that also start in a smaller document, as
    documents, rows and places."""
    hashes, docs, rows, places = [], [], [], []
    for packed in entries:
        ids, row, starts, begin, at, h = _parts(packed, 6)
        starts, begin, at = _unplanes(starts, 8), _unplanes(begin, 8), _unplanes(at, 4)
        per_doc = np.diff(np.append(begin, len(at)))
        hashes.append(np.frombuffer(h, np.uint64))
        docs.append(np.repeat(_unplanes(ids, 8), per_doc))
        rows.append(np.repeat(np.frombuffer(row, "<u4"), per_doc))
        places.append((at - np.repeat(starts, per_doc)).astype(np.int32))
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    least = np.minimum.reduceat(d[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    gone = order[d[order] > least]
    return d[gone], np.concatenate(rows)[gone].astype(np.int64), np.concatenate(places)[gone]


def _judge(teams: int):
    """For a stream sorted by range: decides range by range, and packs what is
    removed by the team of documents that it belongs to."""
    def finished(entries: list[bytes], known: list[bytes]) -> Iterator[tuple[int, bytes]]:
        parts = [_decide(entries)] if entries else []
        for packed in known:
            docs, rows, first, places = unpack_places(packed)
            n = np.diff(np.append(first, len(places)))
            parts.append((np.repeat(docs, n), np.repeat(rows, n), places))
        docs, rows, places = (np.concatenate(c) for c in zip(*parts))
        for k, at in _groups(np.arange(len(rows)), rows % teams):
            yield k, pack_places(docs[at], rows[at], places[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_rows() -> Iterator[tuple[int, bytes]]:
            current, held = None, ([], [])
            for batch in batches:
                for k, kind, body in zip(*(c.to_pylist() for c in batch.columns)):
                    if k != current and current is not None:
                        yield from finished(*held)
                        held = ([], [])
                    current = k
                    held[kind].append(body)
            if current is not None:
                yield from finished(*held)

        yield from batches_of(all_rows(), _BACK, weigh=lambda r: len(r[1]) + 48)
    return run


def removed_windows(rows: DataFrame, n_bytes: int, teams: int, window: int = WINDOW) -> DataFrame:
    """(team, body): for rows (row, doc, text as binary), the first words of all
    windows whose word sequence also starts in a document with a smaller ``doc``,
    packed (see pack_places) by team, the remainder of ``row``.

    The number of hash ranges follows the bytes of text, so that a range fits into
    a task at any size of input. Windows are told apart by 64 bits and their
    range; about one false pair is expected at 10**14 bytes, as ranges grow with
    the input.
    """
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 1 << max(4, math.ceil(math.log2(max(1, n_bytes // 6 // RANGE_WINDOWS, shuffles))))
    sent = rows.select("doc", "row", "text").mapInArrow(_send(window, ranges), _SENT_DDL)
    return (sent.repartition(F.col("range")).sortWithinPartitions("range")
            .mapInArrow(_judge(teams), "team bigint, body binary"))


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                   ("intervals", pa.list_(pa.list_(pa.int32()))), ("kept_text", pa.binary())])


def _strip(window: int):
    """For a stream sorted by team and kind: first what is removed from a team's
    documents, then their texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_rows() -> Iterator[tuple]:
            team, gone = None, {}
            for batch in batches:
                for t, kind, doc_id, doc, row, body in zip(*(c.to_pylist() for c in batch.columns)):
                    if t != team:
                        team, gone = t, {}
                    if kind == 0:
                        docs, rows, first, places = unpack_places(body)
                        for d, r, part in zip(docs.tolist(), rows.tolist(),
                                              np.split(places, first[1:])):
                            gone.setdefault((d, r), []).append(part)
                        continue
                    words = split_words(body)
                    spans = removal_intervals(gone.get((doc, row)), window)
                    left, at = [], 0
                    for a, b in spans:
                        left += words[at:a]
                        at = b
                    left += words[at:]
                    yield doc_id, len(words), len(words) - len(left), spans, b" ".join(left)

        yield from batches_of(all_rows(), _KEPT, weigh=lambda r: len(r[4]) + 64)
    return run


def removal_intervals(parts: list[np.ndarray] | None, window: int) -> list[list[int]]:
    """Maximal runs of words [first, end) covered by the windows that start at the
    given places."""
    if not parts:
        return []
    at = np.unique(np.concatenate(parts))
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(at) > window]))
    ends = at[np.append(cuts[1:] - 1, len(at) - 1)] + window
    return [[int(a), int(b)] for a, b in zip(at[cuts], ends)]


def substring_dedup(docs: DataFrame, window: int = WINDOW, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, intervals and kept_text of every row.

    A word goes when a window that covers it has a word sequence which also
    starts in a document with a smaller id; windows are judged on the input. Rows
    that share an id are one document's parts: none of them removes from another.
    Null ids are larger than all others and share one id. Null text has no words,
    and texts of fewer words than the window stay whole. Other columns play no part.
    """
    ready(docs.sparkSession)
    # Rows with the same id and text have the same result and may share a name.
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(key).cast("bigint"), F.lit((1 << 63) - 1)).alias("doc"),
                       F.xxhash64(key, raw).bitwiseAND(F.lit(0xFFFFFFFF)).alias("row"),
                       raw.alias("text"))
    n_rows, n_bytes = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    teams = max(4 * shuffles, n_rows // TEAM_ROWS)
    gone = removed_windows(rows, n_bytes or 0, teams, window).select(
        "team", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("doc_id"),
        F.lit(None).cast("bigint").alias("doc"), F.lit(None).cast("bigint").alias("row"), "body")
    texts = rows.select((F.col("row") % teams).alias("team"), F.lit(1).alias("kind"), "doc_id",
                        "doc", "row", F.col("text").alias("body"))
    stripped = gone.union(texts).repartition("team").sortWithinPartitions("team", "kind").mapInArrow(
        _strip(window), "doc_id bigint, n_words bigint, n_removed bigint, "
                        "intervals array<array<int>>, kept_text binary")
    return stripped.withColumn("kept_text", F.col("kept_text").cast("string"))
