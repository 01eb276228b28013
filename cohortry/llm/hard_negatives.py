"""Hard negatives by a secondary-sort shuffle of pair scores.

Every score of an anchor with a row is packed into one binary key of (anchor,
descending score, kind, id), so that the order of bytes is the order wanted. Keys
are dealt to partitions by their anchor alone and sorted inside them by the whole
key. An iterator then reads each anchor's scores from the highest down: a positive
opens a window of lower scores, and a negative goes to every open window that its
score lies in and that is not yet full. It holds the open windows of one anchor,
never the anchor's rows.

Anchors are a stated query set and meet all rows in blocks. Only scores that can
still matter are packed: a task keeps, per anchor, its best positives, and once the
anchors' windows are known, per window its best negatives. Every other score has
enough better ones in its own task, so none is lost. Anchors are taken in portions of
bounded size, each with two scans of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import batches_of, ready
from cohortry.sources.scratch import settle

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: Hundredths of the positive's score between which a negative's score lies.
LEAST, MOST = 30, 90
#: Vector components of the anchors of one portion: the bound of what is broadcast.
PORTION_COMPONENTS = 4_000_000
#: Anchors and rows of one product.
BLOCK = 1024
#: A null id, last among equal scores.
NO_ID = (1 << 63) - 1
_KEY = np.dtype([("anchor", ">u8"), ("place", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_TOP = np.uint64(1 << 63)
_PACKED = pa.schema([("key", pa.binary())])
_MINED = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()),
                    ("negative_id", pa.int64()), ("positive_score", pa.int64()),
                    ("negative_score", pa.int64())])
_MINED_DDL = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
              "positive_score bigint, negative_score bigint")


def _biased(values: np.ndarray) -> np.ndarray:
    """Signed numbers as unsigned ones of the same order."""
    return np.asarray(values, np.int64).view(np.uint64) ^ _TOP


def pack(anchors, places, scores, kinds, ids) -> pa.RecordBatch:
    """Keys whose byte order is anchor, place, descending score, kind, id."""
    keys = np.empty(len(scores), _KEY)
    keys["anchor"], keys["place"] = _biased(anchors), places
    keys["score"], keys["kind"], keys["id"] = ~_biased(scores), kinds, _biased(ids)
    raw = pa.Array.from_buffers(pa.binary(_KEY.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())])
    return pa.RecordBatch.from_arrays([raw.cast(pa.binary())], schema=_PACKED)


def unpack(keys: pa.Array) -> tuple[np.ndarray, ...]:
    """Anchors, places, scores, kinds and ids of packed keys."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), _KEY)
    signed = lambda v: (v.astype(np.uint64) ^ _TOP).view(np.int64)
    return (signed(raw["anchor"]), raw["place"].astype(np.int64),
            signed(~raw["score"].astype(np.uint64)), raw["kind"].astype(np.int64), signed(raw["id"]))


def quantised(rows: DataFrame, key: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(id, label, q) of the rows that take part; q holds floor(scale * x)."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    q = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return (rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & usable)
            .select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
                    q.alias("q")))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones end in zeros."""
    lengths = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a and b. Values beyond 64 bits end at the
    largest and smallest number."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = width * (float(np.abs(a.astype(np.float64)).max(initial=0))
                    * float(np.abs(b.astype(np.float64)).max(initial=0)))
    if most < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2 ** 62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Best:
    """The first ``k`` of each group by descending score, then id, seen so far."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.n = np.zeros(groups, np.int64)
        self.scores = np.zeros((groups, k), np.int64)
        self.ids = np.zeros((groups, k), np.int64)
        self.rows = np.zeros((groups, k), np.int64)

    def worth(self, groups: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which entries of a table (one line per group) may still enter."""
        full = (self.n[groups] == self.k)[:, None]
        last, last_id = self.scores[groups, -1][:, None], self.ids[groups, -1][:, None]
        return ~full | (scores > last) | ((scores == last) & (ids[None, :] < last_id))

    def offer(self, groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(groups):
            return
        touched, own = np.unique(groups, return_inverse=True)
        held = np.arange(self.k) < self.n[touched][:, None]
        line = np.concatenate([np.nonzero(held)[0], own])
        s = np.concatenate([self.scores[touched][held], scores])
        i = np.concatenate([self.ids[touched][held], ids])
        r = np.concatenate([self.rows[touched][held], rows])
        # ~s is -s - 1, which no number overflows.
        order = np.lexsort((r, i, ~s, line))
        line, s, i, r = line[order], s[order], i[order], r[order]
        place = np.arange(len(line)) - np.searchsorted(line, line)
        kept = place < self.k
        line, place = line[kept], place[kept]
        self.n[touched] = np.bincount(line, minlength=len(touched))
        for table, values in ((self.scores, s), (self.ids, i), (self.rows, r)):
            table[touched[line], place] = values[kept]


def _offer_table(best: Best, groups: np.ndarray, scores: np.ndarray, allowed: np.ndarray,
                 ids: np.ndarray, rows: np.ndarray) -> None:
    """Offer the allowed entries of a table of scores, one line per group."""
    open_ = allowed & best.worth(groups, scores, ids)
    if open_.sum() > 8 * best.k * len(groups) and scores.shape[1] > best.k:
        # The k-th best of the block bounds what can enter from it.
        masked = np.where(open_, scores, np.iinfo(np.int64).min)
        at = scores.shape[1] - best.k
        open_ &= scores >= np.partition(masked, at, axis=1)[:, at][:, None]
    line, column = np.nonzero(open_)
    best.offer(groups[line], scores[line, column], ids[column], rows[column])


def _blocks(batches: Iterator[pa.RecordBatch]):
    """(ids, labels, vectors, numbers in this task) of the rows, block by block."""
    seen = 0
    for batch in batches:
        if batch.num_rows:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            yield ids, batch.column(1).to_numpy(), _matrix(batch.column(2)), np.arange(seen, seen + len(ids))
            seen += len(ids)


def _positives(shared, k: int):
    """Keys of each anchor's best rows of its own label in this task's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, places, labels, vectors = shared.value[:4]
        best = Best(len(anchor_ids), k)
        for ids, own, q, rows in _blocks(batches):
            for begin in range(0, len(anchor_ids), BLOCK):
                at = np.arange(begin, min(begin + BLOCK, len(anchor_ids)))
                allowed = (labels[at][:, None] == own) & (anchor_ids[at][:, None] != ids)
                _offer_table(best, at, products(vectors[at], q), allowed, ids, rows)
        line, column = np.nonzero(np.arange(k) < best.n[:, None])
        yield pack(anchor_ids[line], places[line], best.scores[line, column],
                   np.zeros(len(line), np.uint8), best.ids[line, column])
    return run


def _negatives(shared, k: int):
    """Keys of each window's best rows of other labels in this task's rows; a row
    that several windows of an anchor want is packed once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, places, labels, vectors, low, high = shared.value
        windows = low.shape[1]
        best = Best(len(anchor_ids) * windows, k)
        for ids, own, q, rows in _blocks(batches):
            for begin in range(0, len(anchor_ids), BLOCK):
                at = np.arange(begin, min(begin + BLOCK, len(anchor_ids)))
                scores, other = products(vectors[at], q), labels[at][:, None] != own
                for w in range(windows):
                    inside = other & (scores >= low[at, w][:, None]) & (scores <= high[at, w][:, None])
                    if inside.any():
                        _offer_table(best, at * windows + w, scores, inside, ids, rows)
        line, column = np.nonzero(np.arange(k) < best.n[:, None])
        anchor = line // windows
        found = np.stack([anchor, best.rows[line, column], best.scores[line, column],
                          best.ids[line, column]], axis=1)
        _, first = np.unique(found[:, :2], axis=0, return_index=True)
        anchor, _, scores, ids = found[first].T
        yield pack(anchor_ids[anchor], places[anchor], scores, np.ones(len(anchor), np.uint8), ids)
    return run


def secondary_sort(keys: DataFrame) -> DataFrame:
    """Keys dealt by anchor and sorted by the whole key inside each partition: the
    DataFrame form of repartitionAndSortWithinPartitions, which spills by itself."""
    return keys.repartition(F.substring("key", 1, 16)).sortWithinPartitions("key")


def _first_positives(k: int):
    """Of a sorted stream of positives, the first ``k`` keys of each anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            keep = []
            for key in batch.column(0).to_pylist():
                if key[:16] != last:
                    last, n = key[:16], 0
                n += 1
                keep.append(n <= k)
            yield batch.filter(pa.array(keep, pa.bool_()))
    return run


def open_windows(entries, k: int = NEGATIVES, least: int = LEAST, most: int = MOST):
    """Mined rows of a sorted stream of (anchor, place, score, kind, id). Holds the
    windows that the current anchor's positives have opened."""
    current, windows = None, []
    for anchor, place, score, kind, id_ in entries:
        if (anchor, place) != current:
            current, windows = (anchor, place), []
        if kind == 0:
            windows.append([id_, score, 0])
            continue
        for window in windows:
            if window[2] < k and least * window[1] <= 100 * score <= most * window[1]:
                window[2] += 1
                yield (anchor, None if window[0] == NO_ID else window[0], window[2],
                       None if id_ == NO_ID else id_, window[1], score)


def _mine(k: int, least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = (e for batch in batches for e in zip(*(c.tolist() for c in unpack(batch.column(0)))))
        yield from batches_of(open_windows(entries, k, least, most), _MINED)
    return run


def _window_borders(scores: np.ndarray, least: int, most: int) -> tuple[list[int], list[int]]:
    """Smallest and largest whole scores within a positive's window."""
    return ([-(-least * s // 100) for s in scores], [most * s // 100 for s in scores])


def mine(rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding",
         label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
         least: int = LEAST, most: int = MOST, scale: int = SCALE,
         portion: int = PORTION_COMPONENTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which ``is_anchor``, a condition on the key, holds. Rows
    with a null label, a null vector, or a null or non-finite component take no
    part. A score is the inner product of floor(scale * x); of vectors of unequal
    length the shorter one counts as ended by zeros, and an empty one scores 0. An
    anchor's positives are its first rows of the same label by descending score, then
    id; rows that share the anchor's id are not among them. Of every positive the
    first rows of other labels in its window are returned. Repeated rows count each
    time, and an anchor that is repeated is mined as often. A null id comes last
    among equal scores and is returned as null; it is no anchor unless the condition
    says so. Other columns play no part. An empty table gives no rows.
    """
    spark = rows.sparkSession
    ready(spark)
    usable = quantised(rows, key, vector, label, scale)
    named = F.col("id").isNotNull()
    anchors = settle(quantised(rows.where(is_anchor), key, vector, label, scale).where(named)
                     .withColumn("place", F.monotonically_increasing_id()))
    size = anchors.agg(F.sum(F.size("q") + 1)).first()[0] or 0
    portions = max(1, math.ceil(size / portion))
    dealt = anchors.withColumn("portion", F.pmod(F.xxhash64("place"), F.lit(portions)))
    mined = None
    for p in range(portions):
        # One portion is on the driver at a time; its size is bounded by ``portion``.
        taken = dealt.where(F.col("portion") == p).select("id", "place", "label", "q").orderBy("place").toArrow()
        if not taken.num_rows:
            continue
        ids, places, labels = (taken.column(i).to_numpy() for i in range(3))
        query = (ids, places, labels, _matrix(taken.column(3).combine_chunks()))
        shared = spark.sparkContext.broadcast(query)
        found = settle(secondary_sort(usable.mapInArrow(_positives(shared, positives), "key binary"))
                       .mapInArrow(_first_positives(positives), "key binary"))
        _, at, scores, _, _ = unpack(found.toArrow().column(0))
        low = np.ones((len(ids), positives), np.int64)
        high = np.zeros((len(ids), positives), np.int64)
        order = np.lexsort((~scores, at))
        at, scores = at[order], scores[order]
        line, column = np.searchsorted(places, at), np.arange(len(at)) - np.searchsorted(at, at)
        low[line, column], high[line, column] = _window_borders(scores.tolist(), least, most)
        with_windows = spark.sparkContext.broadcast((*query, low, high))
        keys = found.union(usable.mapInArrow(_negatives(with_windows, negatives), "key binary"))
        part = settle(secondary_sort(keys).mapInArrow(_mine(negatives, least, most), _MINED_DDL))
        shared.destroy()
        with_windows.destroy()
        mined = part if mined is None else mined.union(part)
    return spark.createDataFrame([], _MINED_DDL) if mined is None else mined
