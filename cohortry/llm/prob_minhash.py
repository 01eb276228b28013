"""Near-duplicate detection with ProbMinHash signatures, banding and verification.

A document is the weighted set of its five-word shingles; a shingle's weight is
1 + ln(times it occurs). Each shingle is a Poisson process whose rate is its
weight and whose arrivals hit random slots; a slot keeps the shingle that arrives
first. Two documents agree in a slot with their probability Jaccard similarity.

Equal shingle sets are collapsed first, so copies in any number are one node.
Nodes that share a band are linked to the smallest node of that bucket and
verified on their texts; what then stays apart is compared exactly in blocks.
Tasks return links that join classes, never pairs inside one, and no link between
classes is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import WordHash, join_groups, lean, marked, ready, released, unmarked
from cohortry.sources.scratch import settle

SHINGLE = 5
THRESHOLD = 0.8
#: Slots = BANDS * ROWS. A pair at the threshold shares no band with probability
#: (1 - 0.8**5)**25, about 5 in 100,000.
BANDS = 25
ROWS = 5
#: Nodes that one task compares with as many others.
BLOCK = 1024
#: Pairs of one node that are verified together.
STAR_PAIRS = 256
#: Buckets of text hashes that tell which texts cannot be wanted.
FILTER_BUCKETS = 1 << 20
#: Deviations below the threshold at which an estimate rules a pair out.
MARGIN = 4.5
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = 0x9E3779B97F4A7C15
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Small letters, digits and all bytes of other characters are words' bytes.
_BYTES = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def weighted_shingles(text: str | None, known: dict, width: int = SHINGLE
                      ) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order, and how often each occurs. A
    text of fewer words than a shingle has one of all its words; none has none."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_BYTES).split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    values = np.array([known[w] for w in words], np.uint64)
    width = min(width, len(words))
    mixed = np.full(len(values) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = scramble(mixed * np.uint64(_STEP) + values[i:len(values) - width + 1 + i])
    return np.unique(mixed, return_counts=True)


def weights_of(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts)


def signature(hashes: np.ndarray, weights: np.ndarray, slots: int) -> np.ndarray:
    """The first shingle to arrive at each slot.

    Arrivals are made up to a time by which all slots are most likely filled and
    no further: later ones cannot change a slot. Shingles whose first arrival is
    later drop out at once. If a slot is still empty, the time is doubled.
    """
    until = slots * (math.log(slots) + 4) / weights.sum()
    while True:
        at = np.zeros(len(hashes))
        own, rate, place = hashes, weights, 0
        times, where, what = [], [], []
        while len(own):
            # As many arrivals at once as most of the remaining shingles need.
            n = max(1, min(int(until * rate.max()) + 4, 8192 // len(own)))
            steps = (np.arange(place, place + n, dtype=np.uint64) + np.uint64(1)) * np.uint64(_STEP)
            random = scramble(own[:, None] ^ scramble(steps)[None, :])
            waits = -np.log(((random >> np.uint64(24)) + np.uint64(1)) * 2.0 ** -40)
            arrivals = at[:, None] + np.cumsum(waits / rate[:, None], axis=1)
            early = arrivals <= until
            times.append(arrivals[early])
            where.append(((random[early] & np.uint64(0xFFFFFF)) * np.uint64(slots)) >> np.uint64(24))
            what.append(np.broadcast_to(own[:, None], early.shape)[early])
            more = early[:, -1]
            own, rate, at, place = own[more], rate[more], arrivals[more, -1], place + n
        order = np.argsort(np.concatenate(times))
        filled, first = np.unique(np.concatenate(where)[order], return_index=True)
        if len(filled) == slots:
            return np.concatenate(what)[order][first]
        until *= 2


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    mixed = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        mixed = scramble(mixed * np.uint64(_STEP) + sig.reshape(bands, rows)[:, i])
    return mixed.view(np.int64)


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Sum over common d of 1 / sum over all e of max(a[e] / a[d], b[e] / b[d])."""
    if not len(ha) or not len(hb):
        return 0.0
    keys = np.union1d(ha, hb)
    a, b = np.zeros(len(keys)), np.zeros(len(keys))
    a[np.searchsorted(keys, ha)], b[np.searchsorted(keys, hb)] = wa, wb
    # With e ordered by a/b, the first ones take their b and the rest their a.
    with np.errstate(divide="ignore"):
        ratio = a / b
    order = np.argsort(ratio)
    a, b, ratio = a[order], b[order], ratio[order]
    lower_b = np.concatenate([[0.0], np.cumsum(b)])
    upper_a = np.concatenate([[0.0], np.cumsum(a[::-1])])[::-1]
    common = (a > 0) & (b > 0)
    cut = np.searchsorted(ratio, ratio[common])
    return float((1.0 / (upper_a[cut] / a[common] + lower_b[cut] / b[common])).sum())


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The written table (row, id, text_hash, print, sig, bands); the last three
    are null for texts without words."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            prints, sigs, bands = [], [], []
            for body in batch.column(batch.num_columns - 1):
                hashes, counts = weighted_shingles(body.as_py(), known)
                if not len(hashes):
                    prints.append(None), sigs.append(None), bands.append(None)
                    continue
                sig = signature(hashes, weights_of(counts), BANDS * ROWS)
                prints.append(xxhash.xxh3_128_digest(hashes.tobytes() + counts.tobytes()))
                sigs.append((sig >> np.uint64(56)).astype("u1").tobytes())
                bands.append(band_hashes(sig))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(prints, pa.binary()), pa.array(sigs, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))],
                names=["row", "id", "text_hash", "print", "sig", "bands"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.col(key).cast("bigint").alias("id"),
                       F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return settle(rows.mapInArrow(lean(run), "row bigint, id bigint, text_hash bigint, print binary, "
                                       "sig binary, bands array<bigint>"))


def _equal_share(a: bytes, b: bytes) -> float:
    return float((np.frombuffer(a, "u1") == np.frombuffer(b, "u1")).mean())


def least_estimate(threshold: float = THRESHOLD) -> float:
    """The share of equal bytes below which a pair is ruled out. Unequal slots have equal
    bytes once in 256, so a pair at the threshold agrees a little more often."""
    share = threshold + (1 - threshold) / 256
    return share - MARGIN * math.sqrt(share * (1 - share) / (BANDS * ROWS))


def _likely(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures do not rule the threshold out."""
    least = least_estimate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            keep = pa.array([_equal_share(x, y) >= least for x, y in zip(a, b)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    with_a = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    both = with_a.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(lean(run), "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) whose texts reach the threshold.

    Texts are joined once, by node. A first node's text then goes once to each part of
    its pairs, of about STAR_PAIRS, with the texts of the other nodes behind it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        first, held = None, None
        for batch in batches:
            out = []
            for a, part, b, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                hashes, counts = weighted_shingles(text.as_py(), known)
                if b is None:
                    first, held = (a, part), (hashes, weights_of(counts))
                elif first == (a, part) and probability_jaccard(*held, hashes, weights_of(counts)) >= threshold:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[i] for p in out], pa.int64()) for i in range(2)], schema=_PAIRS)

    total = pairs.count()
    sizes = settle(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    parts = F.ceil(F.col("n") / F.lit(STAR_PAIRS)).cast("bigint")
    dealt = settle(join_groups(pairs, sizes, "a", "n", total).select(
        "a", F.pmod(F.xxhash64("b"), parts).alias("part"), "b"))
    wanted = dealt.select("a", "part", F.col("b").alias("node"), F.lit(1).alias("place")).union(
        dealt.select("a", "part", F.col("a").alias("node"), F.lit(0).alias("place")).distinct())
    with_text = wanted.join(texts, "node").select(
        "a", "part", F.when(F.col("place") == 1, F.col("node")).alias("b"), "text")
    return (with_text.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
            .mapInArrow(lean(run), "a bigint, b bigint"))


def components(links: DataFrame) -> DataFrame:
    """(node, label): each linked node with the smallest node of its component.

    Alternates two steps until nothing changes: every node passes its smallest
    neighbour to its larger neighbours, then to its smaller ones. The number of
    rounds grows with the logarithm of the longest chain. Every round is written,
    and rows that meet at a node with many links are not gathered (join_groups).
    """
    def with_least(edges: DataFrame) -> DataFrame:
        n = edges.count()
        least = settle(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        return join_groups(edges, least, "a", "n", n)

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                     .first())

    edges = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .where("a != b").distinct())
    seen = None
    while seen != (now := state(edges)):
        seen = now
        both = settle(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        larger = settle(with_least(both).where("b > a").select(
            F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a != b").distinct())
        smaller = with_least(larger)
        edges = settle(smaller.select("a", F.col("m").alias("b")).union(
            smaller.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


class _Sets:
    """Which of n items are joined so far, and the links that joined them."""

    def __init__(self, labels: np.ndarray):
        _, first, own = np.unique(labels, return_index=True, return_inverse=True)
        self.top = first[own].astype(np.int64)
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, others: np.ndarray) -> None:
        """Link i to one member of each set among ``others`` but its own."""
        tops, at = np.unique(self.top[others], return_index=True)
        for top, k in zip(tops.tolist(), at.tolist()):
            if top != self.top[i]:
                self.links.append((i, int(others[k])))
                self.top[self.top == top] = self.top[i]

    def table(self, nodes: np.ndarray) -> pa.Table:
        pairs = np.array(self.links, np.int64).reshape(-1, 2)
        return pa.table([nodes[pairs[:, 0]], nodes[pairs[:, 1]]], schema=_PAIRS)


def _blocks_of(held: DataFrame, group: str, carried: list[str]) -> DataFrame:
    """Rows of groups of any ``size`` cut into blocks of about BLOCK nodes, each
    once for every other block of its group. A block meets itself once, and every
    other block with one of them as side 0."""
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    return (held.withColumn("blocks", blocks)
            .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(group, F.least("own", "other").alias("first"),
                    F.greatest("own", "other").alias("second"),
                    (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "label",
                    *carried))


def _sides(key: tuple, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the two blocks' rows; the same ones where a block meets itself."""
    side = table.column("side").to_numpy()
    left = np.flatnonzero(side == 0)
    return left, left if key[1].as_py() == key[2].as_py() else np.flatnonzero(side == 1)


def _likely_links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links that join all nodes of two blocks that are likely pairs with
    different labels: a spanning forest of those pairs, not the pairs."""
    least = least_estimate()
    left, right = _sides(key, table)
    nodes, labels = table.column("node").to_numpy(), table.column("label").to_numpy()
    sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), "u1").reshape(len(nodes), -1)
    sets = _Sets(np.arange(len(nodes)))
    for i in left:
        others = right[labels[right] != labels[i]]
        sets.join(int(i), others[(sigs[others] == sigs[i]).mean(axis=1) >= least])
    del sigs
    released()
    return sets.table(nodes)


def _levels(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A weighted set as plain elements: element k of a shingle is there when it
    occurs k times or more, and weighs what the k-th time adds."""
    each = np.repeat(hashes, counts)
    k = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
    added = np.where(k == 0, 1.0, np.log1p(k) - np.log(np.maximum(k, 1)))
    return each + k.astype(np.uint64) * np.uint64(_STEP), added.astype(np.float32)


def _overlaps(left: list[tuple], right: list[tuple]) -> np.ndarray:
    """Sums of the smaller weights for all pairs of weighted sets, as products of
    matrices over the elements that several sets share."""
    sides = [[_levels(*s) for s in sets] for sets in (left, right)]
    keys, n = np.unique(np.concatenate([e for side in sides for e, _ in side]), return_counts=True)
    keys = keys[n > 1]
    out = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, len(keys), 2048):
        part = keys[begin:begin + 2048]
        matrices = []
        for side, power in zip(sides, (1.0, 0.0)):
            m = np.zeros((len(side), len(part)), np.float32)
            for i, (elements, added) in enumerate(side):
                at = np.searchsorted(part, elements)
                hit = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == elements)
                m[i, at[hit]] = added[hit] if power else 1.0
            matrices.append(m)
        out += matrices[0] @ matrices[1].T
    return out


def _exact_links(threshold: float):
    def links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Links between nodes of two blocks that reach the threshold and join what
        is not joined yet.

        With I the sum of smaller weights, the similarity lies between I / (A + B
        - I) and I / min(A, B), and equals the former where no weight is above 1;
        only in between is it worked out pair by pair.
        """
        left, right = _sides(key, table)
        nodes = table.column("node").to_numpy()
        sets = _Sets(table.column("label").to_numpy())
        weighted = []
        for h, c in zip(table.column("hashes").to_pylist(), table.column("counts").to_pylist()):
            weighted.append((np.frombuffer(h, np.uint64), np.frombuffer(c, np.int32)))
        sums = np.array([weights_of(c).sum() for _, c in weighted])
        plain = np.array([c.max() == 1 for _, c in weighted])
        both = _overlaps([weighted[i] for i in left], [weighted[i] for i in right])
        for row, i in zip(both, left):
            # A little slack for sums in single precision; such pairs are worked out.
            low = row / (sums[i] + sums[right] - row)
            high = row / np.minimum(sums[i], sums[right])
            sure = low >= threshold + 1e-5
            sets.join(int(i), right[sure])
            unsure = ~sure & (np.where(plain[i] & plain[right], low, high) >= threshold - 1e-5)
            for j in right[unsure]:
                if sets.top[i] != sets.top[j]:
                    (ha, ca), (hb, cb) = weighted[i], weighted[j]
                    if probability_jaccard(ha, weights_of(ca), hb, weights_of(cb)) >= threshold:
                        sets.join(int(i), np.array([j]))
        del weighted, both
        released()
        return sets.table(nodes)
    return links


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, hashes, counts) of the texts of (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            found = [weighted_shingles(t.as_py(), known) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h.tobytes() for h, _ in found], pa.binary()),
                 pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary())],
                names=["node", "hashes", "counts"])
    return texts.select("node", "text").mapInArrow(
        lean(run), "node bigint, hashes binary, counts binary")


def _links_between_labels(members: DataFrame, labels: DataFrame, sigs: DataFrame, texts: DataFrame,
                          threshold: float) -> DataFrame:
    """Links that join the labels of nodes which share a bucket and reach the
    threshold.

    First the nodes that likely pairs connect are gathered by component, each once
    however many buckets it shares; then all nodes of a component that differ in
    label are compared exactly, block by block. Tasks return links that join, so
    the rows are as many as the nodes at most, however many pairs are compared.
    """
    labelled = settle(members.join(labels, "node", "left").select(
        "bucket", "node", F.coalesce("label", "node").alias("label")))
    mixed = settle(labelled.groupBy("bucket").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"))
        .where("low != high").select("bucket", "size"))
    held = join_groups(labelled, mixed, "bucket", "size", labelled.count()).where("size IS NOT NULL")
    likely = _blocks_of(held, "bucket", []).join(sigs.select("node", "sig"), "node").groupBy(
        "bucket", "first", "second").applyInArrow(_likely_links, "a bigint, b bigint")
    parts = settle(components(settle(likely)).withColumnRenamed("label", "part"))
    sizes = settle(parts.groupBy("part").agg(F.count(F.lit(1)).alias("size")))
    placed = join_groups(parts, sizes, "part", "size", parts.count()).join(
        labels, "node", "left").select("part", "node", "size", F.coalesce("label", "node").alias("label"))
    sets = settle(_shingle_sets(texts.join(parts.select("node"), "node", "left_semi")))
    return _blocks_of(placed, "part", []).join(sets, "node").groupBy(
        "part", "first", "second").applyInArrow(_exact_links(threshold), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, class_id, class_size, kept, text_hash.

    A class is a set of rows linked, directly or in a chain, by a probability
    Jaccard similarity of at least ``threshold``; its id is the smallest doc_id
    in it, and that row stays. Rows that share id and text tie: one of them stays.
    Rows without words are in no class with others. A null id is larger than all
    others. Other columns play no part. An empty table gives no rows.
    """
    sig = signatures(docs, key, text)
    total = sig.count()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    nodes = settle(sig.where("print IS NOT NULL").groupBy("print").agg(
        first.alias("first"), F.count(F.lit(1)).alias("copies")).select(
        "print", F.col("first.row").alias("node"), F.col("first.id").alias("node_id"), "copies"))
    at_nodes = settle(sig.select(F.col("row").alias("node"), "sig", "bands", "id", "text_hash")
                      .join(nodes.select("node"), "node", "left_semi"))
    banded = settle(at_nodes.select("node", F.explode("bands").alias("bucket")))
    buckets = settle(banded.groupBy("bucket").agg(
        F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = settle(join_groups(banded, buckets, "bucket", "n", total * BANDS)
                     .where("lead IS NOT NULL"))
    met = members.select("node").distinct()
    sigs = settle(at_nodes.join(met, "node", "left_semi").select("node", "sig", "id", "text_hash"))
    texts = settle(_texts_of(docs, sigs, key, text))
    stars = members.where("node != lead").select(F.col("lead").alias("a"),
                                                 F.col("node").alias("b")).distinct()
    stars = settle(_likely(stars, sigs))
    links = settle(_verified(stars, texts, threshold))
    labels = settle(components(links))
    more = settle(_links_between_labels(members, labels, sigs, texts, threshold))
    if not more.isEmpty():
        labels = settle(components(links.union(more)))
    return _classes(sig, nodes, labels, total)


def _texts_of(docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """(node, text). Rows with equal id and text may stand for each other.

    Texts whose hash falls into no wanted bucket are left out before the shuffle.
    The buckets are FILTER_BUCKETS at most, hence the broadcast; where nearly all
    are wanted, nearly all texts are shuffled.
    """
    bodies = docs.select(_name(F.col(key).cast("bigint")), F.xxhash64(text).alias("text_hash"),
                         F.col(text).alias("text"))
    wanted = nodes.select(_name(F.col("id")), "text_hash", "node")
    bucket = F.pmod(F.coalesce("text_hash", F.lit(0)), F.lit(FILTER_BUCKETS)).alias("bucket")
    buckets = F.broadcast(wanted.select(bucket).distinct())
    bodies = bodies.withColumn("bucket", bucket).join(buckets, "bucket", "left_semi").drop("bucket")
    return wanted.join(bodies, ["id_name", "text_hash"]).dropDuplicates(["id_name", "text_hash"]).select(
        "node", "text")


def _name(key):
    return F.coalesce(key.cast("string"), F.lit("~")).alias("id_name")


def _classes(sig: DataFrame, nodes: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """Spread labels from nodes to classes and from classes to rows."""
    labelled = settle(nodes.join(labels, "node", "left").select(
        "print", "node", "node_id", "copies", F.coalesce("label", "node").alias("label")))
    order = F.min(F.struct(F.col("node_id").isNull().alias("none"), "node_id", "node"))
    classes = settle(labelled.groupBy("label").agg(
        order.alias("first"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("n"))
        .select("label", F.col("first.node_id").alias("class_id"), F.col("first.node").alias("stays"),
                "class_size", "n"))
    named = settle(join_groups(labelled, classes, "label", "n", labelled.count())
                   .select("print", "copies", "class_id", "stays", "class_size"))
    rows = sig.select("row", "id", "text_hash", "print")
    return join_groups(rows, named, "print", "copies", total).select(
        F.col("id").alias("doc_id"),
        F.expr("CASE WHEN stays IS NULL THEN id ELSE class_id END").alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size"),
        F.expr("stays IS NULL OR stays = row").alias("kept"), "text_hash")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class; same columns. Rows that share id and
    text are one document: one of them stays."""
    kept = near_duplicates(docs).where("kept").select(
        _name(F.col("doc_id")), "text_hash").distinct()
    named = docs.select(*marked(docs), _name(F.col("doc_id").cast("bigint")), F.xxhash64("text").alias("text_hash"))
    return (named.join(kept, ["id_name", "text_hash"], "left_semi")
            .dropDuplicates(["id_name", "text_hash"]).select(*unmarked(docs.columns)))
