"""Trees grown from rows that stay in many tasks.

All labelled rows are cut into bins and written as parts of at most FIT_CELLS numbers,
which are dealt evenly to tasks. The driver holds the trees that grow and the sums per
node and cell (slot, bin) that their cuts are chosen by; neither follows the rows.

Boosted trees: per level every task sends the sums of its rows in one child of each
split, and the sibling takes what that leaves of the parent. Margins stay with the rows.

Forests: each tree draws as many rows as there are, with replacement, part by part. Nodes
of more than FIT_CELLS numbers are split level by level by sums of all tasks. The drawn
rows of the smaller ones are shuffled by tree and node, and a task grows the rest of the
tree below each. A portion of trees at a time is shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators import trees as tr
from cohortry.operators.quantiles import exact_quantiles
from cohortry.operators.trees import (
    ClassCounts, Entries, Layout, Slopes, Top, Tree, TreeSettings, grow, in_bins, packed, probabilities, walked,
)
from cohortry.sources.scratch import allow_checkpoints, settle

#: Rows times slots, over all its trees, that one portion of a forest may draw.
PORTION_CELLS = 3_000_000_000
#: Rounds of boosting after which the margins' lineage is cut.
CHECKPOINT_ROUNDS = 50

_PARTS_DDL = "part long, n int, bins binary, labels binary, weights binary"
_HANDED_DDL = "number int, node int, depth int, part long, bins binary, labels binary, weights binary"


# ---------------------------------------------------------------------- rows in bins

@dataclass
class Binned:
    """All rows in bins, slot by slot, and the borders that make them."""
    parts: DataFrame
    sizes: dict[int, int]
    borders: list[np.ndarray]

    @property
    def layout(self) -> Layout:
        return Layout(np.array([len(b) + 1 for b in self.borders], np.int64))


def _few_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of every slot of a task, and a null for a slot with more than BINS."""
    known: dict[int, np.ndarray | None] = {}
    for batch in batches:
        if batch.num_rows:
            for slot, column in enumerate(np.ascontiguousarray(tr._dense(batch.column(0)).T)):
                if (found := known.get(slot, column[:0])) is not None:
                    found = np.union1d(found, np.unique(column))
                    known[slot] = found if len(found) <= tr.BINS else None
    for slot, found in known.items():
        values = [None] if found is None else found
        yield pa.RecordBatch.from_arrays([pa.array([slot] * len(values), pa.int32()),
                                          pa.array(values, pa.float32())], names=["slot", "value"])


def all_borders(rows: DataFrame, n_rows: int, slots: int) -> list[np.ndarray]:
    """Borders between the values of each slot of ``x``, or between its quantiles where
    more than BINS values occur. Both come from all rows."""
    listed = rows.select("x").mapInArrow(_few_values, "slot int, value float").distinct().groupBy("slot").agg(
        F.slice(F.sort_array(F.collect_list("value")), 1, tr.BINS + 1).alias("few"),
        F.bool_or(F.col("value").isNull()).alias("many")).collect()
    few = {r["slot"]: r["few"] for r in listed if not r["many"] and len(r["few"]) <= tr.BINS}
    wide = [slot for slot in range(slots) if slot not in few]
    last = max(n_rows - 1, 1)
    # The value at or below each rank, as numpy's method "lower".
    shares = [float(int(q * last)) / last for q in np.linspace(0, 1, tr.BINS)]
    found = exact_quantiles(rows.select(*[F.col("x")[slot].alias(f"s{slot}") for slot in wide]),
                            [f"s{slot}" for slot in wide], shares, infinite=True) if wide else {}
    return [tr._between(np.unique(np.array(few[slot] if slot in few else found[f"s{slot}"] or [], np.float32)))
            for slot in range(slots)]


def _in_parts(borders: list[np.ndarray], most: int):
    def part(number: int, held: list) -> pa.RecordBatch:
        bins, labels, weights = (np.concatenate(own) for own in zip(*held))
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([len(labels)], pa.int32()), pa.array([bins.T.tobytes()], pa.binary()),
             pa.array([labels.astype("<u2").tobytes()], pa.binary()),
             pa.array([weights.astype("<f8").tobytes()], pa.binary())],
            names=["part", "n", "bins", "labels", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, most):
                own = batch.slice(begin, most)
                if n + own.num_rows > most:
                    yield part(number, held)
                    number, held, n = number + 1, [], 0
                held.append((in_bins(tr._dense(own.column(0)), borders), own.column(1).to_numpy(),
                             own.column(2).to_numpy()))
                n += own.num_rows
        if held:
            yield part(number, held)
    return run


def binned(rows: DataFrame, n_rows: int, slots: int) -> Binned:
    """The rows (x, y, w) in bins, written once."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    borders = all_borders(rows, n_rows, slots)
    most = max(1, min(tr.FIT_CELLS // max(1, slots), -(-n_rows // tasks)))
    parts = settle(rows.mapInArrow(_in_parts(borders, most), _PARTS_DDL))
    return Binned(parts, {r["part"]: r["n"] for r in parts.select("part", "n").orderBy("part").collect()}, borders)


def dealt(table: Binned) -> DataFrame:
    """The parts, so that every task has about as many rows."""
    spark = table.parts.sparkSession
    tasks = [(0, i) for i in range(max(1, min(len(table.sizes), spark.sparkContext.defaultParallelism)))]
    place = []
    for part, n in sorted(table.sizes.items(), key=lambda item: (-item[1], item[0])):
        held, task = tasks[0]
        heapq.heapreplace(tasks, (held + n, task))
        place.append((part, task))
    named = spark.createDataFrame(place, "part long, task int")
    return table.parts.join(F.broadcast(named), "part").repartitionById(len(tasks), "task").drop("task")


def _loaded(row) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """A part's number, its bins slot by slot, labels and weights."""
    labels = np.frombuffer(row["labels"], "<u2")
    bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, len(labels))
    return row["part"], bins, labels, np.frombuffer(row["weights"], "<f8")


def _added(found: Iterable[list[np.ndarray]]) -> list[np.ndarray]:
    total: list[np.ndarray] = []
    for arrays in found:
        total = [a + b for a, b in zip(total, arrays)] if total else list(arrays)
    return total


def _summed(rows: RDD, sums: Callable[[tuple], list[np.ndarray]]) -> list[np.ndarray]:
    """Arrays that a function makes of every part, added up in tasks and then here."""
    def run(states: Iterator[tuple]) -> Iterator[list[np.ndarray]]:
        if total := _added(sums(state) for state in states):
            yield total
    return _added(rows.mapPartitions(run).collect())


def nodes_of(slot: np.ndarray, cut: np.ndarray, left: np.ndarray, column: Callable[[int], np.ndarray], n: int
             ) -> np.ndarray:
    """The node without children that each of ``n`` rows reaches."""
    used = np.unique(slot[slot >= 0])
    if not len(used):
        return np.zeros(n, np.int64)
    columns = np.stack([column(int(s)) for s in used])
    nodes = packed(np.where(slot >= 0, np.searchsorted(used, slot), -1), cut, left)
    top = Top(nodes, 0)
    at = top.ends[top.passed(columns)]
    return at if top.whole else walked(nodes, at, np.ascontiguousarray(columns.T))


# --------------------------------------------------------------------- boosted trees

class Growing:
    """A boosted tree that grows by the sums per cell of one child of each split."""

    def __init__(self, layout: Layout, stat: Slopes, depth: int | None, columns: np.ndarray):
        self.layout, self.stat, self.depth, self.columns, self.level = layout, stat, depth, columns, 0
        self.slot, self.cut, self.left = np.full(1, -1), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.values: list[np.ndarray] = []
        self.gains: dict[int, float] = {}
        #: Nodes whose sums are wanted next; the place of each in its level.
        self.few, self.places = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.first, self.totals, self.above = 0, None, None

    def advance(self, few_totals: np.ndarray, few_sums: np.ndarray) -> None:
        """Split the level whose sums were wanted."""
        stat, starts = self.stat, self.layout.starts
        if self.totals is None:
            self.totals, sums = few_totals, few_sums
            self.values.append(stat.value(self.totals))
        else:
            sums = np.empty((len(self.totals), *few_sums.shape[1:]))
            sums[self.places], sums[self.places ^ 1] = few_sums, self.above - few_sums
        self.few = np.zeros(0, np.int64)
        which = np.flatnonzero(stat.open(self.totals)) if self.depth != self.level else np.zeros(0, np.int64)
        if not len(which):
            return
        gain, best, cut = self.layout.cuts(stat, sums[which], self.totals[which], self.columns)
        split = gain > stat.least_gain
        done, best, cut = which[split], best[split], cut[split]
        if not len(done):
            return
        made = len(self.slot)
        nodes = self.first + done
        self.slot[nodes], self.cut[nodes], self.left[nodes] = best, cut, made + 2 * np.arange(len(done))
        for s, g in zip(best.tolist(), gain[split].tolist()):
            self.gains[s] = self.gains.get(s, 0.0) + max(g, 0.0)
        totals = np.empty((2 * len(done), self.totals.shape[1]))
        for i, (node, s, c) in enumerate(zip(done.tolist(), best.tolist(), cut.tolist())):
            totals[2 * i] = sums[node, starts[s]:starts[s] + c + 1].sum(axis=0)
            totals[2 * i + 1] = self.totals[node] - totals[2 * i]
        self.above, self.totals, self.first, self.level = sums[done], totals, made, self.level + 1
        self.slot, self.cut, self.left = (np.concatenate([old, np.full(len(totals), new, np.int64)]) for old, new in (
            (self.slot, -1), (self.cut, 0), (self.left, 0)))
        self.values.append(stat.value(totals))
        if self.depth != self.level and stat.open(totals).any():
            # The child of the smaller second derivatives has about the fewer rows.
            self.places = 2 * np.arange(len(done)) + (totals[0::2, 1] > totals[1::2, 1])
            self.few = made + self.places

    def tree(self) -> Tree:
        return Tree(self.slot, self.cut, self.left, np.concatenate(self.values), self.gains)


def _started(sizes: np.ndarray, start: np.ndarray):
    def run(rows: Iterator) -> Iterator[tuple]:
        for part, bins, labels, weights in map(_loaded, rows):
            entries = Entries(bins.T, int(sizes.max(initial=1)), sizes)
            # Codes say all that the columns say.
            entries.columns = None
            yield part, entries, labels, weights, np.tile(start, (len(labels), 1))
    return run


def _level_sums(s: TreeSettings, number: int, asked: list[tuple]):
    """Sums of the wanted nodes of the trees of a round, over a part's rows."""
    def run(state: tuple) -> list[np.ndarray]:
        part, entries, labels, weights, margins = state
        drawn = np.random.default_rng([s.seed, 2, number, part]).random(len(labels)) < s.rowShare
        taken, found = np.flatnonzero(drawn & (weights > 0)), []
        for group, slot, cut, left, few in asked:
            place = np.full(len(slot), -1)
            place[few] = np.arange(len(few))
            at = place[nodes_of(slot, cut, left, entries.column, len(labels))[taken]]
            rows, at = taken[at >= 0], at[at >= 0]
            own = 1 if margins.shape[1] == 1 else group
            p, w = probabilities(margins[rows], "boosted")[:, own], weights[rows]
            stat = Slopes((p - (labels[rows] == own)) * w, np.maximum(p * (1 - p), 1e-16) * w,
                          s.penalty, s.leastChild, s.stepSize)
            totals = stat.sums(at, slice(None), len(few))
            found += [totals, entries.sums_of(stat, rows, at, totals)]
        return found
    return run


def _with_margins(grown: list[tuple]):
    def run(state: tuple) -> tuple:
        part, entries, labels, weights, margins = state
        margins = margins.copy()
        for group, tree in grown:
            at = nodes_of(tree.slot, tree.cut, tree.left, entries.column, len(labels))
            margins[:, group] += tree.value[at, 0]
        return part, entries, labels, weights, margins
    return run


def _class_weights(classes: int):
    return lambda row: [np.bincount(_loaded(row)[2], _loaded(row)[3], classes)]


def spread_boosted(table: Binned, s: TreeSettings) -> tuple[np.ndarray, list[tuple[int, Tree]]]:
    """Like trees.boosted_trees, over the rows of all tasks."""
    allow_checkpoints(table.parts.sparkSession)
    rng, layout, rows = np.random.default_rng([s.seed, 1]), table.layout, dealt(table).rdd
    start = tr.start_margins(_summed(rows, _class_weights(s.classes))[0])
    state = rows.mapPartitions(_started(layout.sizes, start)).persist(StorageLevel.MEMORY_AND_DISK)
    before, stat = None, Slopes(None, None, s.penalty, s.leastChild, s.stepSize)
    slots = len(layout.sizes)
    wanted, grown = max(1, round(s.columnShare * slots)), []
    for number in range(s.numTrees):
        columns = np.sort(rng.permutation(slots)[:wanted])
        growing = [Growing(layout, stat, s.maxDepth, columns) for _ in start]
        while asked := [(group, t.slot, t.cut, t.left, t.few) for group, t in enumerate(growing) if len(t.few)]:
            found = _summed(state, _level_sums(s, number, asked))
            for i, (group, *_) in enumerate(asked):
                growing[group].advance(found[2 * i], found[2 * i + 1])
            if before is not None:
                # Its successor is made by now.
                before.unpersist()
                before = None
        made = [(group, t.tree()) for group, t in enumerate(growing)]
        grown += made
        before, state = state, state.map(_with_margins(made)).persist(StorageLevel.MEMORY_AND_DISK)
        if (number + 1) % CHECKPOINT_ROUNDS == 0:
            state.checkpoint()
    state.unpersist()
    if before is not None:
        before.unpersist()
    return start, grown


# --------------------------------------------------------------------------- forests

class Crown:
    """The upper nodes of a forest's tree: those of more than ``most`` rows, and their
    children. ``handed`` are the nodes that tasks go on with."""

    def __init__(self, number: int, s: TreeSettings, sizes: np.ndarray, most: int):
        self.s, self.sizes, self.most, self.stat = s, sizes, most, ClassCounts(None, None, s.classes)
        self.rng = np.random.default_rng([s.seed, number, 3])
        self.width = max(1, int(len(sizes) ** 0.5))
        self.slot, self.cut, self.left = np.full(1, -1), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.depth, self.rows, self.value = [0], [0], [np.zeros(s.classes)]
        self.gains: dict[int, float] = {}
        self.handed: list[int] = []
        self.best: dict[int, tuple] = {}
        self.known = False
        self._ask(np.zeros(1, np.int64))

    def _ask(self, nodes: np.ndarray, all_slots: bool = False) -> None:
        self.nodes, slots = nodes, len(self.sizes)
        if all_slots or self.width >= slots:
            self.chosen = np.broadcast_to(np.arange(slots), (len(nodes), slots))
        else:
            drawn = self.rng.random((len(nodes), slots)).argpartition(self.width, axis=1)
            self.chosen = drawn[:, :self.width]

    def advance(self, sums: np.ndarray, counts: np.ndarray) -> None:
        """Take the sums and row counts per cell of the nodes' chosen slots."""
        stat, (nodes, width) = self.stat, self.chosen.shape
        size = self.sizes[self.chosen].ravel()
        pair = np.repeat(np.arange(len(size)), size)
        bin_ = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        dense = np.zeros((len(size), max(2, int(size.max(initial=0))), sums.shape[1]))
        below = np.zeros(dense.shape[:2], np.int64)
        dense[pair, bin_], below[pair, bin_] = sums, counts
        total, n_rows = dense.sum(axis=1), below.sum(axis=1)
        if not self.known:
            self.known, self.rows[0], self.value[0] = True, int(n_rows[0]), stat.value(total[:1])[0]
            if not self._goes_on(0, total[0]):
                self.nodes = self.nodes[:0]
                return
        left, below = dense.cumsum(axis=1)[:, :-1], below.cumsum(axis=1)[:, :-1]
        right = total[:, None, :] - left
        gain = stat.score(left) + stat.score(right) - stat.score(total)[:, None]
        both = (below > 0) & (below < n_rows[:, None])
        gain[~(both & stat.allowed(left) & stat.allowed(right))] = -np.inf
        cut = gain.argmax(axis=1)
        gain = gain[np.arange(len(cut)), cut].reshape(nodes, width)
        again = []
        for i, (node, j) in enumerate(zip(self.nodes.tolist(), gain.argmax(axis=1).tolist())):
            k = i * width + j
            if np.isneginf(gain[i, j]) and width < len(self.sizes):
                # All drawn slots are constant in this node: look at the others too.
                again.append(node)
            elif gain[i, j] > stat.least_gain:
                self.best[node] = (int(self.chosen[i, j]), int(cut[k]), float(gain[i, j]), left[k, cut[k]],
                                   right[k, cut[k]], int(below[k, cut[k]]), int(n_rows[k] - below[k, cut[k]]))
        if again:
            self._ask(np.array(again), True)
            return
        wanted, made = [], len(self.slot)
        for node, (slot, cut_, gained, *children) in sorted(self.best.items()):
            self.slot[node], self.cut[node], self.left[node] = slot, cut_, len(self.rows)
            self.gains[slot] = self.gains.get(slot, 0.0) + max(gained, 0.0)
            for totals, n in zip(children[:2], children[2:]):
                self.depth.append(self.depth[node] + 1)
                self.rows.append(n)
                self.value.append(stat.value(totals[None])[0])
                if self._goes_on(len(self.rows) - 1, totals):
                    wanted.append(len(self.rows) - 1)
        self.slot, self.cut, self.left = (np.concatenate([old, np.full(len(self.rows) - made, new, np.int64)])
                                          for old, new in ((self.slot, -1), (self.cut, 0), (self.left, 0)))
        self.best = {}
        self._ask(np.array(wanted, np.int64))

    def _goes_on(self, node: int, totals: np.ndarray) -> bool:
        """Whether a node is split here; hands it to a task where that can split it."""
        if not self.stat.open(totals) or self.depth[node] == self.s.maxDepth:
            return False
        if self.rows[node] <= self.most:
            self.handed.append(node)
            return False
        return True

    def tree(self) -> Tree:
        return Tree(self.slot, self.cut, self.left, np.array(self.value), self.gains)


def _drawn(s: TreeSettings, number: int, part: int, draws: int, weights: np.ndarray) -> np.ndarray:
    """Weights of a part's rows times how often a tree draws them."""
    rng = np.random.default_rng([s.seed, number, 4, part])
    return np.bincount(rng.integers(0, len(weights), draws), minlength=len(weights)) * weights


def _drawn_sums(s: TreeSettings, asked: list[tuple], sizes: np.ndarray):
    """Per tree, sums and row counts per cell of its nodes' chosen slots, over a part."""
    def run(state: tuple) -> list[np.ndarray]:
        part, bins, labels, weights = state
        found = []
        for number, draws, slot, cut, left, nodes, chosen in asked:
            drawn = _drawn(s, number, part, draws[part], weights)
            place = np.full(len(slot), -1)
            place[nodes] = np.arange(len(nodes))
            at = place[nodes_of(slot, cut, left, bins.__getitem__, len(labels))]
            rows = np.flatnonzero((drawn > 0) & (at >= 0))
            at, stat = at[rows], ClassCounts(labels.astype(np.int64), drawn, s.classes)
            size = sizes[chosen]
            starts = (np.cumsum(size) - size.ravel()).reshape(size.shape)
            cells = int(size.sum())
            sums, counts = np.zeros((cells, s.classes)), np.zeros(cells, np.int64)
            for j in range(chosen.shape[1]):
                keys = starts[at, j] + bins[chosen[at, j], rows]
                sums += stat.sums(keys, rows, cells)
                counts += np.bincount(keys, minlength=cells)
            found += [sums, counts]
        return found
    return run


def _handed_on(s: TreeSettings, crowns: list[tuple]):
    """The drawn rows of every node that a task goes on with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part, bins, labels, weights = _loaded(row)
                for number, draws, slot, cut, left, handed in crowns:
                    drawn = _drawn(s, number, part, draws[part], weights)
                    place = np.full(len(slot), -1)
                    place[[node for node, _ in handed]] = np.arange(len(handed))
                    at = place[nodes_of(slot, cut, left, bins.__getitem__, len(labels))]
                    for i, (node, depth) in enumerate(handed):
                        own = np.flatnonzero((at == i) & (drawn > 0))
                        if len(own):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([number], pa.int32()), pa.array([node], pa.int32()),
                                 pa.array([depth], pa.int32()), pa.array([part]),
                                 pa.array([np.ascontiguousarray(bins[:, own].T).tobytes()], pa.binary()),
                                 pa.array([labels[own].tobytes()], pa.binary()),
                                 pa.array([drawn[own].tobytes()], pa.binary())],
                                names=[name.split()[0] for name in _HANDED_DDL.split(", ")])
    return run


def _grow_rest(s: TreeSettings, slots: int):
    """The rest of a tree below one node."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").to_pydict()
        number, node = rows["number"][0], rows["node"][0]
        labels = np.frombuffer(b"".join(rows["labels"]), "<u2").astype(np.int64)
        weights = np.frombuffer(b"".join(rows["weights"]), "<f8")
        bins = np.frombuffer(b"".join(rows["bins"]), np.uint8).reshape(len(labels), slots)
        depth = None if s.maxDepth is None else s.maxDepth - rows["depth"][0]
        tree = grow(bins, ClassCounts(labels, weights, s.classes), np.arange(len(labels)), depth, np.arange(slots),
                    max(1, int(slots ** 0.5)), np.random.default_rng([s.seed, number, 5, node]),
                    int(bins.max(initial=0)) + 1)
        return pa.Table.from_batches([tr._tree_batch([tr._tree_row(number, 0, tree, np.zeros(s.classes), node)])])
    return run


def spread_forest(table: Binned, s: TreeSettings, path: str) -> None:
    """Write a forest's trees to ``path``: a row for each crown, and one for each node
    that a task went on with."""
    spark, parts, sizes = table.parts.sparkSession, dealt(table), table.layout.sizes
    rows = parts.rdd.map(_loaded).persist(StorageLevel.MEMORY_AND_DISK)
    n_rows, slots = sum(table.sizes.values()), len(sizes)
    most = max(1, tr.FIT_CELLS // max(1, slots))
    at_once = max(1, min(s.numTrees, PORTION_CELLS // max(1, n_rows * slots)))
    shares = np.array(list(table.sizes.values())) / n_rows
    for first in range(0, s.numTrees, at_once):
        crowns, draws = {}, {}
        for number in range(first, min(first + at_once, s.numTrees)):
            drawn = np.random.default_rng([s.seed, number]).multinomial(n_rows, shares)
            draws[number] = dict(zip(table.sizes, drawn.tolist()))
            crowns[number] = Crown(number, s, sizes, most)
        while asked := [(number, draws[number], c.slot, c.cut, c.left, c.nodes, c.chosen)
                        for number, c in crowns.items() if len(c.nodes)]:
            found = _summed(rows, _drawn_sums(s, asked, sizes))
            for i, (number, *_) in enumerate(asked):
                crowns[number].advance(found[2 * i], found[2 * i + 1])
        made = spark.createDataFrame([tr._tree_row(number, 0, c.tree(), np.zeros(s.classes))
                                      for number, c in crowns.items()], tr._TREE_DDL)
        handed = [(number, draws[number], c.slot, c.cut, c.left, [(node, c.depth[node]) for node in c.handed])
                  for number, c in crowns.items() if c.handed]
        if handed:
            nodes = sum(len(own) for *_, own in handed)
            tasks = max(1, min(nodes, 4 * spark.sparkContext.defaultParallelism))
            made = made.unionByName(
                table.parts.mapInArrow(_handed_on(s, handed), _HANDED_DDL).repartition(tasks, "number", "node")
                .groupBy("number", "node").applyInArrow(_grow_rest(s, slots), tr._TREE_DDL))
        made.write.mode("append").parquet(path)
    rows.unpersist()
