"""Quality classifier: random-indexing word vectors, pooled per document, and a
two-layer network with calibrated probabilities.

Every word has a fixed sparse random index vector, made from its hash. A word's
vector is the sum of the index vectors of the words around it in the training
texts; a word that those texts lack takes the index vectors around it where it
stands. A document is the mean of its words' vectors. The
network is trained with numpy on a bounded sample of labelled rows; a temperature
fitted on rows that the training left out makes its outputs probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import WordHash, batches_of, ready
from cohortry.llm.samples import bounded_sample, held_out
from cohortry.sources.scratch import settle

DIMS = 64
NONZERO = 4
REACH = 2
#: Bounds of the labelled sample and of the vectors that are learned from it. Words
#: beyond the bound, or rarer than LEAST_COUNT, count as words that the sample lacks.
PER_LABEL = 4000
VOCABULARY = 65_536
LEAST_COUNT = 3
#: Places of a text whose vectors are made at once.
PLACES = 8192
HIDDEN = 32
THRESHOLD = 0.7
SEED = 42
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def tokens(text: str | None) -> list[str]:
    """Words, numbers and runs of signs. A word in capitals counts as <caps>, and
    one that repeats the word before it, signs between them or not, as <again>;
    any other as itself in small letters."""
    found = _TOKEN.findall(text or "")
    return [("<again>" if w == before or w == earlier else "<caps>" if len(w) > 1 and w.isupper()
             else w.lower()) if w.isalpha() else w
            for w, before, earlier in zip(found, ["", *found], ["", "", *found])]


def index_vectors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse random vectors of words, from seven bits of their hash a place: the
    places that are not zero, and +1 or -1 for each."""
    bits = hashes[:, None] >> np.arange(0, 7 * NONZERO, 7, dtype=np.uint64)
    return ((bits & np.uint64(DIMS - 1)).astype(np.int64),
            ((bits >> np.uint64(6)) & np.uint64(1)).astype(np.float32) * 2 - 1)


def vocabulary(sample: DataFrame, text: str = "text", most: int = VOCABULARY,
               least: int = LEAST_COUNT) -> dict[str, int]:
    """Numbers of the sample's commonest tokens; 0 stands for all others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for body in batch.column(0).to_pylist():
                counts.update(tokens(body))
        yield from batches_of(counts.items(), pa.schema([("token", pa.string()), ("n", pa.int64())]))

    counted = sample.select(text).mapInArrow(run, "token string, n bigint").groupBy("token").agg(
        F.sum("n").alias("n")).where(F.col("n") >= least)
    kept = counted.orderBy(F.desc("n"), "token").limit(most).collect()
    return {r["token"]: i + 1 for i, r in enumerate(kept)}


def _numbers(body: str | None, known: dict[str, int],
             hashes: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and hashes of a text's tokens."""
    found = tokens(body)
    return (np.array([known.get(t, 0) for t in found], np.int64),
            np.array([hashes[t] for t in found], np.uint64))


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


def word_vectors(sample: DataFrame, known: dict[str, int], text: str = "text") -> np.ndarray:
    """Unit vectors by token number: sums of the index vectors of the tokens at
    most REACH places away, over the bounded sample. The sample is read by a few
    tasks, each of which sends one table of the vocabulary's size."""
    size = len(known) + 1
    shared = sample.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, hashes = shared.value, WordHash()
        sums = np.zeros(size * DIMS)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                ids, hashed = _numbers(body, numbers, hashes)
                where, sign = index_vectors(hashed)
                for step in range(1, REACH + 1):
                    for a, w, s in ((ids[:-step], where[step:], sign[step:]),
                                    (ids[step:], where[:-step], sign[:-step])):
                        np.add.at(sums, (a[:, None] * DIMS + w).ravel(), s.ravel())
        yield pa.RecordBatch.from_arrays([pa.array([sums.astype("<f4").tobytes()], pa.binary())],
                                         names=["sums"])

    parts = sample.select(text).coalesce(4).mapInArrow(run, "sums binary").collect()
    total = sum(np.frombuffer(r["sums"], "<f4").astype(np.float64) for r in parts)
    vectors = (total if len(parts) else np.zeros(size * DIMS)).reshape(size, DIMS)
    return _unit(vectors).astype(np.float32)


@dataclass
class Model:
    known: dict[str, int]
    vectors: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float

    hashes: WordHash = field(default_factory=WordHash, repr=False)

    def pooled(self, body: str | None) -> np.ndarray:
        """The mean of the tokens' vectors; zero for a text without tokens."""
        ids, hashes = _numbers(body, self.known, self.hashes)
        if not len(ids):
            return np.zeros(DIMS, np.float32)
        counts = np.bincount(ids)
        counts[0] = 0
        some = np.flatnonzero(counts)
        total = counts[some].astype(np.float32) @ self.vectors[some]
        unseen = np.flatnonzero(ids == 0)
        for begin in range(0, len(unseen), PLACES):
            total = total + _around(hashes, unseen[begin:begin + PLACES]).sum(axis=0)
        return (total / len(ids)).astype(np.float32)

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-_margin(pooled, self.layers) / self.temperature))


def _around(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Unit vectors of tokens by the index vectors of the tokens around them in their
    own text."""
    cells, signs = [], []
    for step in (s for r in range(1, REACH + 1) for s in (-r, r)):
        at = places + step
        inside = np.flatnonzero((at >= 0) & (at < len(hashes)))
        where, sign = index_vectors(hashes[at[inside]])
        cells.append((inside[:, None] * DIMS + where).ravel())
        signs.append(sign.ravel())
    sums = np.bincount(np.concatenate(cells), np.concatenate(signs), len(places) * DIMS)
    return _unit(sums.reshape(-1, DIMS))


def _margin(x: np.ndarray, layers: tuple[np.ndarray, ...]) -> np.ndarray:
    mean, scale, w1, b1, w2, b2 = layers
    return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2


def train_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 60,
                  rate: float = 0.01, decay: float = 1e-4) -> tuple[np.ndarray, ...]:
    """Two layers with tanh between them, by Adam on the weighted log loss."""
    rng = np.random.default_rng(SEED)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    params = [rng.normal(0, 1 / np.sqrt(DIMS), (DIMS, HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for begin in range(0, len(z), 128):
            at = order[begin:begin + 128]
            hidden = np.tanh(z[at] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-(hidden @ params[2] + params[3])))
            error = (p - y[at]) * weight[at] / len(at)
            back = np.outer(error, params[2]) * (1 - hidden ** 2)
            grads = [z[at].T @ back, back.sum(axis=0), hidden.T @ error, error.sum()]
            step += 1
            for k, g in enumerate(grads):
                g = g + decay * params[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - rate * (first[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return (mean, scale, *params)


def fit_temperature(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The divisor of the margins with the least weighted log loss."""
    grid = np.exp(np.linspace(np.log(0.2), np.log(20), 200))
    if not len(margins):
        return 1.0
    signed = np.where(y > 0, margins, -margins)
    losses = [(weight * np.logaddexp(0, -signed / t)).sum() for t in grid]
    return float(grid[int(np.argmin(losses))])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Fit on about ``per_label`` labelled rows of each label, none of them held
    out. Rows are weighted back to the labels' true shares. Every fifth row of
    the sample is left for the temperature. An id with two different labels teaches
    nothing; one that repeats a label counts once. Without labels the score is 0.5."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()
                         & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.col("quality").cast("int").alias("quality")).groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("other")).where(
        "quality = other").drop("other")
    shares = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    chosen = bounded_sample(known, "quality", per_label)
    sample = settle(docs.select("doc_id", "text").join(chosen, "doc_id"))
    numbers = vocabulary(sample)
    model = Model(numbers, word_vectors(sample, numbers), (), 1.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            pooled = [own.pooled(t).astype("<f4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(pooled, pa.binary())],
                                             names=["doc_id", "quality", "pooled"])

    rows = sorted(tuple(r) for r in sample.select("doc_id", "quality", "text").mapInArrow(
        run, "doc_id bigint, quality int, pooled binary").collect())
    if not rows:
        zero = np.zeros(DIMS)
        model.layers = (zero, zero + 1, np.zeros((DIMS, HIDDEN)), np.zeros(HIDDEN),
                        np.zeros(HIDDEN), np.zeros(()))
        return model
    x = np.array([np.frombuffer(r[2], "<f4") for r in rows], np.float64)
    y = np.array([r[1] == 1 for r in rows], np.float64)
    sampled = Counter(r[1] for r in rows)
    weight = np.array([shares[r[1]] / sampled[r[1]] for r in rows])
    weight = weight / weight.mean()
    spare = np.arange(len(rows)) % 5 == 4
    model.layers = train_network(x[~spare], y[~spare], weight[~spare])
    model.temperature = fit_temperature(_margin(x[spare], model.layers), y[spare], weight[spare])
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by its text alone.
    Null and empty texts have the score of a zero vector."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            pooled = np.array([own.pooled(t) for t in batch.column(2).to_pylist()]).reshape(-1, DIMS)
            scores = own.scores(pooled)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(scores, pa.float64()),
                 pa.array((scores >= threshold).astype(np.int32), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, "doc_id bigint, held_out boolean, score double, predicted int")
