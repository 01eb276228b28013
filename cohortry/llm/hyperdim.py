"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector is the product
of its letters' vectors, each rotated by its place in the n-gram; a text's vector
is the sum over its n-grams. A language's prototype is the sum over its training
texts; a text belongs to the prototype with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import lean, marked, ready, unmarked
from cohortry.llm.samples import bounded_sample, held_out

DIMS = 1024
GRAM = 3
#: Training texts per language: the bound of the labelled sample.
PER_LANGUAGE = 1000
#: n-grams whose vectors a worker keeps; they are rebuilt when more come.
KEPT_GRAMS = 30_000
#: Sharpness of the score over the cosines.
SHARPNESS = 20.0
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=8192)
def letter_vector(code: int, dims: int) -> np.ndarray:
    """The vector of a letter; 0 stands for a gap between words."""
    return np.random.default_rng([code, dims]).choice(np.array([-1, 1], np.int8), dims)


def gram_vector(codes: tuple[int, ...], dims: int) -> np.ndarray:
    bound = np.ones(dims, np.int8)
    for place, code in enumerate(codes):
        bound = bound * np.roll(letter_vector(code, dims), len(codes) - 1 - place)
    return bound


def grams(text: str | None, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, packed 21 bits a letter, and their counts. Letters are
    lower-cased; all else is one gap, as are both ends. None without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_letters()[codes], codes, 0).astype(np.int64)
    codes = np.concatenate([[0], codes, [0]])
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(codes) < n:
        codes = np.concatenate([codes, np.zeros(n - len(codes), np.int64)])
    packed = np.zeros(len(codes) - n + 1, np.int64)
    for place in range(n):
        packed = (packed << 21) | codes[place:len(codes) - n + 1 + place]
    return np.unique(packed, return_counts=True)


class Vectors:
    """Vectors of n-grams, kept in one matrix of bytes and cast portion by portion."""

    def __init__(self, dims: int = DIMS, n: int = GRAM, kept: int = KEPT_GRAMS):
        self.dims, self.n, self.kept = dims, n, kept
        self._clear()

    def _clear(self) -> None:
        self.at: dict[int, int] = {}
        self.matrix = np.empty((1024, self.dims), np.int8)

    def _rows(self, packed: np.ndarray) -> np.ndarray:
        if len(self.at) + len(packed) > self.kept:
            self._clear()
        at = self.at
        rows = np.empty(len(packed), np.int64)
        for i, g in enumerate(packed.tolist()):
            row = at.get(g)
            if row is None:
                row = at[g] = len(at)
                if row == len(self.matrix):
                    self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
                codes = tuple((g >> 21 * k) & 0x1FFFFF for k in reversed(range(self.n)))
                self.matrix[row] = gram_vector(codes, self.dims)
            rows[i] = row
        return rows

    def bundle(self, packed: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the n-grams' vectors; many distinct ones in portions."""
        total = np.zeros(self.dims, np.float32)
        for i in range(0, len(packed), 1024):
            part = self._rows(packed[i:i + 1024])
            total += counts[i:i + 1024].astype(np.float32) @ self.matrix[part].astype(np.float32)
        return total


def prototypes(sample: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Unit vectors per language from a bounded sample. Each text counts with
    length 1, so that long texts do not outweigh others. The driver receives one
    vector per task and language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = Vectors(), {}
        for batch in batches:
            for name, body in zip(*(c.to_pylist() for c in batch.columns)):
                v = vectors.bundle(*grams(body))
                norm = np.linalg.norm(v)
                if norm:
                    sums[name] = sums.get(name, 0) + v / norm
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()),
             pa.array([v.astype("<f8").tobytes() for v in sums.values()], pa.binary())],
            names=["lang", "vector"])

    found: dict[str, np.ndarray] = {}
    parts = sample.where(F.col(lang).isNotNull()).select(lang, text).mapInArrow(
        run, "lang string, vector binary")
    for name, packed in sorted(tuple(r) for r in parts.collect()):
        found[name] = found.get(name, 0) + np.frombuffer(packed, "<f8")
    return {name: v / np.linalg.norm(v) for name, v in found.items() if np.linalg.norm(v)}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text",
            lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` plus language and score. The score is the share of the best
    language in a softmax over the cosines; 'und' with score 0 where a text is
    null or has no letters, or nothing was learned. Ties go to the first name."""
    ready(docs.sparkSession)
    names = sorted(profiles)
    shared = docs.sparkSession.sparkContext.broadcast(
        (names, np.array([profiles[n] for n in names], np.float32).reshape(len(names), DIMS)))

    def score(chunks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labels, matrix = shared.value
        vectors = Vectors()
        for texts in chunks:
            best, scores = [], []
            for body in texts:
                v = vectors.bundle(*grams(body.as_py()))
                norm = float(np.linalg.norm(v))
                if not norm or not labels:
                    best.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = (matrix @ v).astype(np.float64) / norm
                shares = np.exp(SHARPNESS * (cosines - cosines.max()))
                k = int(cosines.argmax())
                best.append(labels[k])
                scores.append(float(shares[k] / shares.sum()))
            yield pa.StructArray.from_arrays(
                [pa.array(best, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    # The text alone goes to Python, once; the rows stay where they are.
    scorer = F.arrow_udf(lean(score), "lang string, score double", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    found = docs.withColumn("_profiled", scorer(F.col(text)))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_profiled.lang").alias(lang_name),
                        F.col("_profiled.score").alias(score_name))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Prototypes from a bounded sample of the rows that are not held out."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                          & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    return prototypes(bounded_sample(labelled, "lang", per_language))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document. Null ids are
    never learned from; repeated rows are predicted alike."""
    texts = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(texts, learn(docs)).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose language is unknown or scores below
    ``least``; same columns. Null and letterless texts go, whatever their other columns;
    rows that repeat id or text are judged alike and stay or go together; where no
    language can be learned every row goes. An empty table gives no rows."""
    found = predict(docs.select(*marked(docs)), learn(docs), "in_text")
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(
        *unmarked(docs.columns))
