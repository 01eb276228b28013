"""Alignment of two tokenizers' tokens by the bytes that they cover.

A worker collects documents to chunks of bounded size and works on Arrow columns
throughout: token lists are flattened with their parents' numbers, the tokens'
byte lengths are summed up document by document, and both sides are joined on
(document, end). A row of that full outer join is the end of one piece that lies in
exactly one token of each side, so each row is a link; a row of both sides ends a
group. Which pairs of ids are linked in how many documents is counted per chunk and
merged by Spark. A chunk sends every pair once and gets its corpus-wide count back
once, so the shuffle follows the distinct pairs of a chunk, not the links.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import ready
from cohortry.sources.scratch import settle

A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"
#: Bytes of text after which a worker closes a chunk; a longer document is one alone.
CHUNK_BYTES = 2 << 20
#: Characters that an encoder gets at once.
PORTION_CHARS = 1 << 18
_B_BITS = 32
# Fixed value: how the byte-level vocabulary splits a text.
_BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: ASCII without rare controls, and Latin letters and signs.
_PLAIN = re.compile("[\t\n\r -~\xa1-\u024f]*")

_CHUNK = pa.schema([
    ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.list_(pa.int32())),
    ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64()))])
_CHUNK_DDL = ("chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, "
              "groups_sha256 string, links array<int>, pairs array<bigint>, holders array<bigint>")
_OUT = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in (
    "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])
_OUT_DDL = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
            "count_sum bigint, groups_sha256 string")


def default_files() -> tuple[str, str]:
    """Where the two public vocabularies lie; only tasks open them."""
    import public_tokenizers
    return public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable
    bytes of Latin-1 are their own letters, all others follow from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


def _portions(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about PORTION_CHARS characters, so that an encoder's own lists
    stay small; a longer text is one alone."""
    held, weight = [], 0
    for t in texts:
        if held and weight + len(t) > PORTION_CHARS:
            yield held
            held, weight = [], 0
        held.append(t)
        weight += len(t)
    if held:
        yield held


def _listed(parts: list[bytes]) -> pa.ListArray:
    """Packed ids of several texts as one list column."""
    ends = np.cumsum([0, *(len(p) >> 2 for p in parts)]).astype(np.int32)
    flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(ends), flat)


def _rank_encoder(tokenizer, vocabulary: list[bytes]):
    """A quicker encoder of plain texts for the same vocabulary, or None.

    The file's rules join the pair whose rule comes first. Where the rules' products
    stand in the vocabulary in the rules' order, each from one rule, that is the pair
    with the smallest id, which is what the other library looks for.
    """
    import tiktoken
    from tokenizers import pre_tokenizers
    split, model = tokenizer.pre_tokenizer, json.loads(tokenizer.to_str())["model"]
    if not (tokenizer.normalizer is None and isinstance(split, pre_tokenizers.ByteLevel)
            and split.use_regex and not split.add_prefix_space and model.get("merges")):
        return None
    rules = [r.split(" ") if isinstance(r, str) else r for r in model["merges"]]
    products = [model["vocab"].get(a + b, -1) for a, b in rules]
    if products != sorted(set(products)) or products[0] < 256:
        return None
    ranks = {vocabulary[i]: i for i in [*range(products[0]), *products]}
    return tiktoken.Encoding("ranks", pat_str=_BYTE_PIECES, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def byte_side(path: str):
    """Encoder of texts and the bytes of every id, for a byte-level vocabulary. Texts
    of plain characters take the quicker encoder of the same vocabulary; two versions
    of a pattern may differ on other characters, so other texts never do."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    letters = byte_letters()
    names = sorted(tokenizer.get_vocab().items(), key=lambda item: item[1])
    vocabulary: list[bytes] = [b""] * (names[-1][1] + 1)
    for name, number in names:
        vocabulary[number] = bytes(letters[c] for c in name) if all(c in letters for c in name) \
            else name.encode()
    quick = _rank_encoder(tokenizer, vocabulary)

    def encode(texts: list[str]) -> pa.ListArray:
        return _listed([
            packed(quick.encode_ordinary(t)) if quick and _PLAIN.fullmatch(t)
            else packed(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts])

    return encode, pa.array(vocabulary, pa.binary())


@lru_cache(maxsize=2)
def piece_side(path: str):
    """Encoder of texts and the bytes of every id, for a piece vocabulary, which adds
    a blank before a text by itself."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    vocabulary = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
                  for i, p in enumerate(pieces)]

    def encode(texts: list[str]) -> pa.ListArray:
        return _listed([packed(ids) for some in _portions(texts)
                        for ids in model.encode([t[1:] for t in some], num_threads=1)])

    return encode, pa.array(vocabulary, pa.binary())


@dataclass
class Side:
    """One tokenizer's tokens of some documents, one after the other."""
    ids: pa.ListArray
    flat: pa.Array
    parents: pa.Array
    bytes: pa.BinaryArray

    @classmethod
    def of(cls, ids: pa.ListArray, vocabulary: pa.BinaryArray) -> "Side":
        flat = pc.list_flatten(ids)
        return cls(ids, flat, pc.list_parent_indices(ids), pc.take(vocabulary, flat))

    def starts(self) -> np.ndarray:
        """Numbers of the documents' first tokens, and of the last one's end."""
        return np.concatenate([[0], np.cumsum(self.ids.value_lengths().to_numpy())])

    def joined(self) -> pa.BinaryArray:
        """The tokens' bytes joined by document, without a copy."""
        _, offsets, data = self.bytes.buffers()
        ends = np.frombuffer(offsets, "<i4", len(self.bytes) + 1, self.bytes.offset * 4)
        at = ends[self.starts()].astype("<i4") if len(ends) else np.zeros(len(self.ids) + 1, "<i4")
        return pa.Array.from_buffers(pa.binary(), len(self.ids), [None, pa.py_buffer(at.tobytes()), data])

    def ends(self, name: str) -> pa.Table:
        """(doc, end, token): cumulative sums of byte lengths, begun anew with each
        document."""
        sums = pc.cumulative_sum(pc.cast(pc.binary_length(self.bytes), pa.int64()))
        totals = np.concatenate([[0], sums.to_numpy()])
        before = pa.array(totals[self.starts()[:-1]])
        end = pc.subtract(sums, pc.take(before, self.parents))
        return pa.table({"doc": self.parents, "end": end,
                         name: pa.array(np.arange(len(self.flat), dtype=np.int64))})


def encode_both(texts: pa.Array, files: tuple[str, str]) -> tuple[np.ndarray, Side, Side]:
    """Which texts have tokens, and the tokens of those texts on both sides. A text is
    left without tokens when it is null or empty, or when the joined bytes of either
    side are not a blank and the text."""
    (encode_a, words_a), (encode_b, words_b) = byte_side(files[0]), piece_side(files[1])
    there = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
    full = pc.binary_join_element_wise(" ", texts.filter(there), "")
    listed = full.to_pylist()
    a, b = Side.of(encode_a(listed), words_a), Side.of(encode_b(listed), words_b)
    whole = full.cast(pa.binary())
    same = pc.and_(pc.equal(a.joined(), whole), pc.equal(b.joined(), whole))
    if not pc.all(same).as_py():
        a, b = Side.of(a.ids.filter(same), words_a), Side.of(b.ids.filter(same), words_b)
    has = there.to_numpy(zero_copy_only=False).copy()
    has[has] = same.to_numpy(zero_copy_only=False)
    return has, a, b


def links_of(a: Side, b: Side) -> pa.Table:
    """(doc, end, a, b, both): every pair of tokens that share bytes, in order of the
    text, as numbers of tokens; ``both`` where both tokens end."""
    ends = a.ends("a").join(b.ends("b"), ["doc", "end"], join_type="full outer",
                            coalesce_keys=True, use_threads=False)
    ends = ends.sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()
    both = pc.and_(pc.is_valid(ends["a"]), pc.is_valid(ends["b"]))
    # A piece that ends inside a token belongs to the token that ends next.
    return pa.table({"doc": ends["doc"], "end": ends["end"], "both": both,
                     "a": pc.fill_null_backward(ends["a"].combine_chunks()),
                     "b": pc.fill_null_backward(ends["b"].combine_chunks())})


def _lists(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values)


def group_texts(a: Side, b: Side, links: pa.Table, docs: int) -> tuple[np.ndarray, pa.Array]:
    """Per document: its number of groups, and ``a1,a2|b1;a3|b2,b3``."""
    closed = links.filter(links["both"])
    sides = []
    for side, name in ((a, "a"), (b, "b")):
        texts = pc.cast(side.flat, pa.string())
        sides.append(pc.binary_join(_lists(texts, closed[name].to_numpy() + 1), ","))
    groups = pc.binary_join_element_wise(*sides, "|")
    per_doc = np.bincount(closed["doc"].to_numpy(), minlength=docs)
    return per_doc, pc.binary_join(_lists(groups, np.cumsum(per_doc)), ";")


def pair_counts(a: Side, b: Side, links: pa.Table) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The chunk's pairs of ids, in how many of its documents each is linked, and for
    every link the place of its pair."""
    ids_a = pc.cast(pc.take(a.flat, links["a"].combine_chunks()), pa.int64())
    ids_b = pc.cast(pc.take(b.flat, links["b"].combine_chunks()), pa.int64())
    coded = pc.bit_wise_or(pc.shift_left(ids_a, _B_BITS), ids_b).dictionary_encode()
    held = (pa.table({"doc": links["doc"], "place": coded.indices})
            .group_by(["doc", "place"], use_threads=False).aggregate([])
            .group_by("place", use_threads=False).aggregate([("place", "count")]))
    holders = np.zeros(len(coded.dictionary), np.int64)
    holders[held["place"].to_numpy()] = held["place_count"].to_numpy()
    return coded.dictionary, pa.array(holders), coded.indices


def align_chunk(number: int, doc_ids: pa.Array, texts: pa.Array, files: tuple[str, str]) -> pa.RecordBatch:
    """A row per document, and a last row with the chunk's pairs and their counts."""
    has, a, b = encode_both(texts, files)
    links = links_of(a, b)
    n_groups, groups = group_texts(a, b, links, len(a.ids))
    pairs, holders, places = pair_counts(a, b, links)
    per_doc = np.bincount(links["doc"].to_numpy(), minlength=len(a.ids))

    def spread(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(has) + 1, np.int64)
        out[:-1][has] = values
        return out

    digests = np.full(len(has) + 1, "", object)
    digests[:-1][has] = [hashlib.sha256(g.encode()).hexdigest() for g in groups.to_pylist()]
    rows = len(has)
    last = np.zeros(rows + 1, bool)
    last[-1] = True

    def only_last(values: pa.Array, kind: pa.DataType) -> pa.Array:
        offsets = np.zeros(rows + 2, np.int32)
        offsets[-1] = len(values)
        return pa.ListArray.from_arrays(pa.array(offsets), values.cast(kind), mask=pa.array(~last))

    return pa.RecordBatch.from_arrays([
        pa.array(np.full(rows + 1, number)), pa.concat_arrays([doc_ids.cast(pa.int64()), pa.nulls(1, pa.int64())]),
        pa.array(spread(a.ids.value_lengths().to_numpy())),
        pa.array(spread(b.ids.value_lengths().to_numpy())), pa.array(spread(n_groups)),
        pa.array(digests, pa.string()), _lists(places.cast(pa.int32()), np.cumsum(spread(per_doc))),
        only_last(pairs, pa.int64()), only_last(holders, pa.int64())], schema=_CHUNK)


def _chunks(files: tuple[str, str], chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, weight = [], 0
        for batch in batches:
            # Long batches are cut, so that a chunk exceeds its size by one text at most.
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            begin = 0
            for i, n in enumerate(sizes.tolist()):
                weight += n
                if weight >= chunk_bytes:
                    held.append(batch.slice(begin, i + 1 - begin))
                    yield _closed(held, number, files)
                    number, held, weight, begin = number + 1, [], 0, i + 1
            if begin < len(sizes):
                held.append(batch.slice(begin))
        if held:
            yield _closed(held, number, files)
    return run


def _closed(held: list[pa.RecordBatch], number: int, files: tuple[str, str]) -> pa.RecordBatch:
    ids, texts = (pa.concat_arrays([b.column(i) for b in held]) for i in range(2))
    return align_chunk(number, ids, texts, files)


def _totals():
    """For a stream sorted by chunk with a chunk's counts first: each document's
    links among the best of their id, and the sum of the links' counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, counts, best = None, [], []
        for batch in batches:
            own = batch.column("chunk").to_numpy()
            cuts = np.flatnonzero(np.diff(own)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)]):
                part = batch.slice(begin, end - begin)
                if own[begin] != chunk:
                    chunk, counts, best = own[begin], [], []
                answers = part.filter(pc.is_valid(part.column("n")))
                if answers.num_rows:
                    counts.append(answers.column("n").to_numpy())
                    best.append(answers.column("best").to_numpy(zero_copy_only=False))
                docs = part.filter(pc.is_null(part.column("n")))
                if docs.num_rows:
                    if len(counts) > 1:
                        counts, best = [np.concatenate(counts)], [np.concatenate(best)]
                    yield _answered(docs, counts[0] if counts else np.zeros(0, np.int64),
                                    best[0] if best else np.zeros(0, bool))
    return run


def _answered(docs: pa.RecordBatch, counts: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    links = docs.column("links")
    at = pc.list_flatten(links).to_numpy()
    ends = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy())])

    def sums(values: np.ndarray) -> pa.Array:
        total = np.concatenate([[0], np.cumsum(values[at].astype(np.int64))])
        return pa.array(total[ends[1:]] - total[ends[:-1]])

    return pa.RecordBatch.from_arrays(
        [*(docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")),
         pa.array(np.diff(ends)), sums(best), sums(counts), docs.column("groups_sha256")], schema=_OUT)


def corpus_counts(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk, place, pair) of every chunk's pairs, and (pair, n, best): in how many
    documents of the corpus a pair is linked, and whether none of its A id's pairs
    is linked in more."""
    pairs = chunks.where("pairs IS NOT NULL").select(
        "chunk", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "p")).select(
        "chunk", "place", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("holders"))
    counts = settle(pairs.groupBy("pair").agg(F.sum("holders").alias("n")))
    a = F.shiftright("pair", _B_BITS)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    named = counts.withColumn("a", a).join(most, "a").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return pairs.drop("holders"), named


def align(docs: DataFrame, key: str = "doc_id", text: str = "text",
          files: tuple[str, str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row.

    Null and empty texts, and texts whose joined bytes are not given back by both
    tokenizers, have no tokens: zeros and an empty digest. A pair's count is the
    number of rows in which it is linked, so repeated rows count each. Ids may be
    null or repeated. Of pairs with equal counts all are best. Other columns play no
    part. An empty table gives no rows.
    """
    ready(docs.sparkSession)
    files = files or default_files()
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    chunks = settle(rows.mapInArrow(_chunks(files, chunk_bytes), _CHUNK_DDL))
    pairs, counts = corpus_counts(chunks)
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"]
    types = dict(chunks.dtypes)
    answers = pairs.join(counts, "pair").select(
        "chunk", F.col("place").cast("bigint").alias("place"), "n", "best",
        *[F.lit(None).cast(types[c]).alias(c) for c in names])
    # Documents come after all of their chunk's counts.
    found = chunks.where("pairs IS NULL").select(
        "chunk", F.lit(1 << 62).alias("place"), F.lit(None).cast("bigint").alias("n"),
        F.lit(None).cast("boolean").alias("best"), *names)
    return (answers.unionByName(found).repartition("chunk").sortWithinPartitions("chunk", "place")
            .mapInArrow(_totals(), _OUT_DDL))
