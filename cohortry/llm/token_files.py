"""Token ids in Arrow files of equal-length sequences.

All documents' ids, each document closed by an end id, form one stream in
ascending order of document, or in an order that the caller names. A file holds a piece of it, cut into sequences of
``SEQUENCE`` ids as fixed-size lists, with a mask of the same shape, one bit each,
that is true for ids and false for the padding at a file's end. Ids take two bytes
where the vocabulary allows. Each batch also lists where documents begin. The
index knows where a file's batches lie, so ``sequence`` opens the batch of sequence
k alone and gives ids and mask as slices of the mapped file.

Files are Arrow stream files: schema, then record batches of BATCH sequences.
A task's files have names of their own; the written index table names those that
count.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import batches_of, lean, ready, released
from cohortry.llm.warc import open_store
from cohortry.sources.scratch import scratch_path, settle

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SEQUENCE = 2048
#: Sequences of one record batch; sequences after which a task begins a new file.
BATCH = 64
FILE_SEQUENCES = 1 << 15
#: Words whose ids a worker keeps, twice: those met since the last change, and those met
#: before it. More of them take less time; a caller whose workers have little memory
#: names fewer (``kept``). Signs after words are words of their own; those inside the
#: words of unusual texts are counted apart.
KEPT_WORDS, KEPT_SIGNS = 300_000, 4_000
#: Bytes of text that are split into words together.
SPLIT_CHARS = 1 << 21
#: Control characters on which the two sides' white space may differ.
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f]")
#: What keeps a text from being turned into small letters first: those characters,
#: characters beyond the first 256, whose small letters are not one for one, and
#: what may begin a special token.
_UNUSUAL = r"[\x00-\x08\x0e-\x1f\x7f-\x{9f}]|[^\x00-\x{ff}]|<\|"
#: A letter with signs up to the word's end. Letters and signs never share a piece, so
#: that the signs are a word of their own.
_SIGNED = r"([a-zß-öø-ÿ])([.,!?;:*$%#&|()]+)(\s|$)"
#: A run of Latin letters and a run of signs: two pieces. None of these letters is
#: composed or taken apart.
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:*$%#&|()]*)")
_SIGNS = frozenset(".,!?;:*$%#&|()")
#: The rules for which the short ways of WordEncoder hold. They are
#: those of the vocabulary file.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "behavior": "Removed", "invert": True, "pattern": {
        "Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def default_tokenizer() -> str:
    """Where the public vocabulary file lies; only tasks open it."""
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def _splits_into_words(tokenizer) -> bool:
    """Whether a text's ids are those of its words in turn, by the rules above, and
    nothing but ids of pieces can come out."""
    rules = [part and json.loads(part.__getstate__())
             for part in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    return (rules == [_NORMALIZER, _PRE_TOKENIZER] and tokenizer.truncation is None
            and tokenizer.padding is None and not tokenizer.model.dropout
            and all(t.content.startswith("<|")
                    for t in tokenizer.get_added_tokens_decoder().values()))


class WordEncoder:
    """Encodes whole texts with the tokenizers library, each distinct word once.

    The vocabulary drops white space and never merges across it, so a text's ids
    are those of its words in turn. A word of plain letters with signs after it is
    two pieces, which go straight to the library's model, in the characters that
    its byte step gives them. Any other word goes through the whole tokenizer, and
    so does a text with control characters. Files of other rules are read too: their
    texts go through the whole tokenizer.
    """

    def __init__(self, path: str, kept: int | None = None):
        from tokenizers import Tokenizer
        self.kept = kept or KEPT_WORDS
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.size = self.tokenizer.get_vocab_size()
        self.by_words = _splits_into_words(self.tokenizer)
        if self.by_words:
            letters = [chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha()]
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.bytes_of = str.maketrans({c: split(c)[0][0] for c in letters})
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _ids(self, piece: str) -> bytes:
        plain = piece if piece.isascii() else piece.translate(self.bytes_of)
        ids = [t.id for t in self.tokenize(plain)]
        return pack(f"<{len(ids)}I", *ids)

    def _letters(self, piece: str) -> bytes:
        """Ids of small letters alone, which are a word themselves."""
        known = self.words.get(piece)
        if known is None:
            known = self.older.get(piece)
            if known is None:
                known = self._ids(piece)
            self.words[piece] = known
        return known

    def _signs(self, piece: str) -> bytes:
        known = self.signs.get(piece)
        if known is None:
            if len(self.signs) >= KEPT_SIGNS:
                self.signs.clear()
            known = self.signs[piece] = self._ids(piece)
        return known

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if word.isascii():
            # The two commonest forms, without a pattern.
            if word.isalpha():
                return self._letters(word.lower())
            if word[-1] in _SIGNS and word[:-1].isalpha():
                return self._letters(word[:-1].lower()) + self._signs(word[-1])
        if found := _SIMPLE.fullmatch(word):
            letters, signs = found.groups()
            return self._letters(letters.lower()) + (self._signs(signs) if signs else b"")
        return self._whole(word)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_words:
            return [self._whole(t) for t in texts.to_pylist()]
        portion = pc.binary_length(texts).to_numpy(zero_copy_only=False).cumsum() // SPLIT_CHARS
        begins = [0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), len(texts)]
        return [ids for a, b in zip(begins, begins[1:]) for ids in self._by_words(texts.slice(a, b - a))]

    def _by_words(self, texts: pa.Array) -> list[bytes]:
        unusual = pc.match_substring_regex(texts, _UNUSUAL)
        small = pc.utf8_lower(pc.if_else(unusual, "", texts))
        out = self._of_words(pc.utf8_split_whitespace(
            pc.replace_substring_regex(small, _SIGNED, r"\1 \2 ")))
        if rare := pc.indices_nonzero(unusual).to_pylist():
            found = [(i, texts[i].as_py()) for i in rare]
            split = [[] if _ODD.search(t) else t.split() for _, t in found]
            for (i, t), ids in zip(found, self._of_words(pa.array(split, pa.list_(pa.string())))):
                out[i] = self._whole(t) if _ODD.search(t) else ids
        return out

    def _of_words(self, lists: pa.ListArray) -> list[bytes]:
        """Ids of each list of words: every distinct word is looked up once, and its ids
        are copied to the places where it stands."""
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        unknown = [w for w in distinct if w not in self.words]
        if len(self.words) + len(unknown) > self.kept:
            # Words that are met again move on; what was not met since is dropped.
            self.older, self.words = self.words, {}
            unknown = distinct
        older = self.older.get
        for word in unknown:
            known = older(word)
            self.words[word] = self._word(word) if known is None else known
        each = [self.words[w] for w in distinct]
        flat, sizes = np.frombuffer(b"".join(each), "<u4"), np.array([len(i) for i in each], np.int64) // 4
        at = words.indices.to_numpy()
        n = sizes[at]
        ends = n.cumsum()
        places = np.repeat((sizes.cumsum() - sizes)[at] - (ends - n), n)
        places += np.arange(len(places))
        ids = flat[places].tobytes()
        cuts = (4 * np.append(0, ends)[lists.offsets.to_numpy() - lists.offsets[0].as_py()]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


_DOC_IDS, _DOC_STARTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_INDEX = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()),
                    ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                    ("batch_firsts", pa.list_(pa.int64())), ("batch_offsets", pa.list_(pa.int64()))])
_INDEX_DDL = ("part int, number int, file string, n_docs bigint, n_tokens bigint, "
              "batch_firsts array<bigint>, batch_offsets array<bigint>")


def id_type(vocabulary: int) -> pa.DataType:
    """The narrowest type for the ids of a vocabulary."""
    return pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()


class SequenceFile:
    """One file being written. Ids beyond a full batch are written at once.
    ``firsts`` and ``offsets`` tell each batch's first sequence and first byte."""

    def __init__(self, store, path: str, kind: pa.DataType):
        self.schema = pa.schema([("input_ids", pa.list_(kind, SEQUENCE)),
                                 ("mask", pa.list_(pa.bool_(), SEQUENCE)),
                                 ("doc_ids", _DOC_IDS), ("doc_starts", _DOC_STARTS)])
        self.kind = kind
        self.sink = store.open_output_stream(path, compression=None)
        self.writer = pa.ipc.new_stream(self.sink, self.schema)
        self.held, self.n, self.starts = [], 0, []
        self.n_docs = self.n_tokens = self.sequences = 0
        self.firsts, self.offsets = [], []

    def add(self, doc: int | None, ids: bytes) -> None:
        self.starts.append((doc, self.n))
        self.held.append(ids)
        self.n += len(ids) // 4
        self.n_docs += 1
        self.n_tokens += len(ids) // 4
        if self.n >= BATCH * SEQUENCE:
            self._flush(self.n // SEQUENCE)

    def _flush(self, n: int) -> None:
        """Write the first n sequences, the last one padded where ids run out."""
        ids = np.frombuffer(b"".join(self.held), "<u4")
        size = n * SEQUENCE
        mask = np.arange(size) < len(ids)
        full = np.zeros(size, self.kind.to_pandas_dtype())
        full[:min(size, len(ids))] = ids[:size]
        docs, starts = [[] for _ in range(n)], [[] for _ in range(n)]
        for doc, at in self.starts:
            if at < size:
                docs[at // SEQUENCE].append(doc)
                starts[at // SEQUENCE].append(at % SEQUENCE)
        for i in range(0, n, BATCH):
            j = min(n, i + BATCH)
            cut = slice(i * SEQUENCE, j * SEQUENCE)
            self.firsts.append(self.sequences + i)
            self.offsets.append(self.sink.tell())
            self.writer.write_batch(pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(full[cut]), SEQUENCE),
                 pa.FixedSizeListArray.from_arrays(pa.array(mask[cut]), SEQUENCE),
                 pa.array(docs[i:j], _DOC_IDS), pa.array(starts[i:j], _DOC_STARTS)],
                schema=self.schema))
        self.starts = [(doc, at - size) for doc, at in self.starts if at >= size]
        self.held, self.n = [ids[size:].tobytes()], max(0, len(ids) - size)
        self.sequences += n

    def close(self) -> None:
        if self.n:
            self._flush(-(-self.n // SEQUENCE))
        self.writer.close()
        self.sink.close()


def _write(folder: str, tokenizer: str, end_id: int, kept: int | None = None):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        encoder, out, name, done = _encoder(tokenizer, kept), None, "", []
        kind = id_type(max(encoder.size, end_id + 1))

        def finish() -> None:
            out.close()
            done.append((part, len(done), name, out.n_docs, out.n_tokens,
                         out.firsts, out.offsets))

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for doc, packed in zip(ids, encoder.encode(texts)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.arrow"
                    out = SequenceFile(store, f"{base}/{name}", kind)
                out.add(doc, packed + end)
                if out.sequences >= FILE_SEQUENCES:
                    finish()
                    out = None
            del batch, ids, texts, packed
            released()
        if out is not None:
            finish()
        yield from batches_of(done, _INDEX)
    return run


_ENCODERS: dict[tuple[str, int | None], WordEncoder] = {}


def _encoder(path: str, kept: int | None = None) -> WordEncoder:
    """A worker's encoder with the words that it has met so far."""
    if (path, kept) not in _ENCODERS:
        _ENCODERS[path, kept] = WordEncoder(path, kept)
    return _ENCODERS[path, kept]


def shuffled_order(seed: int = 42, key: str = "doc_id", text: str = "text") -> list[Column]:
    """An order for write_sequences in which documents, and copies of a document,
    are spread over all files. Equal rows are told apart by their number in the
    table, so it must be a written one."""
    return [F.xxhash64(F.lit(seed), F.col(key), F.col(text), F.monotonically_increasing_id())]


def write_sequences(docs: DataFrame, folder: str, tokenizer: str | None = None,
                    end_id: int = END_ID, key: str = "doc_id", text: str = "text",
                    order: list[Column] | None = None, kept: int | None = None) -> DataFrame:
    """Write all documents; the written index (part, number, file, n_docs,
    n_tokens, batch_firsts, batch_offsets). Parts ascend with the columns of
    ``order``, and numbers inside a part; where they are equal or not given, with
    doc_id and the text's hash."""
    ready(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    first = {f"order_{i}": c for i, c in enumerate(order or [])}
    ordered = (docs.select(F.col(key).cast("bigint").alias("doc_id"), body.alias("text"),
                           *[c.alias(n) for n, c in first.items()])
               .orderBy(*first, F.asc_nulls_first("doc_id"), F.xxhash64("text"))
               .select("doc_id", "text"))
    return settle(ordered.mapInArrow(_write(folder, tokenizer or default_tokenizer(), end_id, kept),
                                     _INDEX_DDL))


def sequence(source: pa.NativeFile, firsts: list[int], offsets: list[int],
             k: int) -> tuple[pa.Array, pa.Array]:
    """Ids and mask of sequence ``k`` of an open file, from the row of the index that
    names it. Only the schema and the one batch are opened; where ``source`` is a
    memory map both arrays are slices of it and nothing is copied. The mask has one
    bit for each id."""
    at = bisect_right(firsts, k) - 1
    if at < 0:
        raise IndexError(f"no sequence {k}")
    source.seek(0)
    schema = pa.ipc.read_schema(source)
    if at:  # The first batch follows the schema, which is written with it.
        source.seek(offsets[at])
    batch = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
    if k - firsts[at] >= batch.num_rows:
        raise IndexError(f"no sequence {k}")
    cut = slice((k - firsts[at]) * SEQUENCE, (k - firsts[at] + 1) * SEQUENCE)
    return batch.column("input_ids").flatten()[cut], batch.column("mask").flatten()[cut]


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                   ("ids_crc32", pa.int64())])


def _documents(stream, before: int) -> Iterator[tuple]:
    """Documents of one file in order; holds one batch and a running checksum."""
    doc, start, n, crc, at = None, None, 0, 0, before
    for batch in pa.ipc.open_stream(stream):
        ids = batch.column("input_ids").flatten().to_numpy()
        real = batch.column("mask").flatten().true_count
        begins = [(d, i * SEQUENCE + s) for i, (ds, ss) in enumerate(zip(
            batch.column("doc_ids").to_pylist(), batch.column("doc_starts").to_pylist()))
            for d, s in zip(ds, ss)]
        cuts = [0, *(s for _, s in begins), real]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if k:
                if start is not None:
                    yield doc, start, n, crc
                doc, start, n, crc = begins[k - 1][0], at + a, 0, 0
            n += b - a
            crc = zlib.crc32(ids[a:b].astype("<u4").tobytes(), crc)
        at += real
    if start is not None:
        yield doc, start, n, crc


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name, before, n_docs in zip(*(c.to_pylist() for c in batch.columns)):
                    n = 0
                    with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                        for row in _documents(stream, before):
                            n += 1
                            yield row
                    if n != n_docs:
                        raise ValueError(f"{name} has {n} documents instead of {n_docs}")

        yield from batches_of(rows(), _READ)
    return run


def read_documents(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    A file's first place in the stream is the sum of the files before it; the
    index has one row per file of up to 67 million ids."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = settle(index.select("file", F.coalesce(F.sum("n_tokens").over(before),
                                                    F.lit(0)).cast("bigint").alias("before"), "n_docs"))
    return (placed.repartition(max(1, placed.count()), "file").mapInArrow(
        lean(_read(folder)), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def round_trip(docs: DataFrame, tokenizer: str | None = None,
               order: list[Column] | None = None, kept: int | None = None) -> DataFrame:
    """Write all documents and read the files back.

    Null text is empty and has the end id alone. Without ``order``, null ids come
    first, and rows that share an id follow each other by the hash of their texts. Long documents run
    through several sequences. An empty table gives no files and no rows. Other
    columns are not written.
    """
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_documents(write_sequences(docs, folder, tokenizer, order=order, kept=kept), folder)
