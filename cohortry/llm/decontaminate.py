"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all normalised test items is built once per block of items and
sent to the tasks; its size is bounded by ``block_words``. A document's words are
streamed through it. After each word the state tells the longest run of words
ending there that some item holds too; where it reaches a window's length, that
run is a hit. A larger benchmark is cut into blocks and every block is run over
all documents, so the tasks' memory does not grow with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import lean, ready, unmarked
from cohortry.sources.scratch import settle

WINDOW = 10
#: Share of its words that a document must keep when passages are cut out.
LEAST_LEFT = 0.2
#: Words of the items in one automaton; it has at most twice as many states.
BLOCK_WORDS = 1_000_000
#: A to Z become small letters; every other ASCII byte that is no digit and no
#: small letter becomes a blank. Bytes of other characters stay.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
               for c in range(256))
#: The same words, with their places.
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text; none for null."""
    return text.translate(_BYTES).split() if text else []


class SuffixAutomaton:
    """All substrings of the items, each item by its index in ``items``.

    An item of fewer than ``window`` words is one window of its own; it occurs
    where the whole item occurs. An item without words never occurs.
    """

    def __init__(self, items: list[list[bytes]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        held: list[set[int]] = [set()]
        self.whole: dict[int, list[int]] = {}
        for k, words in enumerate(items):
            # The state after each word holds that prefix as its longest run, and
            # keeps it when later items split the state.
            state = 0
            for w in words:
                state = self._extend(state, self.ids.setdefault(w, len(self.ids)))
                held += [set() for _ in range(len(self.step) - len(held))]
                held[state].add(k)
            if 0 < len(words) < window:
                self.whole.setdefault(state, []).append(k)
        self._close(held)

    def _clone(self, state: int, length: int) -> int:
        self.step.append(dict(self.step[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        return len(self.step) - 1

    def _redirect(self, state: int, word: int, old: int) -> int:
        """A copy of ``old`` that holds only its runs up to state's length + 1."""
        copy = self._clone(old, self.length[state] + 1)
        self.link[old] = copy
        while state >= 0 and self.step[state].get(word) == old:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.step[last].get(word)
        if known is not None:
            exact = self.length[known] == self.length[last] + 1
            return known if exact else self._redirect(last, word, known)
        self.step.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        new, state = len(self.step) - 1, last
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        if state >= 0:
            other = self.step[state][word]
            exact = self.length[other] == self.length[state] + 1
            self.link[new] = other if exact else self._redirect(state, word, other)
        return new

    def _close(self, held: list[set[int]]) -> None:
        """Sum up what is asked at each word: the state of the last ``window``
        words, the items of it, and the nearest whole short item."""
        order = sorted(range(1, len(self.step)), key=self.length.__getitem__)
        for state in reversed(order):
            if self.length[self.link[state]] >= self.window:
                held[self.link[state]] |= held[state]
        self.ending = list(range(len(self.step)))
        self.short = [-1] * len(self.step)
        for state in order:
            up = self.link[state]
            if self.length[up] >= self.window:
                self.ending[state] = self.ending[up]
            self.short[state] = state if state in self.whole else self.short[up]
        self.items = [frozenset(s) if self.length[i] >= self.window and self.ending[i] == i else None
                      for i, s in enumerate(held)]

    def spans(self, words: Iterable[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit runs of words as sorted, disjoint (first, last + 1), and the items
        whose windows occur."""
        known, step, link, length = self.ids.get, self.step, self.link, self.length
        window, short, whole = self.window, self.short, self.whole
        state = matched = 0
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        for i, w in enumerate(words):
            word = known(w)
            if word is None:
                state = matched = 0
                continue
            following = step[state].get(word)
            while following is None and state:
                state = link[state]
                matched = length[state]
                following = step[state].get(word)
            if following is None:
                continue
            state, matched = following, matched + 1
            if matched >= window:
                found.append((i + 1 - matched, i + 1))
                # The run may be shorter than the state's longest, never than its shortest.
                items |= self.items[self.ending[state]]
            if short:
                at = short[state]
                while at > 0:
                    if length[at] <= matched:
                        found.append((i + 1 - length[at], i + 1))
                        items.update(whole[at])
                    at = short[link[at]]
        return merge_spans(found), items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [tuple(s) for s in out]


def _blocks(items: list[tuple[str, list[bytes]]], most: int) -> list[list[tuple[str, list[bytes]]]]:
    out, size = [[]], 0
    for item in items:
        if out[-1] and size + len(item[1]) > most:
            out.append([])
            size = 0
        out[-1].append(item)
        size += len(item[1])
    return out


_FOUND = "n_words bigint, spans array<array<int>>, items array<string>"


def _scan(docs: DataFrame, names: list[str], automaton: SuffixAutomaton, text: Column,
          carry: list[Column]) -> DataFrame:
    """The carried columns with n_words, spans and items. The text alone goes to
    Python; the rows stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast((names, automaton))

    def scan(chunks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own_names, own = shared.value
        for texts in chunks:
            n, spans, items = [], [], []
            for body in texts:
                words = words_of(body.as_py())
                hit, which = own.spans(words)
                n.append(len(words))
                spans.append([list(s) for s in hit])
                items.append(sorted(own_names[k] for k in which))
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                 pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "items"])

    scanner = F.arrow_udf(lean(scan), _FOUND, F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    return docs.select(*carry, scanner(text).alias("_found")).select("*", "_found.*").drop("_found")


def find_spans(docs: DataFrame, items: DataFrame, carry: dict[str, Column], text: str = "text",
               item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
               block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: the carried columns, n_words, spans (hit runs of
    words) and items (ids, as sorted texts, of items with windows in the row).

    The test items are read to the driver block by block for the automata; a
    test set is small beside the documents. Items that share an id are told
    apart by nothing: their windows count for that id. Null and empty texts have
    no words; a null item id is the text 'null'. No items: no hits.
    """
    ready(docs.sparkSession)
    listed = [("null" if r[0] is None else str(r[0]), words_of(bytes(r[1]))) for r in
              items.select(item_id, F.coalesce(F.col(item_text), F.lit("")).cast("binary"))
              .orderBy(item_id).toLocalIterator()]
    carried = [c.alias(n) for n, c in carry.items()]
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    blocks = _blocks(listed, block_words)
    if len(blocks) == 1:
        return _scan(docs, *_automaton(blocks[0], window), body, carried)
    # The same row must be known again in every block's result.
    source = settle(docs.select(*carried, body.alias("_text"),
                                F.monotonically_increasing_id().alias("_row")))
    found = reduce(DataFrame.unionByName, [
        _scan(source, *_automaton(block, window), F.col("_text"), [F.col("_row")]) for block in blocks])
    joined = found.groupBy("_row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    ).withColumn("spans", _united(F.col("spans")))
    return source.drop("_text").join(joined, "_row").drop("_row")


def _automaton(block: list[tuple[str, list[bytes]]], window: int) -> tuple[list[str], SuffixAutomaton]:
    return [name for name, _ in block], SuffixAutomaton([words for _, words in block], window)


def _united(spans: Column) -> Column:
    """Runs found by several blocks, as sorted and disjoint runs."""
    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1),
                          F.array(F.array(last[0], F.greatest(last[1], span[1]))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))[1] >= span[0]),
                      longer).otherwise(F.concat(done, F.array(span)))
    none = F.array().cast("array<array<int>>")
    return F.aggregate(F.array_sort(spans), none, add)


def hit_words() -> Column:
    """Number of words in the spans."""
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated per document.

    Null and empty texts have no words and no hits. Repeated rows are judged
    each; null ids are carried. Other columns play no part."""
    found = find_spans(docs, items, {"doc_id": F.col("doc_id")}, window=window,
                       block_words=block_words)
    return found.select("doc_id", "n_words", hit_words().alias("n_hit"),
                        F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


def cut_words(text: bytes, spans: Iterable[Iterable[int]]) -> bytes:
    """The text without the spans' words and what stands inside the spans. What
    stands before and after a span stays, so no two words run together."""
    at = [m.span() for m in _WORD.finditer(text)]
    kept, done = [], 0
    for first, end in spans:
        kept.append(text[done:at[first][0]])
        done = at[end - 1][1]
    return b"".join([*kept, text[done:]])


def _shorten(rows: DataFrame, names: list[str], text: str) -> DataFrame:
    """The named columns of ``rows``, with the words of the spans in ``cut`` taken
    out of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, texts, cuts = batch.columns
            left = [cut_words(t, c) for t, c in zip(texts.to_pylist(), cuts.to_pylist())]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(left, pa.binary())],
                                             names=batch.schema.names[:-1])

    others = [n for n in names if n != text]
    schema = T.StructType([*[rows.schema[n] for n in others], T.StructField("left", T.BinaryType())])
    return (rows.select(*others, F.col(text).cast("binary").alias("left"), "cut")
            .mapInArrow(lean(run), schema).withColumn(text, F.col("left").cast("string")).select(*names))


def remove_spans(docs: DataFrame, items: DataFrame, max_hit: int = 0, max_share: float = 1.0,
                 window: int = WINDOW, least_left: float = LEAST_LEFT, size: str = "n_chars") -> DataFrame:
    """``docs`` with the passages of the items cut out of their texts.

    A span of hit words is cut when it has more than ``max_hit`` words, or when
    the spans of its text cover more than ``max_share`` of the words. A text is
    looked through again after a cut, because its ends now stand side by side,
    until nothing is left to cut. A document goes only when cuts leave it no word
    or less than ``least_left`` of its words. With the defaults no kept text has a
    window. The column ``size``, where there is one, gets the length of a text that
    was cut; all else, nulls and clean documents stay as they are.
    """
    names = [f"in_{c}" for c in docs.columns]
    exceeds = (hit_words() > F.lit(max_share) * F.col("n_words"))
    cut = F.filter("spans", lambda s: exceeds | (s[1] - s[0] > max_hit))
    n_cut = F.aggregate("cut", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    carried = {f"in_{c}": F.col(f"`{c}`") for c in docs.columns} | {
        "n_first": F.lit(None).cast("bigint")}
    rows, source, parts = docs, "text", []
    while True:
        found = settle(find_spans(rows, items, carried, source, window=window)
                       .withColumns({"cut": cut, "n_first": F.coalesce("n_first", "n_words")}))
        parts.append(found.where(F.size("cut") == 0).select(*unmarked(docs.columns)))
        n_left = F.col("n_words") - n_cut
        touched = found.where((F.size("cut") > 0) & (n_left > 0)
                              & (n_left >= F.lit(least_left) * F.col("n_first")))
        if touched.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        rows = _shorten(touched, [*names, "n_first"], "in_text")
        if size in docs.columns:
            rows = rows.withColumn(f"in_{size}", F.length("in_text").cast(docs.schema[size].dataType))
        carried, source = {n: F.col(f"`{n}`") for n in [*names, "n_first"]}, "in_text"
