"""Exact dedup, substring dedup, decontamination and WARC against brute force."""

import gzip
import hashlib
import io
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortry.llm import decontaminate as dc
from cohortry.llm import run_merge, substring, warc
from odd_rows import ODD, SHAPE, rows_of


def exact_by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    out = {}
    for text, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for r in members:
            out[r[0]] = (best[0], len(members), hashlib.sha256(text.encode()).hexdigest())
    return out


def test_exact_dedup_of_odd_rows(spark, odd, clashing, nothing):
    got = run_merge.exact_dedup(odd).collect()
    assert len(got) == len(ODD)
    want = exact_by_hand(ODD)
    assert all((r.keep_id, r.group_size, r.text_sha256) == want[r.doc_id] for r in got)
    kept = [r.doc_id for r in got if r.kept]
    assert len(kept) == len({w[2] for w in want.values()}) and kept.count(4) == 1
    assert rows_of(run_merge.exact_dedup(clashing)) == sorted(map(repr, got))
    assert run_merge.exact_dedup(nothing).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_exact_dedup_with_hot_groups(spark, parts):
    rng = random.Random(parts)
    rows = [(i, "hot" if rng.random() < 0.4 else f"text {rng.randrange(900)}" + " " * rng.randrange(3),
             "en", "a", 0) for i in range(4000)]
    df = spark.createDataFrame(rows, SHAPE).repartition(parts)
    want = exact_by_hand(rows)
    got = run_merge.exact_dedup(df).collect()
    assert len(got) == 4000
    assert all((r.keep_id, r.group_size, r.text_sha256) == want[r.doc_id] for r in got)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_merge_tree_with_any_fan(spark, odd, fan):
    df = odd.repartition(11)
    assert rows_of(run_merge.exact_dedup(df, fan=fan)) == rows_of(run_merge.exact_dedup(df, fan=5))


def test_merge_tree_covers_all_runs():
    for n in (1, 2, 7, 8, 9, 64, 1000, 5000, 100_000):
        for fan in (2, 3, 50):
            count = run_merge.rounds(n, fan)
            assert fan ** count >= n and (count == 1 or fan ** (count - 1) < n)


def test_equal_texts_are_one_entry_of_each_run(spark):
    df = spark.range(0, 20_000, 1, 16).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    blocks = run_merge.leaf_runs(run_merge.digests(df)).collect()
    entries = [pa.ipc.read_record_batch(pa.py_buffer(b.body), run_merge._ENTRY) for b in blocks]
    assert [e.num_rows for e in entries] == [1] * 16
    assert sum(e.column("copies")[0].as_py() for e in entries) == 20_000


def test_blocks_merge_in_order_with_one_open_block_a_run(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(run_merge, "BLOCK", 10)
    runs, blocks = [], []
    for run in range(3):
        rows = sorted({bytes([rng.randrange(256)]) * 32 for _ in range(200)})
        batch = pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.binary())] + [pa.array([1] * len(rows), pa.int64())] * 6,
            schema=run_merge._ENTRY)
        pieces = [batch.slice(i, 5) for i in range(0, len(rows), 5)]
        blocks += [b[1:] for b in run_merge._packed(pieces, run, 1)]
        runs += rows
    assert len(blocks) > 30
    merged = list(run_merge.merge_blocks(sorted(blocks)))
    got = [d for b in merged for d in b.column("digest").to_pylist()]
    assert got == sorted(runs) and max(b.num_rows for b in merged) <= 3 * 10
    folded = [d for b in run_merge._fold(iter(merged)) for d in b.column("digest").to_pylist()]
    assert folded == sorted(set(runs))


def substring_by_hand(rows, window):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    least = {}
    order = lambda d: (d is None, d or 0)
    for d, text, *_ in rows:
        w = split(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            least[key] = min(least.get(key, order(d)), order(d))
    out = []
    for d, text, *_ in rows:
        w = split(text)
        gone = {j for i in range(len(w) - window + 1)
                if least[tuple(w[i:i + window])] < order(d) for j in range(i, i + window)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(map(repr, out))


def texts_with_repeats(seed, n=300):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(3000)}"
    shared = [[word() for _ in range(30)] for _ in range(4)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = shared[rng.randrange(4)][rng.randrange(5):]
        rows.append((rng.randrange(n), " ".join(words), "en", "a", 0))
    return rows + [(n + i, rows[0][1], "en", "a", 0) for i in range(200)]


@pytest.mark.parametrize("chunk", [500, 1_000_000])
def test_substring_dedup(spark, monkeypatch, chunk):
    monkeypatch.setattr(substring, "CHUNK_WINDOWS", chunk)
    rows = texts_with_repeats(chunk % 7)
    got = substring.substring_dedup(spark.createDataFrame(rows, SHAPE).repartition(5), 20)
    found = sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_text)) for r in got.collect())
    assert found == substring_by_hand(rows, 20)


def test_substring_dedup_of_odd_rows(spark, odd, clashing, nothing):
    got = substring.substring_dedup(odd, 3)
    found = sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_text)) for r in got.collect())
    assert found == substring_by_hand(ODD, 3)
    assert rows_of(substring.substring_dedup(clashing, 3)) == rows_of(got)
    assert substring.substring_dedup(nothing).count() == 0


def test_removal_intervals_are_maximal():
    at = lambda *parts: substring.removal_intervals([np.array(p) for p in parts], 5)
    assert at([9, 1], [3, 40]) == [[1, 8], [9, 14], [40, 45]]
    assert at([1], [6]) == [[1, 11]]
    assert substring.removal_intervals(None, 5) == []


def test_places_survive_packing():
    rng = np.random.default_rng(0)
    docs, rows, places = rng.integers(-5, 5, 200), rng.integers(0, 2, 200) << 31, rng.integers(0, 9999, 200)
    d, r, first, p = substring.unpack_places(substring.pack_places(docs, rows, places))
    n = np.diff(np.append(first, len(p)))
    assert sorted(zip(np.repeat(d, n), np.repeat(r, n), p)) == sorted(zip(docs, rows, places))


def contamination_by_hand(rows, items, window):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                          re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for k, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[i:i + m])].add(str(k))
    sizes = {len(k) for k in windows}
    out = []
    for d, text, *_ in rows:
        w, gone, which = words(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if hit := windows.get(tuple(w[i:i + m])):
                    gone |= set(range(i, i + m))
                    which |= hit
        out.append((d, len(w), len(gone), len(which),
                    hashlib.sha256(",".join(sorted(which)).encode()).hexdigest(), bool(gone)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("block", [20, dc.BLOCK_WORDS])
@pytest.mark.parametrize("window", [2, 4])
def test_contamination(spark, block, window):
    rng = random.Random(window)
    say = lambda n: " ".join(rng.choice("A b C d E".split()) for _ in range(n))
    items = [(i, say(rng.randrange(9))) for i in range(12)] + [(20, None), (21, "b, b!"), (22, "")]
    rows = [(i, say(rng.randrange(30)), "en", "a", 0) for i in range(60)] + ODD
    found = dc.contamination(spark.createDataFrame(rows, SHAPE),
                             spark.createDataFrame(items, "item_id long, text string"), window, block)
    assert sorted(repr(tuple(r)) for r in found.collect()) == contamination_by_hand(rows, items, window)


def test_decontamination_keeps_clean_rows(spark, odd, clashing, nothing):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    left = dc.remove_spans(odd, items)
    assert left.columns == odd.columns and left.count() == len(ODD) - 4
    assert dc.remove_spans(clashing, items).count() == len(ODD) - 4
    assert dc.remove_spans(odd, items, max_hit=3).count() == len(ODD)
    assert dc.contamination(nothing, items).count() == 0
    assert dc.contamination(odd, items.limit(0)).where("contaminated").count() == 0


def removal_by_hand(text, items, window, max_hit, max_share, least_left):
    """The text without its spans, or None where the document goes; cuts are made
    word by word on a list of (word, what stands before it)."""
    pieces = re.split(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)", text)
    gaps, own = pieces[::2], pieces[1::2]
    small = lambda ws: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in ws]
    wanted = set()
    for item in items:
        w = small(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", item or ""))
        m = min(window, len(w))
        wanted |= {tuple(w[i:i + m]) for i in range(len(w) - m + 1 if m else 0)}
    first = len(own)
    while True:
        w, runs = small(own), []
        hit = sorted({(i, i + m) for m in {len(k) for k in wanted}
                      for i in range(len(w) - m + 1) if tuple(w[i:i + m]) in wanted})
        for a, b in hit:
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
        total = sum(b - a for a, b in runs)
        cut = [(a, b) for a, b in runs if b - a > max_hit or total > max_share * len(w)]
        if not cut:
            return "".join(g + x for g, x in zip(gaps, [*own, ""]))
        for a, b in reversed(cut):
            own[a:b], gaps[a:b + 1] = [], [gaps[a] + gaps[b]]
        if not own or len(own) < least_left * first:
            return None


@pytest.mark.parametrize("max_hit,max_share,least_left", [(0, 1.0, 0.2), (3, 0.4, 0.5), (5, 1.0, 0.0)])
def test_span_removal_equals_brute_force(spark, max_hit, max_share, least_left):
    rng = random.Random(max_hit)
    say = lambda n: " ".join(rng.choice("A b C, d É; f-".split()) for _ in range(n))
    items = [say(rng.randrange(1, 9)) for _ in range(14)] + [None, "", "q"]
    rows = [(i, say(rng.randrange(60)), "en", "a", 0) for i in range(80)] + [(80, "q", "en", "a", 0)]
    rows = [(d, t, x, y, len(t)) for d, t, x, y, _ in rows]
    got = dc.remove_spans(spark.createDataFrame(rows, SHAPE), spark.createDataFrame(
        list(enumerate(items)), "item_id long, text string"), max_hit, max_share, 4, least_left)
    kept = [(r, removal_by_hand(r[1], items, 4, max_hit, max_share, least_left)) for r in rows]
    want = [(r[0], t, r[2], r[3], len(t)) for r, t in kept if t is not None]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(t is None for _, t in kept) or not least_left
    assert any(t is not None and t != r[1] for r, t in kept)


def test_span_removal_keeps_the_rest_of_a_long_text(spark):
    quote = " ".join(f"q{i}" for i in range(10))
    clean = " ".join(f"w{i}" for i in range(20_000))
    # The cut brings the halves of a second quotation together.
    halves = quote.split()[:5], quote.split()[5:]
    nested = " ".join([*halves[0], quote, *halves[1]])
    rows = [(1, f"{clean} {quote}. {clean}", None, None, 1), (2, f"{clean} {nested} end", None, None, 1),
            (3, quote, None, None, 1), (4, f"{quote} one", None, None, 1), (5, None, None, None, None)]
    items = spark.createDataFrame([(1, quote)], "item_id long, text string")
    got = {r.doc_id: r for r in dc.remove_spans(spark.createDataFrame(rows, SHAPE), items).collect()}
    assert sorted(got) == [1, 2, 5] and got[5].text is None and got[5].n_chars is None
    assert got[1].text == f"{clean} . {clean}" and got[1].n_chars == len(got[1].text)
    assert got[2].text.split() == [*clean.split(), "end"]
    assert dc.contamination(spark.createDataFrame(list(got.values()), SHAPE), items).where(
        "contaminated").count() == 0


PAGES = [(1, "http://a", "x" * 200), (2, "http://b", "x" * 200), (3, None, None), (4, "u\r\nv", ""),
         (5, "c", "short"), (6, "d", "short"), (7, "e", "ü" * 300_000), (0, "f", "x" * 200),
         (0, "f", "x" * 200), (None, "g", "x" * 200)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    got = warc.round_trip(df).collect()
    assert len(got) == len(PAGES)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    for r in got:
        html = {p: h for p, _, h in PAGES}[r.page_id] or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), digest(html))
    kinds = defaultdict(list)
    for r in got:
        kinds[r.page_id].append((r.record_type, r.refers_to))
    assert sorted(kinds[0], key=str) == [("response", None), ("revisit", 0)]
    assert kinds[1] == kinds[2] == kinds[None] == [("revisit", 0)]
    assert all(kinds[k] == [("response", None)] for k in (3, 4, 5, 6, 7))
    clash = df.select("*", F.lit(1).alias("row"), F.lit("x").alias("digest"), F.lit(2).alias("copies"))
    assert rows_of(warc.round_trip(clash)) == sorted(map(repr, got))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_reader_refuses_damage():
    payload = bytes(range(256)) * 2000
    good = warc.record("response", "page:1", "u", payload, hashlib.sha256(payload).hexdigest(),
                       len(payload))
    two = list(warc.read_records(io.BytesIO(good + good), keep_payload=True))
    assert [r.payload for r in two] == [payload, payload]
    assert gzip.decompress(good).startswith(b"WARC/1.1\r\n")
    with pytest.raises(warc.WarcError, match="ends inside"):
        list(warc.read_records(io.BytesIO(good[:-9])))
    with pytest.raises(warc.WarcError, match="digest"):
        list(warc.read_records(io.BytesIO(warc.record("response", "p", "u", b"abc", "0" * 64, 3))))
    for n, why in ((1, "other bytes"), (9, "shorter or longer")):
        cut = gzip.compress(gzip.decompress(warc.record("response", "p", "u", b"abc", "0" * 64, 3))
                            .replace(b"Content-Length: 3", b"Content-Length: %d" % n))
        with pytest.raises(warc.WarcError, match=why):
            list(warc.read_records(io.BytesIO(cut)))
    assert list(warc.read_records(io.BytesIO(b""))) == []
    plain = gzip.decompress(good)
    for lines in (plain.replace(b"Content-Length", b"Some-Length"),
                  plain.replace(b"Content-Length: ", b"Content-Length: x")):
        with pytest.raises(warc.WarcError, match="content length"):
            list(warc.read_records(io.BytesIO(gzip.compress(lines))))
    broken = bytearray(good)
    broken[len(good) // 2:] = b"\xff" * (len(good) - len(good) // 2)
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(bytes(broken))))


def test_warc_records_have_a_date_and_framed_lengths():
    text = gzip.decompress(warc.record("response", "page:1", "u", b"abc", "0" * 64, 9,
                                       date="2024-05-06T07:08:09Z"))
    assert b"\r\nWARC-Date: 2024-05-06T07:08:09Z\r\n" in text
    packed = warc.record("response", "p", "u", b"abc", hashlib.sha256(b"abc").hexdigest(), 9)
    assert [r.n_bytes for r in warc.read_records(io.BytesIO(packed))] == [3]
