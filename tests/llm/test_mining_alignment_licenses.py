"""Hard negatives, token alignment and license scans against plain versions, and on
the rows that every operator must bear."""

import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortry.llm import alignment, hard_negatives, licenses
from odd_rows import LONG, rows_of

# ------------------------------------------------------------------ hard negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def _vectors(n, dims=6, seed=5, same=0.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [0.5] * dims if rng.random() < same else [rng.uniform(-1, 1) for _ in range(dims)]
        rows.append((i, v, rng.randrange(3)))
    return rows


def _ended(x):
    """Numbers end at the borders of 64 bits."""
    return max(-(1 << 63), min((1 << 63) - 1, x))


def _plain_mining(rows, positives=5, negatives=10):
    """Every anchor against every row; rows told apart by their place in the list."""
    usable = [(i, key, label, [_ended(math.floor(256.0 * x)) for x in v])
              for i, (key, v, label) in enumerate(rows)
              if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda key: (key is None, key)
    out = []
    for i, key, label, q in usable:
        if key is None or key % 100:
            continue
        scored = [(_ended(sum(x * y for x, y in zip(q, p))), other, same)
                  for _, other, same, p in usable]
        own = sorted((-s, last(o)) for s, o, same in scored if same == label and o != key)[:positives]
        for s, (_, pos) in own:
            inside = sorted((-n, last(o)) for n, o, other in scored
                            if other != label and 30 * -s <= 100 * n <= 90 * -s)[:negatives]
            out += [(key, pos, rank, neg, -s, -n) for rank, (n, (_, neg)) in enumerate(inside, 1)]
    return sorted(map(repr, out))


def _mined(df, **more):
    return sorted(map(repr, (tuple(r) for r in hard_negatives.mine(
        df, F.col("vec_id") % 100 == 0, **more).collect())))


@pytest.mark.parametrize("same", [0.0, 0.4])
def test_mining_finds_what_a_plain_search_finds(spark, same):
    rows = _vectors(2500, same=same)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    as_float = [tuple(r) for r in df.orderBy("vec_id").collect()]
    assert _mined(df) == _plain_mining(as_float)


def test_mining_in_small_portions_gives_the_same(spark):
    df = spark.createDataFrame(_vectors(1500), VECTORS).repartition(3)
    assert _mined(df, portion=30) == _mined(df)


def test_mining_bears_odd_rows(spark):
    rows = [(r[0], [float(x) for x in r[1]], r[2]) for r in _vectors(300, dims=3)]
    rows += [(100, [0.5, 0.25, 0.125], 1), (100, [0.5, 0.25, 0.125], 1), (7, None, 1), (200, None, 1),
             (8, [0.1, None, 0.2], 1), (9, [0.1, math.nan, 0.2], 1), (400, [math.inf, 0.0, 0.0], 1),
             (500, [0.25, 0.25, 0.25], None), (None, [0.5, 0.5, 0.5], 0), (None, [0.25, 0.5, 0.5], 2),
             (600, [], 1), (700, [0.5], 1), (-100, [0.5, 0.5, 0.5], 2), (800, [3e30, -3e30, 1.0], 1)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = sorted(repr(tuple(r)) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect())
    assert got == _plain_mining([tuple(r) for r in df.collect()])
    assert max(Counter(r for r in got if r.startswith("(100, ")).values()) == 2
    assert any(", None, " in r for r in got)


def test_mining_of_nothing_and_with_other_columns(spark):
    df = spark.createDataFrame(_vectors(300), VECTORS)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(df.where("vec_id % 100 != 0"), F.col("vec_id") % 100 == 0).count() == 0
    more = df.select("*", *[F.lit(1).alias(c) for c in ("id", "q", "place", "key", "portion", "score")])
    assert _mined(more) == _mined(df)


def test_packed_keys_have_the_wanted_order():
    rng = random.Random(1)
    numbers = [0, 1, -1, (1 << 63) - 1, -(1 << 63), 12345]
    rows = [(rng.choice(numbers), rng.randrange(3), rng.choice(numbers), rng.randrange(2), rng.choice(numbers))
            for _ in range(400)]
    keys = hard_negatives.pack(*zip(*rows)).column(0)
    assert list(zip(*(c.tolist() for c in hard_negatives.unpack(keys)))) == rows
    by_key = [r for _, r in sorted(zip(keys.to_pylist(), rows), key=lambda p: p[0])]
    assert by_key == sorted(rows, key=lambda r: (r[0], r[1], -r[2], r[3], r[4]))


def test_windows_stream_through_without_holding_the_anchor():
    """The iterator takes one entry at a time and keeps open windows only."""
    def entries():
        yield 1, 0, 100, 0, 10
        for i in range(100_000):
            yield 1, 0, 80, 1, i
    assert [r[3] for r in hard_negatives.open_windows(entries())] == list(range(10))


def test_products_are_exact_at_every_size():
    import numpy as np
    for size in (10, 2 ** 30, 2 ** 40):
        a, b = (np.random.default_rng(s).integers(-size, size, (4, 5)) for s in (1, 2))
        exact = a.astype(object) @ b.astype(object).T
        assert (hard_negatives.products(a, b) == np.clip(exact, -(1 << 63), (1 << 63) - 1)).all()


# ------------------------------------------------------------------------ alignment

def _whole_encoders():
    """Both libraries on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer
    a_file, b_file = alignment.default_files()
    a, b = Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file)
    a.encode_special_tokens = True
    return lambda t: a.encode(t, add_special_tokens=False).ids, b.encode


def test_pieces_encode_as_whole_texts_do():
    rng = random.Random(4)
    letters = "abXYZ    \n\t\r'sdlm.,!?-12àßÿŁ²½ªº\xa0\x85\x1c«»—日\u2581\u0301\U0001F600"
    words = ["don't", "we're", "x", "  ", "1,000", "naïve", "\n\n", "<s>", "</s>", "<unk>", "<0x41>", "I'LL"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(1, 40))) for _ in range(4000)]
    texts += [" ".join(rng.choices(words, k=rng.randrange(1, 12))) for _ in range(4000)]
    texts += ["word " * 300_000 + "end", "a" * 5000]
    whole_a, whole_b = _whole_encoders()
    a_file, b_file = alignment.default_files()
    full = [" " + t for t in texts]
    assert alignment.byte_side(a_file)[0](full).to_pylist() == [whole_a(t) for t in full]
    assert alignment.piece_side(b_file)[0](full).to_pylist() == [whole_b(t) for t in texts]


def _plain_alignment(texts):
    encode_a, encode_b = _whole_encoders()
    words_a, words_b = (side(path)[1].to_pylist() for side, path in zip(
        (alignment.byte_side, alignment.piece_side), alignment.default_files()))
    docs = []
    for text in texts:
        full = " " + (text or "")
        a, b = (encode_a(full), encode_b(text)) if text else ([], [])
        ok = bool(text) and all(b"".join(w[i] for i in ids) == full.encode()
                                for ids, w in ((a, words_a), (b, words_b)))
        if not ok:
            docs.append(([], [], [], []))
            continue
        spans = []
        for ids, w in ((a, words_a), (b, words_b)):
            at, side = 0, []
            for i in ids:
                side.append((at, at + len(w[i]), i))
                at += len(w[i])
            spans.append(side)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]] \
            if len(a) < 400 else None
        if links is None:
            links, j = [], 0
            for x in spans[0]:
                while spans[1][j][1] <= x[0]:
                    j += 1
                k = j
                while k < len(spans[1]) and spans[1][k][0] < x[1]:
                    links.append((x[2], spans[1][k][2]))
                    k += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, begin = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if begin < e <= cut)
                                   for side in spans) if len(cuts) < 400 else None)
            begin = cut
        docs.append((a, b, groups, links))
    counts = Counter(p for d in docs for p in set(d[3]))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for a, b, groups, links in docs:
        text = "" if not a else None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links),
                    sum(counts[p] for p in links), text))
    return out


TEXTS = ["one two three", "", None, "Hello, wörld! naïve café", "a  b", "tab\there", "line\nbreak",
         "<|endoftext|> and <s> here", "▁ mark", "\U0001F600 smile", "one two three", "x", " ", "NUL\x00",
         "１２ full width", "é combined", "日本語のテキスト", "supercalifragilisticexpialidocious"]


def _aligned(df, **more):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return [(r.doc_id, tuple(r[n] for n in names)) for r in alignment.align(df, **more).collect()]


@pytest.mark.parametrize("chunk_bytes", [1, 40, 1 << 20])
def test_alignment_equals_a_plain_one_for_any_chunks(spark, chunk_bytes):
    rng = random.Random(3)
    words = "the model of a Straße naïve token tokenizer un-believable 12,345 façade and".split()
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(_aligned(df, chunk_bytes=chunk_bytes)) == list(enumerate(_plain_alignment(texts)))


def test_alignment_bears_odd_rows(spark, odd, clashing, nothing):
    got = _aligned(odd)
    assert len(got) == odd.count() and sum(k is None for k, _ in got) == 1
    assert [v for k, v in got if k in (0, 1)] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert len({v for k, v in got if k == 4}) == 1
    assert rows_of(alignment.align(odd)) == rows_of(alignment.align(clashing))
    assert alignment.align(nothing).count() == 0
    texts = [r.text for r in odd.orderBy("doc_id").collect()]
    plain = _plain_alignment(texts)
    mine = Counter(v[:6] for _, v in got)
    assert mine == Counter(v[:6] for v in plain)
    (long_one,) = [v for k, v in got if k == 5]
    assert long_one[0] > 60_000 and len(LONG) > 300_000


def test_joined_tokens_share_the_tokens_bytes():
    _, words = alignment.byte_side(alignment.default_files()[0])
    side = alignment.Side.of(pa.array([[32], [], [33, 34]], pa.list_(pa.int32())), words)
    table = words.to_pylist()
    assert side.joined().to_pylist() == [table[32], b"", table[33] + table[34]]
    assert side.joined().buffers()[2].address == side.bytes.buffers()[2].address


# ------------------------------------------------------------------------- licenses

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _ascii_small(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _plain_scan(text):
    w = _WORDS.findall(_ascii_small(text or ""))
    places, base, labels, score = [], set(), set(), 0.0
    for label, phrase in licenses.BASE:
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += found
        if found:
            base.add(label)
            score = 1.0
    for label, template in licenses.TEMPLATES:
        t = _WORDS.findall(_ascii_small(template))
        known = {}
        for j in range(len(t) - 2):
            known.setdefault(tuple(t[j:j + 3]), []).append(j)
        lines = {}
        for i in range(len(w) - 2):
            for j in known.get(tuple(w[i:i + 3]), ()):
                lines.setdefault(i - j, set()).add(j)
        run, last = set(), None
        covers = []
        for d in sorted(lines):
            if last is not None and d - last > licenses.SHIFT:
                covers.append(len(run))
                run = set()
            run |= {j + s for j in lines[d] for s in range(3)}
            last = d
        covers.append(len(run))
        best = max(covers) / len(t)
        if best >= licenses.LEAST_COVER:
            labels.add(label)
            score = max(score, best)
    return (len(w), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | labels)), score)


def _scanned(df):
    return [(r[0], tuple(r)[1:]) for r in licenses.license_scan(df).collect()]


def test_scan_equals_a_plain_one(spark):
    rng = random.Random(9)
    clean = "some words of the story about this file and a version that is free to use in all".split()
    texts = ["Under the MIT license. UNDER THE MIT-LICENSE", "CC BY-NC and apache license, version 2.0",
             "under the mit licence", "cc by nc nd", "cc by\nnc cc by nc", "by nc", "Kİ cc by nc"]
    for label, template in [*licenses.BASE, *licenses.TEMPLATES]:
        words = template.split()
        for _ in range(4):
            quoted = list(words)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(quoted))
                rng.choice((lambda: quoted.insert(at, "really"), lambda: quoted.pop(at),
                            lambda: quoted.__setitem__(at, "other")))()
                quoted = quoted or ["x"]
            texts.append(" ".join([*rng.choices(clean, k=rng.randrange(0, 40)), *quoted,
                                   *rng.choices(clean, k=rng.randrange(0, 40))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(_scanned(df)) == [(i, _plain_scan(t)) for i, t in enumerate(texts)]
    found = {label for _, v in _scanned(df) for label in v[5].split(",")}
    assert {label for label, _ in licenses.TEMPLATES} <= found


def test_scan_bears_odd_rows(spark, odd, clashing, nothing):
    more = spark.createDataFrame(
        [(20, "under the mit license", None, None, 1)] * 3
        + [(None, "under the mit license " * 20_000, None, None, 1), (None, None, None, None, 1)], odd.schema)
    both = odd.unionByName(more)
    got = _scanned(both)
    assert len(got) == both.count()
    assert Counter(got) == Counter((r.doc_id, _plain_scan(r.text)) for r in both.collect())
    assert rows_of(licenses.license_scan(odd)) == rows_of(licenses.license_scan(clashing))
    assert licenses.license_scan(nothing).count() == 0


def test_scan_uses_no_python_workers(spark, odd):
    plan = licenses.license_scan(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
