"""Near duplicates, language, quality, mixing, shards and token files."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortry.llm import hilbert, hyperdim, poisson_mix, prob_minhash as pm, quality, token_files as tf
from cohortry.llm.common import WordHash, join_groups
from odd_rows import LONG, ODD, SHAPE, rows_of

SF = "/root/testdata/sf0.01"


# ------------------------------------------------------------- near duplicates

def plain_jaccard(a, b):
    """The definition, term by term."""
    keys = set(a) | set(b)
    out = 0.0
    for d in set(a) & set(b):
        out += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in keys)
    return out


def weighted(text):
    h, n = pm.weighted_shingles(text, WordHash())
    return h, pm.weights_of(n)


def similarity(a, b):
    return plain_jaccard(*(dict(zip(h.tolist(), w.tolist())) for h, w in map(weighted, (a, b))))


def test_probability_jaccard_and_its_estimate():
    rng = random.Random(5)
    for n in (1, 3, 40, 400):
        words = [f"u{rng.randrange(50 + n)}" for _ in range(n)]
        other = [w if rng.random() > 0.05 else "x" + w for w in words] + words[:n // 4]
        a, b = weighted(" ".join(words)), weighted(" ".join(other))
        exact = pm.probability_jaccard(*a, *b)
        assert exact == pytest.approx(plain_jaccard(*(dict(zip(h.tolist(), w.tolist())) for h, w in (a, b))))
        share = (pm.signature(*a, 2000) == pm.signature(*b, 2000)).mean()
        assert abs(share - exact) < 5 * math.sqrt(0.25 / 2000)


def test_early_termination_changes_no_slot():
    """Against all arrivals of the same processes up to a far later time."""
    h, w = weighted(" ".join(f"u{i % 37}" for i in range(90)))
    slots, best = 16, {}
    for x, rate in zip(h, w):
        t, k = 0.0, 0
        while t < 60:
            k += 1
            with np.errstate(over="ignore"):
                step = pm.scramble(np.array([k * pm._STEP & (2 ** 64 - 1)], np.uint64))
                r = int(pm.scramble(np.array([x], np.uint64) ^ step)[0])
            t += -math.log(((r >> 24) + 1) * 2.0 ** -40) / rate
            slot = (r & 0xFFFFFF) * slots >> 24
            if t < best.get(slot, (math.inf,))[0]:
                best[slot] = (t, int(x))
    assert pm.signature(h, w, slots).tolist() == [best[s][1] for s in range(slots)]


def near_rows(seed, n=120):
    rng = random.Random(seed)
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.5:
            words = rng.choice(texts).split()
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"z{rng.randrange(10 ** 6)}"
        else:
            words = [f"u{rng.randrange(10 ** 5)}" for _ in range(rng.randrange(60, 160))]
        texts.append(" ".join(words))
        rows.append((i, texts[-1], "en", "a", 0))
    return rows + [(n + i, texts[i % 3], "en", "a", 0) for i in range(40)]


def classes_by_hand(rows):
    label = {r[0]: r[0] for r in rows}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(rows, 2):
        if similarity(a[1], b[1]) >= pm.THRESHOLD:
            low, high = sorted((top(a[0]), top(b[0])))
            label[high] = low
    return {x: top(x) for x in label}


def test_near_duplicates_equal_all_pairs(spark, monkeypatch):
    rows = near_rows(1)
    want = classes_by_hand(rows)
    df = spark.createDataFrame(rows, SHAPE).repartition(4)
    got = pm.near_duplicates(df).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)
    monkeypatch.setattr(pm, "BLOCK", 3)
    assert {r.doc_id: r.class_id for r in pm.near_duplicates(df).collect()} == want
    kept = pm.keep_one_of_each(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(sizes)


def test_links_between_labels(spark, monkeypatch):
    """Nodes that only other members of a bucket are similar to; every block size
    gives the same classes as all pairs."""
    rng = random.Random(8)
    base = [f"u{i}" for i in range(70)] + ["again and once more and again"] * 4
    texts = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10 ** 6)}"
        texts.append(" ".join(words))
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    texts_df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "node long, text string")
    members = spark.createDataFrame([(7, n, 40) for n in range(40)], "bucket long, node long, n long")
    labels = spark.createDataFrame([(0, 0), (1, 0)], "node long, label long")
    known = WordHash()
    sigs = spark.createDataFrame(
        [(i, (pm.signature(h, pm.weights_of(c), 125) >> np.uint64(32)).astype("<u4").tobytes())
         for i, (h, c) in enumerate(pm.weighted_shingles(t, known) for t in texts)],
        "node long, sig binary")
    want = classes_by_hand(rows)
    assert 2 < len(set(want.values())) < 40
    for block in (5, 1000):
        monkeypatch.setattr(pm, "BLOCK", block)
        links = [tuple(r) for r in pm._links_between_labels(members, labels, sigs, texts_df, 0.8).collect()]
        assert all(similarity(texts[a], texts[b]) >= 0.8 for a, b in links)
        got = {r.node: r.label for r in pm.components(
            spark.createDataFrame([*links, (0, 1)], "a long, b long")).collect()}
        together = want[0] == want[1]
        assert not together or {i: got.get(i, i) for i in range(40)} == want


def test_overlap_and_its_bounds():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(30):
        h = np.unique(rng.integers(0, 40, 25)).astype(np.uint64)
        sets.append((h, rng.integers(1, 5, len(h))))
    both = pm._overlaps(sets[:10], sets[10:])
    for i, (ha, ca) in enumerate(sets[:10]):
        for j, (hb, cb) in enumerate(sets[10:]):
            a, b = dict(zip(ha, pm.weights_of(ca))), dict(zip(hb, pm.weights_of(cb)))
            smaller = sum(min(a[x], b[x]) for x in set(a) & set(b))
            assert both[i, j] == pytest.approx(smaller, rel=1e-5)
            exact = pm.probability_jaccard(ha, pm.weights_of(ca), hb, pm.weights_of(cb))
            total = sum(a.values()), sum(b.values())
            assert smaller / (sum(total) - smaller) - 1e-9 <= exact <= smaller / min(total) + 1e-9


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 299)]
    got = {r.node: r.label for r in pm.components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(got) == 51 + 60 + 2
    assert {got[i] for i in range(51)} == {0} and {got[100 + i] for i in range(60)} == {100}
    assert got[300] == got[299] == 299
    assert pm.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_odd_rows(spark, odd, clashing, nothing):
    got = pm.near_duplicates(odd)
    classes = {}
    for r in got.collect():
        classes.setdefault((r.doc_id, r.class_id), []).append(r.kept)
    assert got.count() == len(ODD)
    # Words alike: 3, 4, 4 and the null id; 5 and 6; 8, 9 and 10. No words: alone.
    assert {k: sorted(v) for k, v in classes.items()} == {
        (0, 0): [True], (1, 1): [True], (2, 2): [True], (3, 3): [True], (4, 3): [False, False],
        (None, 3): [False], (5, 5): [True], (6, 5): [False], (7, 7): [True], (8, 8): [True],
        (9, 8): [False], (10, 8): [False], (11, 11): [True]}
    assert rows_of(pm.near_duplicates(clashing)) == rows_of(got)
    assert pm.near_duplicates(nothing).count() == 0
    kept = pm.keep_one_of_each(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 5, 7, 8, 11]


def test_join_groups_without_broadcast_of_all(spark, monkeypatch):
    from cohortry.llm import common
    monkeypatch.setattr(common, "HOT_PARTS", 10)
    rows = spark.createDataFrame([(i, i % 40 if i > 500 else 0) for i in range(1000)], "i long, k long")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k < 30")
    got = join_groups(rows, groups, "k", "n", 1000).collect()
    sizes = Counter(i % 40 if i > 500 else 0 for i in range(1000))
    assert len(got) == 1000 and all(r.n == (sizes[r.k] if r.k < 30 else None) for r in got)


# --------------------------------------------------------------------- language

def test_gram_vectors_bind_and_rotate():
    a, b, c = (hyperdim.letter_vector(ord(x), 64) for x in "abc")
    assert (hyperdim.gram_vector(tuple(map(ord, "abc")), 64) == np.roll(a, 2) * np.roll(b, 1) * c).all()
    packed, counts = hyperdim.grams("Ab--ab!")
    assert counts.sum() == len(" ab ab ") - 2 and len(packed) == 3
    assert all(len(hyperdim.grams(t)[0]) == 0 for t in (None, "", " 12 !"))
    v = hyperdim.Vectors(64, kept=3)
    want = sum(n * hyperdim.gram_vector(tuple((g >> 21 * k) & 0x1FFFFF for k in (2, 1, 0)), 64)
               for g, n in zip(packed.tolist(), counts.tolist()))
    assert v.bundle(packed, counts).tolist() == want.tolist()


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = hyperdim.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.count_if(F.col("lang_pred") == F.col("lang")), F.count(F.lit(1))).first()
    assert n > 200 and right / n > 0.97


def test_language_of_odd_rows(spark, odd, clashing, nothing):
    got = hyperdim.identify(odd).collect()
    assert len(got) == len(ODD)
    assert all((r.lang_pred == "und") == (r.doc_id in (0, 1, 2, 11)) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
               for r in got)
    assert rows_of(hyperdim.identify(clashing)) == sorted(map(repr, got))
    kept = hyperdim.keep_identified(clashing)
    assert kept.columns == clashing.columns and kept.count() == len(ODD) - 4
    assert hyperdim.identify(nothing).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in hyperdim.identify(unlabelled).collect()} == {"und"}


# ---------------------------------------------------------------------- quality

def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("held_out")
    right, n = got.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count(F.lit(1))).first()
    assert n > 900 and right / n > 0.97
    # Calibrated: the mean score is the share of good rows.
    mean, share = got.agg(F.avg("score"), F.avg("quality")).first()
    assert abs(mean - share) < 0.03


def test_quality_of_odd_rows(spark, odd, clashing, nothing):
    labels = spark.createDataFrame([(3, 1), (5, 1), (8, 0), (11, 0), (None, 1), (7, None), (3, 1)],
                                   "doc_id long, quality int")
    model = quality.fit(odd, labels)
    got = quality.score(odd, model)
    assert got.count() == len(ODD) and got.where("score BETWEEN 0 AND 1").count() == len(ODD)
    assert got.where("predicted = CAST(score >= 0.7 AS INT)").count() == len(ODD)
    assert rows_of(quality.score(clashing, model)) == rows_of(got)
    assert quality.score(nothing, model).count() == 0
    untaught = quality.fit(odd, labels.limit(0))
    assert {r.score for r in quality.score(odd, untaught).collect()} == {0.5}


def test_temperature_and_network():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, quality.DIMS))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(3000) < p).astype(float)
    layers = quality.train_network(x[:2000], y[:2000], np.ones(2000), epochs=20)
    margins = quality._margin(x[2000:], layers)
    assert ((margins > 0) == (y[2000:] > 0)).mean() > 0.7
    t = quality.fit_temperature(2 * np.log(p / (1 - p)), y, np.ones(3000))
    assert 1.7 < t < 2.3


# ----------------------------------------------------------------------- mixing

@pytest.mark.parametrize("rate", [0.01, 0.7, 3.0, 40.0, 5000.0])
def test_poisson_inverse(rate):
    units = (np.arange(20_000) + 0.5) / 20_000
    got = poisson_mix.inverse_poisson(units, np.full(len(units), rate))
    assert (np.diff(got) >= 0).all()
    assert got.mean() == pytest.approx(rate, rel=0.01) and got.var() == pytest.approx(rate, rel=0.02)
    if rate < 50:
        below, k = math.exp(-rate), 0
        term = below
        while below <= units[777]:
            k += 1
            term *= rate / k
            below += term
        assert got[777] == k


def test_mixing_to_weights(spark):
    rows = [(i, "t", "en", "big" if i % 10 else "small", 1) for i in range(20_000)]
    docs = spark.createDataFrame(rows, SHAPE)
    mixed = poisson_mix.mix(docs, {"big": 1.0, "small": 1.0})
    counts = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert mixed.columns == docs.columns
    assert all(abs(n - 10_000) < 500 for n in counts.values())
    order = [r.doc_id for r in mixed.collect()]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.05
    assert sorted(order) == sorted(r.doc_id for r in poisson_mix.mix(
        docs.repartition(7), {"big": 1.0, "small": 1.0}).collect())
    only = poisson_mix.mix(docs, {"small": 1.0})
    assert {r.source for r in only.select("source").distinct().collect()} == {"small"}


def test_many_copies_of_one_row(spark):
    docs = spark.createDataFrame([(1, "t", "en", "rare", 1), (2, "t", "en", None, 1)], SHAPE)
    rates = spark.createDataFrame([("rare", 1, 4321.0), (None, 1, 0.0)],
                                  "mix_source string, n long, rate double")
    got = poisson_mix.replicate(docs, rates).collect()
    assert [r.in_doc_id for r in got] == [1] * got[0].n_copies and abs(len(got) - 4321) < 400
    assert sorted(r.copy for r in got) == list(range(len(got)))


def test_mixing_odd_rows(spark, odd, clashing, nothing):
    rates = poisson_mix.target_rates(odd)
    assert rates.agg(F.sum("n")).first()[0] == len(ODD)
    got = poisson_mix.replicate(odd, rates).collect()
    assert all(r.copy < r.n_copies for r in got)
    mixed = poisson_mix.mix(clashing)
    assert mixed.columns == clashing.columns and mixed.count() == len(got)
    assert poisson_mix.mix(nothing).count() == 0


# ----------------------------------------------------------------------- shards

@pytest.mark.parametrize("dims,bits", [(1, 3), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(spark, dims, bits):
    side = range(1 << bits)
    points = spark.createDataFrame(list(itertools.product(side, repeat=dims)),
                                   ", ".join(f"x{i} int" for i in range(dims)))
    rows = points.select("*", hilbert.curve_index([F.col(c) for c in points.columns], bits)
                         .alias("at")).orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(len(rows)))
    assert all(sum(abs(a[i] - b[i]) for i in range(dims)) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_of_odd_rows(spark, odd, clashing, nothing):
    got = hilbert.shard_documents(odd).collect()
    assert len(got) == len(ODD)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    texts = {d: (t or "").encode() for d, t, *_ in ODD}
    assert all((r["size"], r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
               for r in got)
    assert rows_of(hilbert.shard_documents(clashing)) == sorted(map(repr, got))
    assert hilbert.shard_documents(nothing).count() == 0


def test_sizes_of_long_texts_have_cells_of_their_own(spark):
    sizes = spark.createDataFrame([(1 << k,) for k in range(32)], "size long")
    cells = [r[0] for r in sizes.orderBy("size").select(hilbert.size_cell(F.col("size"))).collect()]
    assert cells == [min(2 * k, 63) for k in range(32)]
    rows = spark.createDataFrame([(i, 1 << k, "en", "a") for i in range(20) for k in (17, 20, 24, 30)],
                                 "doc_id long, size long, lang string, source string")
    cut = hilbert.hilbert_shards(rows, list(hilbert.document_cells().values()), 4, ["doc_id"])
    ranges = hilbert.shard_ranges(cut, hilbert.document_cells()).collect()
    assert sorted((r.size_low, r.size_high) for r in ranges) == [(k, k) for k in (34, 40, 48, 60)]


def test_shards_prune(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cells = hilbert.document_cells()
    rows = docs.select("doc_id", "lang", "source", (F.octet_length("text") + 1).alias("size"))
    sharded = hilbert.hilbert_shards(rows, list(cells.values()), 64, ["doc_id"])
    ranges = hilbert.shard_ranges(sharded, cells).collect()
    spread = sum(r["source_high"] - r["source_low"] for r in ranges) / len(ranges)
    assert sum(r.n_rows for r in ranges) == 1000 and spread < 20
    curve = [r.curve for r in sharded.orderBy("shard", "slot").collect()]
    assert curve == sorted(curve)


# ------------------------------------------------------------------ token files

def encoded(text):
    from tokenizers import Tokenizer
    t = encoded.tokenizer = getattr(encoded, "tokenizer", None) or Tokenizer.from_file(
        tf.default_tokenizer())
    return t.encode(text or "", add_special_tokens=False).ids


def test_word_encoder_equals_the_library():
    texts = [t for _, t, *_ in ODD if t and t != LONG] + [
        "A.B, c;d!! it's IT'S 'tis don't", "<|endoftext|> x<|startoftext|>y", "é Å ſ",
        "a\x1cb a\x85b\x00c", "ＡＢＣ 中文字 １２ ½", "THTHER!! word,%%% (a) |", "İstanbul ΣΑΣ ß ẞ",
        "a b c​d﻿e", "́x ý", "x" * 3000, "Ǆ ǅ ﬁ"]
    rng = random.Random(3)
    pool = [chr(c) for r in ((32, 127), (160, 600), (0x300, 0x330), (0x2000, 0x2070)) for c in range(*r)]
    texts += ["".join(rng.choice(pool) for _ in range(40)) for _ in range(200)]
    encoder = tf.WordEncoder(tf.default_tokenizer())
    for _ in range(2):
        for text, packed in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(packed, "<u4").tolist() == encoded(text), text


def check_files(spark, rows, got):
    order = sorted(range(len(got)), key=lambda i: got[i].start)
    ids = [got[i].doc_id for i in order]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and len(got) == len(rows)
    at = 0
    want = Counter()
    for d, t, *_ in rows:
        x = np.array([*encoded(t), tf.END_ID], "<u4")
        want[d, len(x), zlib.crc32(x.tobytes())] += 1
    for i in order:
        assert got[i].start == at
        at += got[i].n_tokens
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_pipeline_writes_copies_apart(spark, tmp_path):
    import corpus_pipeline
    rows = [(i, f"text {i}", "en", "a", 6) for i in range(600) for _ in range(5)]
    spark.createDataFrame(rows, SHAPE).orderBy("doc_id").write.parquet(str(tmp_path / "d"))
    got = corpus_pipeline.token_output(spark, spark.read.parquet(str(tmp_path / "d")), "").collect()
    got.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert Counter(ids) == Counter(r[0] for r in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.1
    assert sum(a == b for a, b in zip(ids, ids[1:])) < 30
    want = {i: (len(x) + 1, zlib.crc32(np.array([*x, tf.END_ID], "<u4").tobytes()))
            for i in range(600) for x in [encoded(f"text {i}")]}
    assert all((r.n_tokens, r.ids_crc32) == want[r.doc_id] for r in got)


@pytest.mark.parametrize("limit", [2, 1 << 15])
def test_token_files_round_trip(spark, odd, clashing, nothing, monkeypatch, limit):
    monkeypatch.setattr(tf, "FILE_SEQUENCES", limit)
    got = tf.round_trip(odd).collect()
    check_files(spark, ODD, got)
    assert rows_of(tf.round_trip(clashing)) == sorted(map(repr, got))
    assert tf.round_trip(nothing).count() == 0


@pytest.mark.parametrize("kind", [pa.uint16(), pa.uint32()])
def test_sequences_are_slices_of_one_buffer(tmp_path, kind):
    assert tf.id_type(1 << 16) == pa.uint16() and tf.id_type(65_537) == pa.uint32()
    out = tf.SequenceFile(pa.fs.LocalFileSystem(), str(tmp_path / "x.arrow"), kind)
    docs = [np.arange(n, dtype="<u4") % 60_000 for n in (5, 0, 300_000, 1, 2043)]
    for i, ids in enumerate(docs):
        out.add(i, ids.tobytes())
    out.close()
    with pa.memory_map(str(tmp_path / "x.arrow")) as file:
        batches = list(pa.ipc.open_stream(file))
        flat = [b.column("input_ids").flatten().to_numpy(zero_copy_only=True) for b in batches]
        mask = np.concatenate([b.column("mask").flatten().to_numpy(zero_copy_only=False) for b in batches])
        whole = np.concatenate(docs)
        assert (np.concatenate(flat)[:len(whole)] == whole).all() and mask.sum() == len(whole)
        assert mask[:len(whole)].all() and len(mask) % tf.SEQUENCE == 0
        first = batches[0].column("input_ids")[3].values.to_numpy(zero_copy_only=True)
        assert first.base is not None and len(first) == tf.SEQUENCE
        for k in (0, 1, 63, 64, 100, out.sequences - 1):
            ids, real = tf.sequence(file, out.firsts, out.offsets, k)
            part = whole[k * tf.SEQUENCE:(k + 1) * tf.SEQUENCE]
            assert len(ids) == len(real) == tf.SEQUENCE and real.true_count == len(part)
            assert (ids.to_numpy(zero_copy_only=True)[:len(part)] == part).all()
        assert out.firsts[0] == 0 and len(out.firsts) == len(batches)
        # A slice of the map itself: inside its address range.
        file.seek(0)
        mapped, before = file.read_buffer(), pa.total_allocated_bytes()
        ids, real = tf.sequence(file, out.firsts, out.offsets, 70)
        assert pa.total_allocated_bytes() == before
        for array in (ids, real):
            assert mapped.address <= array.buffers()[1].address < mapped.address + mapped.size
        for k in (-1, out.sequences):
            with pytest.raises(IndexError):
                tf.sequence(file, out.firsts, out.offsets, k)
    with pa.OSFile(str(tmp_path / "x.arrow")) as file:
        assert [(d, n) for d, _, n, _ in tf._documents(file, 7)] == [(i, len(x)) for i, x in enumerate(docs)]


def test_other_vocabulary_files_go_through_the_whole_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    texts = ["Plain Words, and MORE words!", "", "naïve ÀÉ (x) don't", "line\nbreak  two", "\x00 odd"]
    for name, by_words in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        encoder, plain = tf.WordEncoder(path), Tokenizer.from_file(path)
        assert encoder.by_words is by_words
        want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert encoder.encode(texts) == want


def test_quality_of_words_that_the_sample_lacks():
    """A word without a learned vector takes the index vectors around it: pooled by hand."""
    hashes = quality.WordHash()

    def index(word):
        (where,), (sign,) = quality.index_vectors(np.array([hashes[word]], np.uint64))
        out = np.zeros(quality.DIMS)
        np.add.at(out, where, sign)
        return out

    known = {"a": 1, "b": 2}
    vectors = np.random.default_rng(0).normal(size=(3, quality.DIMS)).astype(np.float32)
    model = quality.Model(known, vectors, (), 1.0)
    words = "a q b r s a t".split()
    want = np.zeros(quality.DIMS)
    for i, w in enumerate(words):
        if w in known:
            want += vectors[known[w]]
        else:
            near = sum(index(words[j]) for j in range(max(0, i - 2), min(7, i + 3)) if j != i)
            want += near / np.linalg.norm(near)
    assert np.allclose(model.pooled(" ".join(words)), want / 7, atol=1e-5)
    long = " ".join(["q"] + ["x%d" % (i % 7) for i in range(3 * quality.PLACES)])
    assert np.isfinite(model.pooled(long)).all()
    assert model.pooled("").sum() == 0 and model.pooled("alone").sum() == 0
