"""The whole pipeline against a plain version, stage by stage."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from cohortry.llm import token_files as tf
from odd_rows import SHAPE
from test_exact import removal_by_hand
from test_models import SF, classes_by_hand, encoded


def copies_by_hand(rows):
    """doc_id -> copies, from the sources' shares to the power 0.7."""
    n = Counter(r[3] for r in rows)
    total = sum(k ** 0.7 for k in n.values())
    out = {}
    for doc, _, _, source, _ in rows:
        rate = round(len(rows) / total * n[source] ** 0.7 / n[source], 9)
        unit = int(hashlib.md5(f"42:{doc}".encode()).hexdigest()[:13], 16) / 2 ** 52
        k, below = 0, math.exp(-rate)
        while below <= unit:
            k += 1
            below += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out[doc] = k
    return out


def test_pipeline_equals_plain_stages(spark, tmp_path, monkeypatch):
    source = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 1200")
    rows = sorted(map(tuple, source.select("doc_id", "text", "lang", "source", "n_chars").collect()))[:120]
    quote = " ".join(f"quoted{i}" for i in range(12))
    more = [rows[0][1], "12 34 !!", "", None, quote, f"{rows[1][1]} {quote}, {rows[2][1]}"]
    rows += [(10 ** 6 + i, t, "en", "extra", len(t or "")) for i, t in enumerate(more)]
    items = [(1, quote), (2, " ".join(rows[3][1].split()[:14]))]
    spark.createDataFrame(rows, SHAPE).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))

    seen = {}

    def watched(name, stage):
        def run(session, docs, sf_dir):
            seen[name] = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
            return stage(session, docs, sf_dir)
        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s) for s in corpus_pipeline.STAGES])
    out = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    assert sorted(seen["language_id"], key=str) == sorted(rows, key=str)
    # All texts with letters are in a language of the sample.
    identified = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert sorted(seen["near_dedup"]) == sorted(identified) and len(identified) < len(rows)
    label = classes_by_hand(identified)
    unique = [r for r in identified if label[r[0]] == r[0]]
    assert sorted(seen["decontamination"]) == sorted(unique) and len(unique) < len(identified)
    cut = [(r, removal_by_hand(r[1], [t for _, t in items], 10, 0, 1.0, 0.2)) for r in unique]
    clean = [(r[0], t, r[2], r[3], len(t)) for r, t in cut if t is not None]
    assert sorted(seen["mixing"]) == sorted(clean) and len(clean) < len(unique)
    assert sum(t is not None and t != r[1] for r, t in cut) >= 2
    copies = copies_by_hand(clean)
    mixed = [r for r in clean for _ in range(copies[r[0]])]
    assert sorted(seen["token_output"]) == sorted(mixed) and max(copies.values()) > 1
    want = Counter()
    for r in mixed:
        x = np.array([*encoded(r[1]), tf.END_ID], "<u4")
        want[r[0], len(x), zlib.crc32(x.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    assert out[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:]))
    ids = [r.doc_id for r in out]
    assert ids != sorted(ids) and sum(a == b for a, b in zip(ids, ids[1:])) < max(5, len(ids) // 10)
