"""The registered queries of the numbered operators, and their SQL texts.

Each query runs its operator on a whole table and derives the asked columns.
Signatures, models, hashed cells and token files have no SQL form; those queries
are tested against brute force and held-out labels instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import (
    alignment, decontaminate, hard_negatives, hilbert, hyperdim, licenses, poisson_mix, prob_minhash,
    quality, run_merge, substring, token_files, warc,
)
from cohortry.llm.common import table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op2_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op4_run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_merge.exact_dedup(table(spark, sf_dir, "documents"))


def op5_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark"))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_documents(table(spark, sf_dir, "documents"))


def op7_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperdim.identify(table(spark, sf_dir, "documents"))


def op8_rabin_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed",
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return poisson_mix.replicate(docs, poisson_mix.target_rates(docs)).select(
        F.col("in_doc_id").alias("doc_id"), F.col("in_source").alias("source"), "rate", "n_copies",
        F.col("copy").cast("bigint").alias("copy"), "place",
        F.sha2(F.coalesce("in_text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids divisible by 100 are anchors; every seventh id has its label moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_token_files, op2_prob_minhash, op3_warc, op4_run_merge, op5_suffix_automaton,
    op6_hilbert_shards, op7_hyperdimensional, op8_rabin_karp, op9_random_indexing,
    op10_poisson_mix, op11_hard_negatives, op12_alignment, op13_diagonal_voting)}

_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = rf"regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_NAMED_TEXTS = ", ".join(
    "({}, '{}', {}, '{}')".format(i, label, i < len(licenses.BASE), text.replace("'", "''"))
    for i, (label, text) in enumerate([*licenses.BASE, *licenses.TEMPLATES]))

ORACLES = {
    "op3_warc": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
                          sha256(coalesce(html, '')) AS payload_digest FROM pages),
             f AS (SELECT *, CASE WHEN payload_bytes >= {warc.MIN_REVISIT_BYTES} THEN
                          min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS one
                   FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN one = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN one = page_id THEN NULL ELSE one END AS refers_to FROM f""",
    "op4_run_merge": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
                   FROM documents)
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER best = 1 AS kept, h AS text_sha256
        FROM t WINDOW best AS (PARTITION BY h ORDER BY n DESC, doc_id)""",
    "op5_suffix_automaton": f"""
        WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
             i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_BENCH_WORDS} AS w FROM benchmark),
             iw AS (SELECT DISTINCT item, m, array_to_string(w[k:k + m - 1], ' ') AS s FROM (
                        SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM (
                            SELECT *, least({decontaminate.WINDOW}, len(w)) AS m FROM i
                            WHERE len(w) > 0))),
             dw AS (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS s FROM (
                        SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k
                        FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
             h AS (SELECT doc_id, k, m, item FROM dw JOIN iw USING (m, s)),
             n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
                       SELECT doc_id, unnest(range(k, k + m)) AS p FROM h) GROUP BY doc_id),
             o AS (SELECT doc_id, count(*) AS n_items,
                          sha256(string_agg(item, ',' ORDER BY item)) AS digest
                   FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
               coalesce(n_items, 0)::BIGINT AS n_items, coalesce(digest, sha256('')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)""",
    "op8_rabin_karp": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
                   FROM documents),
             s AS (SELECT doc_id, k, md5(array_to_string(w[k:k + {substring.WINDOW - 1}], ' ')) AS h
                   FROM (SELECT doc_id, w, unnest(range(1, len(w) - {substring.WINDOW} + 2)) AS k
                         FROM d WHERE len(w) >= {substring.WINDOW})),
             g AS (SELECT doc_id, k FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS one FROM s)
                   WHERE one < doc_id),
             r AS (SELECT DISTINCT doc_id, unnest(range(k, k + {substring.WINDOW})) AS p FROM g),
             x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
             y AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS body
                   FROM x LEFT JOIN r USING (doc_id, p) WHERE r.p IS NULL GROUP BY x.doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(body, '')) AS kept_sha256
        FROM d LEFT JOIN y USING (doc_id)""",
    "op10_poisson_mix": f"""
        WITH n AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
             t AS (SELECT source, n, round(
                       (sum(n) OVER () / sum(pow(n, {poisson_mix.POWER})) OVER ())
                       * pow(n, {poisson_mix.POWER}) / n, 9) AS rate FROM n),
             c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1)))
                              OVER (PARTITION BY source ORDER BY k) AS below
                   FROM t, range(0, 200) AS r(k)),
             u AS (SELECT doc_id, source, text, ('0x' || substr(md5('42:' || doc_id), 1, 13))::BIGINT
                          / {2 ** 52}.0::DOUBLE AS u FROM documents),
             m AS (SELECT doc_id, count(*) AS n_copies FROM u JOIN c
                       ON u.source IS NOT DISTINCT FROM c.source AND c.below <= u.u GROUP BY doc_id)
        SELECT doc_id, u.source, rate, n_copies, copy,
               md5('order 42:' || doc_id || ':' || copy) AS place,
               sha256(coalesce(text, '')) AS text_sha256
        FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source JOIN m USING (doc_id),
             LATERAL (SELECT unnest(range(0, n_copies)) AS copy)""",
    "op11_hard_negatives": f"""
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x:
                              CAST(floor({hard_negatives.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                          CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q),
                              lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
                   FROM v a, v b WHERE a.vec_id % 100 = 0),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s
                   WHERE same AND vec_id != anchor_id QUALIFY row_number() OVER (
                       PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {hard_negatives.POSITIVES})
        SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND {hard_negatives.LEAST} * positive_score <= 100 * score
              AND 100 * score <= {hard_negatives.MOST} * positive_score
        WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER best <= {hard_negatives.NEGATIVES}""",
    "op13_diagonal_voting": f"""
        WITH t(template, label, exact, text) AS (VALUES {_NAMED_TEXTS}),
             tw AS (SELECT template, label, exact, {_BENCH_WORDS} AS w FROM t),
             tg AS (SELECT template, label, exact, len(w) AS n, p AS place,
                           array_to_string(w[p + 1:p + {licenses.GRAM}], ' ') AS gram
                    FROM (SELECT *, unnest(range(0, len(w) - {licenses.GRAM - 1})) AS p FROM tw)),
             d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
             dg AS (SELECT doc_id, p AS begins, array_to_string(w[p + 1:p + {licenses.GRAM}], ' ') AS gram
                    FROM (SELECT *, unnest(range(0, len(w) - {licenses.GRAM - 1})) AS p FROM d)),
             h AS (SELECT doc_id, template, label, exact, n, place, begins - place AS diagonal
                   FROM dg JOIN tg USING (gram)),
             l AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template
                       ORDER BY diagonal) AS gap FROM (SELECT DISTINCT doc_id, template, exact, diagonal FROM h)),
             r AS (SELECT doc_id, template, diagonal, sum(CASE WHEN exact OR gap IS NULL
                          OR gap > {licenses.SHIFT} THEN 1 ELSE 0 END) OVER (
                          PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM l),
             c AS (SELECT doc_id, template, any_value(label) AS label, any_value(exact) AS exact,
                          min(diagonal + place) AS first_word,
                          count(DISTINCT w) / any_value(n)::DOUBLE AS cover
                   FROM (SELECT *, unnest(range(place, place + {licenses.GRAM})) AS w
                         FROM h JOIN r USING (doc_id, template, diagonal)) GROUP BY doc_id, template, run),
             f AS (SELECT doc_id, count(*) FILTER (WHERE exact) AS n_base,
                          min(first_word) FILTER (WHERE exact) AS first_word,
                          max(first_word) FILTER (WHERE exact) AS last_word,
                          coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact), '')
                              AS base_labels,
                          string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
                   FROM c WHERE cover >= CASE WHEN exact THEN 1 ELSE {licenses.LEAST_COVER} END
                   GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
               first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN f USING (doc_id)""",
}
