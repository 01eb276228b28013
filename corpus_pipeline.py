"""The corpus pipeline: from documents to files of token ids, stage by stage.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all rows that the
stage before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortry.llm import decontaminate, hyperdim, poisson_mix, prob_minhash, token_files
from cohortry.llm.common import table
from cohortry.sources.scratch import settle


#: Words that a token worker keeps: it shares its executor's memory with the stages before.
KEPT_WORDS = 130_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is identified."""
    return hyperdim.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates."""
    return prob_minhash.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of the benchmark out of the texts; see remove_spans for what goes whole."""
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate documents to the sources' target weights, in shuffled order."""
    return poisson_mix.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files in shuffled order; one row per copy, read back from them."""
    return token_files.round_trip(docs, order=token_files.shuffled_order(), kept=KEPT_WORDS)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("mixing", mixing),
          ("token_output", token_output)]

#: Languages, signatures and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
