"""From raw documents to packed training sequences: five stages, each by one operator of tidelake.llm.

Every stage works on all documents that its predecessor kept and, but for the last, returns rows
of documents with all their columns:

1. ``quality``: documents that the ordinal classifier rejects (probability of the top grade below one half) go;
2. ``exact_dedup``: of equal texts the smallest doc_id stays;
3. ``near_dedup``: of each component of near duplicates the smallest doc_id stays;
4. ``mixing``: sources get their target weights; a document is repeated or left out as the mix takes it;
5. ``packing``: pieces of at most 2048 tokens in as few sequences as best fit finds.

A stage is written as Parquet in the shared folder and read again as the next one's documents.  SQL can't express
stages 1, 3 and 5, so there is no SQL for the whole; tests hold the stages against brute force.

Null texts are empty.  Rows with repeated or null identifiers are documents of their own in every stage, empty
tables give empty results, further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelake.llm import exact_dedup, jaccard_join, mixing, packing, quality
from tidelake.llm.common import stage as staged

ORACLE_SQL: str | None = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.select_top(docs, quality.train(docs, quality.grades_of(labels)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = staged(step(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
