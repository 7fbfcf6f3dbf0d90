"""A training corpus from `documents`: five stages, each written as Parquet and read again by the next.

Toxic documents go, one document of each group of near-duplicates stays, documents that hold benchmark passages go,
sources are mixed to target weights, and what is left becomes token ids in binary shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridia.llm import decontamination, mixing, near_duplicates, token_files, toxicity
from meridia.llm._store import shared, table, written
from meridia.llm.queries import remainder, vocabulary

#: The stages can't be told in SQL; tests hold them against brute force.
ORACLE_SQL = None
#: Documents with at least this score are rejected.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~remainder("doc_id", 4, 2))
    return toxicity.below(docs, toxicity.learn(docs, labels), TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.distinct(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in the shards, as read back from them."""
    manifest = token_files.write_shards(docs, shared(spark), vocabulary())
    return token_files.read_shards(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
