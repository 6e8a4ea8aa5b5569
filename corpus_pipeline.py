"""A training-data pipeline over ``documents``: each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logwarden.llm import bitpack, decontaminate, jaccard_join, mixing, toxicity
from logwarden.llm.queries import VOCABULARY
from logwarden.llm.tables import BYTE_BPE, table, vocabulary_path
from logwarden.session import new_work_path, ship_package

#: Share of all tokens that the mixture keeps.
MIXTURE = 0.8


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half for toxicity."""
    ship_package(spark)
    return toxicity.reject(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    ship_package(spark)
    return jaccard_join.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item is found."""
    ship_package(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated chances."""
    ship_package(spark)
    return mixing.sample(docs, table(spark, sf_dir, "embeddings"), budget=MIXTURE)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the documents, and what they hold per document."""
    ship_package(spark)
    folder = new_work_path(spark, "tokens")
    bitpack.write_shards(docs, folder, vocabulary_path(BYTE_BPE), VOCABULARY, end_id=0)
    return bitpack.read_digest(spark, folder)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_id_output", write_tokens),
]

#: SQL cannot express the trained toxicity model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
