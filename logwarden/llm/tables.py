"""What the operators of this folder share: reading tables, folds, whole texts, sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The public byte-level BPE and piece vocabularies; only their paths are used.
BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"


def register(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(column: str = "doc_id") -> Column:
    """Documents that no model learns labels from: remainder 0 of the checksum of the id by 5."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_pattern() -> str:
    """The pattern that cuts texts before the merges of the rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def small_batches(spark: SparkSession) -> None:
    """Whole texts reach Python in batches of 16 MB, so that a worker's memory doesn't follow their length.

    One longer text is still a batch of its own. A setting of the session that gives the same rows.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
