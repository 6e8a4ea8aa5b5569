"""Order-dependent operators over files without one task per file.

A window partitioned by file alone would put a whole file into one task. Here the
rows of a file are cut into blocks; each block is handled on its own and a small
per-block summary carries the state across blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK_ROWS = 1 << 20


def with_blocks(df: DataFrame, pos: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(pos) / block_rows).cast("bigint"))


def _carry(summary: DataFrame, keys: list[str], block: str) -> W:
    """Rows of earlier blocks of the same group; one row per block."""
    return W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)


def number_rows(df: DataFrame, keys: list[str], block: str, order: str, name: str) -> DataFrame:
    """1-based row number within ``keys``; blocks are ordered by ``block``, rows by ``order``."""
    local = W.partitionBy(*keys, block).orderBy(order)
    numbered = df.withColumn("_local", F.row_number().over(local))
    sizes = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(_carry(sizes, keys, block)), F.lit(0)))
    return (
        numbered.join(offsets.drop("_n"), [*keys, block])
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_local", "_before")
    )


def fill_forward(df: DataFrame, keys: list[str], pos: str, value: Column, name: str,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Last non-null ``value`` at or before each row."""
    base = with_blocks(df, pos, block_rows).withColumn("_v", value)
    local = W.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    ends = base.where("_v is not null").groupBy(*keys, "_block").agg(
        F.max(F.struct(F.col(pos).alias("p"), F.col("_v").alias("v")))["v"].alias("_end"))
    blocks = base.select(*keys, "_block").distinct().join(ends, [*keys, "_block"], "left")
    carried = blocks.withColumn(
        "_carry", F.last("_end", ignorenulls=True).over(_carry(blocks, keys, "_block"))).drop("_end")
    return (
        base.withColumn("_local", F.last("_v", ignorenulls=True).over(local))
        .join(carried, [*keys, "_block"])
        .withColumn(name, F.coalesce("_local", "_carry"))
        .drop("_block", "_v", "_local", "_carry")
    )


def running_count(df: DataFrame, keys: list[str], pos: str, flag: Column, name: str,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number of rows with ``flag`` at or before each row."""
    base = with_blocks(df, pos, block_rows).withColumn("_f", F.coalesce(flag, F.lit(False)).cast("int"))
    local = W.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    sums = base.groupBy(*keys, "_block").agg(F.sum("_f").alias("_n"))
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_n").over(_carry(sums, keys, "_block")), F.lit(0)))
    return (
        base.withColumn("_local", F.sum("_f").over(local))
        .join(offsets.drop("_n"), [*keys, "_block"])
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_block", "_f", "_local", "_before")
    )
