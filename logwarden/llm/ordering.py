"""Exact positions in a total order without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from logwarden.llm.tables import partitions
from logwarden.session import materialize


def numbered(df: DataFrame, order: list[str], within: list[str], position: str) -> DataFrame:
    """Adds ``position``, from 0 on in each group of ``within``, by the columns of ``order`` ascending.

    Rows are range-partitioned and sorted once and written with their place in the partition; the rows
    that each group has in the partitions before are a sum over one row per group and partition. Rows
    that are equal in ``order`` are numbered as they come, so it should be total. Names that start with
    ``_at`` are not given by the caller.
    """
    keys = [*within, *order]
    dealt = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    rows = materialize(dealt.withColumns({
        "_at_part": F.spark_partition_id(), "_at_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ordered")
    parts = rows.groupBy(*within, "_at_part").agg(F.min("_at_row").alias("_at_first"), F.count(F.lit(1)).alias("_at_n"))
    earlier = W.partitionBy(*within).orderBy("_at_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*within, "_at_part", (F.coalesce(F.sum("_at_n").over(earlier), F.lit(0)) - F.col("_at_first")).alias("_at_shift"))
    return rows.join(parts, [*within, "_at_part"]).withColumn(position, F.col("_at_row") + F.col("_at_shift")).select(*df.columns, position)
