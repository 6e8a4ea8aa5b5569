"""Writers: JSON lines, CSV, keyed upserts, part merging, schema migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from logwarden.operators.nested import flat_to_nested

# Fixed value: most bytes in one converted part file.
MAX_PART_BYTES = 50 * 1024 * 1024


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def csv_ready(df: DataFrame, preferred: list[str] | None = None) -> DataFrame:
    """Preferred columns first, the rest sorted; nested values as JSON text."""
    preferred = preferred or []
    names = preferred + sorted(c for c in df.columns if c not in preferred)
    out = []
    for name in names:
        if name not in df.columns:
            out.append(F.lit(None).cast("string").alias(name))
            continue
        kind = df.schema[name].dataType
        c = F.col(f"`{name}`")
        nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
        out.append((F.to_json(c) if nested else c).alias(name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, preferred: list[str] | None = None, mode: str = "errorifexists") -> None:
    (csv_ready(df, preferred).write.mode(mode).option("header", "true")
     .option("escape", '"').option("emptyValue", "").csv(path))


def write_line_parts(lines: DataFrame, path: str, max_bytes: int = MAX_PART_BYTES) -> None:
    """Text parts of at most about ``max_bytes``: the part count comes from the total size.

    Runs one size job. Rows spread evenly over the parts, so a part can exceed the
    limit only by chance of line length; a margin of one tenth absorbs that.
    """
    total = lines.agg(F.sum(F.octet_length("line") + 1).alias("b")).first()["b"] or 0
    parts = max(1, -(-int(total * 1.1) // max_bytes))
    lines.select("line").repartition(parts).write.text(path)


def latest_per_key(df: DataFrame, key: str, version: Column) -> DataFrame:
    """Last row of each key by ``version``; rows without a key are dropped.

    ``max_by`` pre-aggregates before the shuffle, so a key with many versions is cheap.
    """
    columns = [c for c in df.columns if c != key]
    kept = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return kept.groupBy(key).agg(
        F.max_by(F.struct(*columns), version).alias("_row")
    ).select(key, *[F.col(f"_row.`{c}`").alias(c) for c in columns]).select(*df.columns)


def _row_hash(df: DataFrame) -> Column:
    """Hash of a row without its map columns, which have no hash."""
    names = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*[F.col(f"`{n}`") for n in names])


def upsert(current: DataFrame | None, batch: DataFrame, key: str = "event_id",
           order: Column | None = None) -> DataFrame:
    """Table state after upserting ``batch``: a batch row replaces the stored row.

    Fields absent from the batch keep their stored value (a field-wise ``set``).
    Applying the same batch twice gives the same table.
    """
    tie = order if order is not None else _row_hash(batch)
    new = latest_per_key(batch, key, tie)
    if current is None:
        return new
    names = list(dict.fromkeys([*current.columns, *new.columns]))
    joined = current.alias("c").join(new.withColumn("_new", F.lit(True)).alias("n"),
                                     F.col(f"c.{key}") == F.col(f"n.{key}"), "full_outer")

    def value(name: str) -> Column:
        if name == key:
            return F.coalesce(F.col(f"n.{key}"), F.col(f"c.{key}"))
        if name not in new.columns:
            return F.col(f"c.`{name}`")
        if name not in current.columns:
            return F.col(f"n.`{name}`")
        return F.when(F.col("n._new"), F.col(f"n.`{name}`")).otherwise(F.col(f"c.`{name}`"))

    return joined.select(*[value(n).alias(n) for n in names])


def write_version(batch: DataFrame, path: str, batch_id: int) -> None:
    """Stores one batch beside the earlier ones; writing a batch again replaces it.

    The cost is that of the batch alone, and no other writer's files are touched.
    """
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_current(spark: SparkSession, path: str, key: str = "event_id") -> DataFrame:
    """Last version of every key in a table written batch by batch."""
    rows = spark.read.option("basePath", path).parquet(path)
    order = F.struct("batch", _row_hash(rows))
    return latest_per_key(rows, key, order).drop("batch")


def compact(spark: SparkSession, path: str, target: str, key: str = "event_id") -> None:
    """One-version copy of a batch-wise table. A table format with MERGE does this in place."""
    read_current(spark, path, key).write.mode("errorifexists").parquet(f"{target}/batch=0")


def merge_parts(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts; columns missing in a part are NULL there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def merge_summaries(parts: DataFrame, counters: list[str], lists: list[str] | None = None) -> DataFrame:
    """One run summary from part summaries: counters add up, lists are joined in part order.

    There is one row per input part, so the lists stay small.
    """
    sums = [F.sum(F.col(c)).cast("bigint").alias(c) for c in counters]
    joined = [
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", c))), lambda x: x[c])).alias(c)
        for c in (lists or [])
    ]
    return parts.agg(*sums, *joined)


def needs_migration(df: DataFrame) -> Column:
    if "_schema_version" not in df.columns:
        return F.lit(True)
    return F.coalesce(F.col("_schema_version"), F.lit(0)) < 2


def migrate(df: DataFrame) -> DataFrame:
    """Flat stored rows rewritten in the nested layout."""
    return flat_to_nested(df.where(needs_migration(df)))


def migration_count(df: DataFrame) -> DataFrame:
    """Dry run: how many rows a migration would rewrite."""
    return df.where(needs_migration(df)).agg(F.count(F.lit(1)).alias("rows_to_migrate"))
