"""Ranking and sampling that never sort a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SALTS = 64


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int,
                    rank: str = "rank", salts: int = SALTS) -> DataFrame:
    """First ``k`` rows of each group in ``order``.

    Rows are ranked within (group, salt) first, so a group that holds most rows is
    split over ``salts`` tasks; only the survivors (at most ``k * salts`` per group)
    are ranked again. ``order`` must be total for a repeatable result.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if _hashable(df, c)]), F.lit(salts)))
    first = W.partitionBy(*keys, "_salt").orderBy(*order)
    final = W.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
        .drop("_r", "_salt")
        .withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= k)
    )


def _hashable(df: DataFrame, name: str) -> bool:
    return "map<" not in df.schema[name].dataType.simpleString()


def seeded_hash(id_col: str, seed: int) -> Column:
    """Random-looking but repeatable order: md5 of ``id:seed``."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def hash_rank(df: DataFrame, keys: list[str], hash_name: str, id_col: str, rank: str,
              prefix: int = 3) -> DataFrame:
    """Exact 1-based rank by (hash, id) within ``keys``.

    The hash is uniform, so its first hex digits cut every group into 16**prefix
    even buckets: rows are ranked inside a bucket, and bucket sizes give the offset.
    """
    b = df.withColumn("_b", F.substring(hash_name, 1, prefix))
    sizes = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    if not keys:
        before = W.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(*keys, "_b").orderBy(hash_name, id_col)
    return (
        b.withColumn("_local", F.row_number().over(inside))
        .join(offsets, [*keys, "_b"])
        .withColumn(rank, (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_b", "_local", "_before")
    )


def stratified_sample(df: DataFrame, label: str, id_col: str, max_count: int, seed: int = 42) -> DataFrame:
    """At most ``max_count`` rows: an even quota per label, then fill from the rest.

    Runs one count job: the number of labels and rows sets the quota.
    """
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("labels")).first()
    if max_count <= 0 or max_count >= stats["n"]:
        return df
    quota = max(1, max_count // max(1, stats["labels"]))
    hashed = df.withColumn("_h", seeded_hash(id_col, seed))
    ranked = hash_rank(hashed, [label], "_h", id_col, "_rank")
    quota_rows = ranked.where(F.col("_rank") <= quota)
    sizes = df.groupBy(label).count()
    taken = sizes.agg(F.sum(F.least(F.col("count"), F.lit(quota))).alias("t")).first()["t"]
    room = max_count - taken
    if room <= 0:
        return quota_rows.drop("_h", "_rank")
    rest = ranked.where(F.col("_rank") > quota).orderBy("_h", id_col).limit(room)
    return quota_rows.unionByName(rest).drop("_h", "_rank")


def train_test_split(df: DataFrame, label: str, id_col: str, test_fraction: float = 0.2,
                     seed: int = 42, split: str = "is_test") -> DataFrame:
    """Per-class split: the first ``round(n * fraction)`` rows in hash order are test rows.

    Where a class has a single row, no class can be held to its share, and all rows are split as one. Rows
    without a label are left out.
    """
    df = df.where(F.col(label).isNotNull())
    sizes = df.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    if sizes.agg(F.min("_n").alias("m")).first()["m"] == 1:
        classes = F.lit(0)
        sizes = sizes.agg(F.sum("_n").alias("_n")).withColumn("_class", F.lit(0))
    else:
        classes = F.col(label)
    hashed = df.withColumns({"_h": seeded_hash(id_col, seed), "_class": classes})
    ranked = hash_rank(hashed, ["_class"], "_h", id_col, "_rank")
    return (
        ranked.join(sizes, "_class")
        .withColumn(split, F.col("_rank") <= F.floor(F.col("_n") * test_fraction + 0.5))
        .drop("_h", "_class", "_rank", "_n")
    )
