"""Hour-of-week baselines, endpoint floors and the anomaly gate."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logwarden.functions.columns import field
from logwarden.functions.text import endpoint_group, hour_of_week
from logwarden.operators.aggregates import timestamp_field
from logwarden.operators.predicates import is_alerting, is_malicious

# What holds where no baseline or floor was stored.
DEFAULT_MEAN_STD = (5.0, 2.0)
GROUP_MEAN_STD = {"sensitive": (0.5, 0.2)}
GROUP_FLOORS = {"sensitive": 2, "api": 20, "root": 100}
DEFAULT_FLOOR = 50
MIN_STD = 0.1


def attack_baselines(df: DataFrame) -> DataFrame:
    """Mean and population deviation of weekly alert counts per (hour of week, group)."""
    ts = timestamp_field(df)
    weekly = (
        df.where(is_alerting(df) & ts.isNotNull())
        .groupBy(
            hour_of_week(ts).alias("hour_of_week"),
            endpoint_group(field(df, "uri", "string")).alias("endpoint_group"),
            F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts)).alias("week"),
        ).agg(F.count(F.lit(1)).alias("n"))
    )
    return weekly.groupBy("hour_of_week", "endpoint_group").agg(
        F.avg("n").alias("mean"), F.stddev_pop("n").alias("std_dev"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """Value at 0-based index ``floor(n * p)`` (at most n-1) of the sorted values per key.

    Works on a value histogram, so a key never has its values gathered: the answer is
    the smallest value whose running count passes the index.
    """
    hist = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    order = W.partitionBy(*keys).orderBy(value)
    upto = hist.withColumn("_cum", F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, 0)))
    sizes = hist.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    index = F.least(F.floor(F.col("_n") * F.lit(p)), F.col("_n") - 1)
    return (
        upto.join(sizes, keys).where(F.col("_cum") > index)
        .groupBy(*keys).agg(F.min(value).alias(name))
    )


def endpoint_min_floors(df: DataFrame, percentile: float = 0.90, scale: float = 0.10) -> DataFrame:
    ts = timestamp_field(df)
    hourly = df.where(ts.isNotNull()).groupBy(
        endpoint_group(field(df, "uri", "string")).alias("endpoint_group"),
        F.date_trunc("hour", ts).alias("hour"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return nearest_rank(hourly, ["endpoint_group"], "n", percentile, "p").select(
        "endpoint_group",
        F.greatest(F.lit(2).cast("bigint"), F.floor(F.col("p") * F.lit(scale))).alias("min_floor"))


def baseline_comparison_24h(df: DataFrame, baselines: DataFrame, now: datetime, sigma: float = 3.0) -> DataFrame:
    """24 hourly points up to ``now``: malicious requests against the summed thresholds."""
    spark = df.sparkSession
    ts = timestamp_field(df)
    last = now.replace(minute=0, second=0, microsecond=0)
    hour = F.lit(last).cast("timestamp_ntz")
    hours = spark.range(1).select(F.explode(F.sequence(
        hour - F.expr("INTERVAL 23 HOUR"), hour, F.expr("INTERVAL 1 HOUR"))).alias("timestamp"))
    spine = hours.select(
        "timestamp", F.date_format("timestamp", "HH:00").alias("label"),
        hour_of_week(F.col("timestamp")).alias("hour_of_week"),
        F.dayofweek("timestamp").alias("day_of_week"), F.hour("timestamp").alias("hour"))
    span = (ts >= F.lit(last - timedelta(hours=23)).cast("timestamp_ntz")) & (
        ts < F.lit(last + timedelta(hours=1)).cast("timestamp_ntz"))
    actual = df.where(span & is_malicious(df)).groupBy(
        F.date_trunc("hour", ts).cast("timestamp_ntz").alias("timestamp")).agg(F.count(F.lit(1)).alias("actual_count"))
    mean, std = F.coalesce("mean", F.lit(0.0)), F.greatest(F.coalesce("std_dev", F.lit(0.0)), F.lit(0.0))
    limits = baselines.groupBy("hour_of_week").agg(F.sum(mean + F.lit(sigma) * std).alias("t"))
    return (
        spine.join(actual, "timestamp", "left").join(limits, "hour_of_week", "left")
        .select("timestamp", "label", "hour_of_week", "day_of_week", "hour",
                F.coalesce("actual_count", F.lit(0)).cast("bigint").alias("actual_count"),
                F.round(F.coalesce("t", F.lit(0.0)), 2).alias("threshold"))
        .orderBy("timestamp")
    )


def _by_group(table: dict, part, default) -> Column:
    out = F
    for group, value in table.items():
        out = out.when(F.col("endpoint_group") == group, F.lit(part(value)))
    return out.otherwise(F.lit(default))


def with_baseline(groups: DataFrame, baselines: DataFrame | None = None, floors: DataFrame | None = None,
                  min_floor: int = DEFAULT_FLOOR) -> DataFrame:
    """Adds ``mean``, ``std_dev`` and ``floor`` for (hour_of_week, endpoint_group).

    Exact pair first, then a stored row for the hour alone (no group), then constants.
    Join sizes are left to the optimizer: stored tables grow with the number of groups.
    """
    out = groups
    if baselines is not None:
        exact = baselines.where("endpoint_group is not null").select(
            "hour_of_week", "endpoint_group", F.col("mean").alias("_m1"), F.col("std_dev").alias("_s1"))
        hourly = baselines.where("endpoint_group is null").select(
            "hour_of_week", F.col("mean").alias("_m2"), F.col("std_dev").alias("_s2"))
        out = out.join(exact, ["hour_of_week", "endpoint_group"], "left").join(hourly, "hour_of_week", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("_m1", "_s1", "_m2", "_s2")})
    if floors is not None:
        out = out.join(floors.select("endpoint_group", F.col("min_floor").alias("_f")), "endpoint_group", "left")
    else:
        out = out.withColumn("_f", F.lit(None).cast("bigint"))
    return out.withColumns({
        "mean": F.coalesce("_m1", "_m2", _by_group(GROUP_MEAN_STD, lambda v: v[0], DEFAULT_MEAN_STD[0])),
        "std_dev": F.greatest(F.lit(MIN_STD), F.coalesce(
            "_s1", "_s2", _by_group(GROUP_MEAN_STD, lambda v: v[1], DEFAULT_MEAN_STD[1]))),
        "floor": F.coalesce(F.col("_f"), _by_group(GROUP_FLOORS, lambda v: v, min_floor)).cast("bigint"),
    }).drop("_m1", "_s1", "_m2", "_s2", "_f")


def above_baseline(df: DataFrame, count: str = "current_count", sigma: float = 3.0) -> DataFrame:
    """Adds ``threshold``, ``should_alert`` and ``deviation_ratio``."""
    c, mean, std = F.col(count), F.col("mean"), F.col("std_dev")
    threshold = mean + F.lit(sigma) * std
    return df.withColumns({
        "threshold": threshold,
        "should_alert": (c > threshold) & (c >= F.col("floor")),
        "deviation_ratio": F.when(c > mean, (c - mean) / std).otherwise(F.lit(0.0)),
    })
