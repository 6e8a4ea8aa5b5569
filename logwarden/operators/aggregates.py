"""Analyst aggregates over request tables.

Sets of targets are given as rows (``*_targets``) next to exact counts: a busy
address may touch any number of URIs, which must not be gathered in one task.
"""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.functions.columns import field
from logwarden.functions.text import endpoint_group
from logwarden.operators.predicates import (
    in_range, is_alerting, is_high_severity, is_malicious, since, timeframe_windows,
)

# Time units of the threat timeline.
TIME_UNITS = ["year", "quarter", "month", "week", "day", "hour", "minute", "second"]


def timestamp_field(df: DataFrame) -> Column:
    return F.col("timestamp") if "timestamp" in df.columns else F.col("ts")


def attack_type_of(df: DataFrame) -> Column:
    return F.coalesce(field(df, "attack_type", "string"), field(df, "ml_attack_type", "string"), F.lit("Unknown"))


def of_addresses(df: DataFrame, ips: list[str]) -> DataFrame:
    """Rows of the given addresses, as a literal list that the scan can push down."""
    ip = field(df, "source_ip", "string")
    return df.where(ip.isin(ips) | ip.isNull() if "Unknown" in ips else ip.isin(ips))


def malicious_requests(df: DataFrame, start: datetime | None = None) -> DataFrame:
    """Malicious rows since ``start`` with the columns the aggregates need."""
    ts = timestamp_field(df)
    return df.where(since(ts, start) & is_malicious(df)).select(
        F.coalesce(field(df, "source_ip", "string"), F.lit("Unknown")).alias("ip"),
        field(df, "uri", "string").alias("uri"),
        field(df, "attack_type", "string").alias("rule_attack_type"),
        attack_type_of(df).alias("attack_type"),
        ts.alias("ts"),
    )


def attack_type_distribution(df: DataFrame, start: datetime | None = None, limit: int = 20) -> DataFrame:
    return (
        malicious_requests(df, start).groupBy("attack_type").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "attack_type").limit(limit)
    )


def _ip_totals(rows: DataFrame) -> DataFrame:
    """Per address: attacks, types, distinct URIs, first and last time, in one pass.

    Counting per (address, URI) first spreads a busy address over tasks; the second step
    sums one row per pair. The sets of types are few, whatever the number of requests.
    """
    pairs = rows.groupBy("ip", "uri").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("rule_attack_type")).alias("types"),
        F.min("ts").alias("first"), F.max("ts").alias("last"))
    return pairs.groupBy("ip").agg(
        F.sum("n").alias("total_attacks"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("attack_types"),
        F.min("first").alias("first_seen"),
        F.max("last").alias("last_seen"),
        F.count("uri").alias("target_count"),
    )


def top_attacking_ips(df: DataFrame, limit: int | None = 10, start: datetime | None = None) -> DataFrame:
    rows = malicious_requests(df, start)
    ranked = _ip_totals(rows).orderBy(F.desc("total_attacks"), "ip")
    return ranked if limit is None else ranked.limit(limit)


def attack_targets(df: DataFrame, ips: DataFrame, start: datetime | None = None) -> DataFrame:
    """One row per (address, URI) with hits, for the addresses of a top-k report."""
    rows = malicious_requests(df, start)
    return rows.join(ips.select("ip"), "ip", "left_semi").where("uri is not null").groupBy("ip", "uri").agg(
        F.count(F.lit(1)).alias("hits"))


def campaign_risk_level(total: Column, types: Column) -> Column:
    return (
        F.when((total >= 30) | (types >= 4), "critical").when((total >= 15) | (types >= 3), "high")
        .when((total >= 8) | (types >= 2), "medium").otherwise("low")
    )


def attack_campaigns(df: DataFrame, min_attacks: int = 50, min_types: int = 3, limit: int = 10,
                     start: datetime | None = None) -> DataFrame:
    """Addresses over both thresholds, with their risk level."""
    rows = malicious_requests(df, start)
    totals = _ip_totals(rows).withColumn("attack_type_count", F.size("attack_types"))
    winners = totals.where(
        (F.col("total_attacks") >= max(1, min_attacks)) & (F.col("attack_type_count") >= max(1, min_types))
    ).orderBy(F.desc("total_attacks"), "ip").limit(limit)
    return winners.withColumn("risk_level", campaign_risk_level(F.col("total_attacks"), F.col("attack_type_count")))


def attack_campaigns_any(df: DataFrame, min_attacks: int = 10, min_types: int = 3, top: int | None = None,
                         start: datetime | None = None) -> DataFrame:
    """Addresses with any threshold met or more than one target; of the busiest ``top`` only if asked for."""
    rows = top_attacking_ips(df, top, start).withColumn("attack_type_count", F.size("attack_types"))
    return rows.where(
        (F.col("total_attacks") >= min_attacks) | (F.col("attack_type_count") >= min_types) | (F.col("target_count") > 1)
    ).withColumn("risk_level", campaign_risk_level(F.col("total_attacks"), F.col("attack_type_count"))).orderBy(
        F.desc("total_attacks"), "ip")


def ip_threat_scores(df: DataFrame, limit: int = 10) -> DataFrame:
    """Per address: requests, alerts, risk and the distinct rules that fired, worst first."""
    ids = field(df, "matched_rule_ids", "array<string>")
    rows = df.select(
        F.coalesce(field(df, "source_ip", "string"), F.lit("Unknown")).alias("source_ip"),
        is_alerting(df).alias("alert"), field(df, "risk_score", "double").alias("risk"), ids.alias("ids"),
    )
    totals = rows.groupBy("source_ip").agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if("alert").alias("total_alerts"),
        F.max("risk").alias("max_risk_score"),
        F.avg("risk").alias("avg_risk_score"),
    )
    worst = totals.orderBy(
        F.desc("max_risk_score"), F.desc("total_alerts"), F.desc("avg_risk_score"), "source_ip").limit(limit)
    # Distinct rule-id lists of the reported addresses; pre-reduced to one row per list.
    mine = rows.where("ids is not null").join(worst.select("source_ip"), "source_ip", "left_semi")
    fired = (mine.select("source_ip", F.array_join("ids", ",").alias("list")).distinct()
             .groupBy("source_ip").agg(F.array_sort(F.collect_set("list")).alias("lists")))
    return worst.join(fired, "source_ip", "left").select(
        "*", F.transform(F.coalesce("lists", F.array().cast("array<string>")),
                         lambda t: F.filter(F.split(t, ","), lambda x: x != "")).alias("triggered_rules")
    ).drop("lists")


def ip_blast_radius(df: DataFrame, ip: str | Column, limit: int = 10) -> DataFrame:
    """Most requested URIs of one address with their share of its requests in percent.

    The address filter goes to the scan; the total is one row, joined on a constant key.
    """
    uris = (
        df.where(field(df, "source_ip", "string") == ip)
        .groupBy(F.coalesce(field(df, "uri", "string"), F.lit("Unknown")).alias("uri"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    total = uris.groupBy(F.lit(1).alias("one")).agg(F.sum("count").alias("total"))
    top = uris.orderBy(F.desc("count"), "uri").limit(limit).withColumn("one", F.lit(1))
    return top.join(F.broadcast(total), "one").select(
        "uri", "count", F.round(F.col("count") / F.col("total") * 100.0, 2).alias("percentage")
    ).orderBy(F.desc("count"), "uri")


def bin_start(ts: Column, size: int, unit: str) -> Column:
    """Start of the ``size``-unit bin that holds ``ts``."""
    if size == 1 or unit in ("month", "quarter", "year"):
        return F.date_trunc(unit, ts)
    return F.window(ts, f"{size} {unit}").start


def attack_timeline(df: DataFrame, ip: str | None = None, size: int = 1, unit: str = "hour",
                    limit: int | None = None, start: datetime | None = None) -> DataFrame:
    """Attacks per time bin and type; all bins unless ``limit`` asks for the first ones."""
    rows = malicious_requests(df, start).where("ts is not null")
    if ip:
        rows = rows.where(F.col("ip") == ip)
    bins = (
        rows.groupBy(bin_start(F.col("ts"), max(1, size), unit).alias("timestamp"), "attack_type")
        .agg(F.count(F.lit(1)).alias("count")).orderBy("timestamp", "attack_type")
    )
    return bins.limit(limit) if limit else bins


def threat_timeline(df: DataFrame, interval: str = "hour") -> DataFrame:
    """Requests, alerts and mean risk per time bucket; an unknown interval means hour."""
    unit = interval if interval in TIME_UNITS else "hour"
    ts = timestamp_field(df)
    return (
        df.where(ts.isNotNull()).groupBy(F.date_trunc(unit, ts).alias("time_bucket")).agg(
            F.count(F.lit(1)).alias("total_requests"),
            F.count_if(is_alerting(df)).alias("total_alerts"),
            F.avg(field(df, "risk_score", "double")).alias("avg_risk_score"),
        ).orderBy("time_bucket")
    )


def trend(current: Column, previous: Column) -> dict[str, Column]:
    delta = current - previous
    return {
        "direction": F.when(delta > 0, "up").when(delta < 0, "down").otherwise("flat"),
        "percent": F.when(previous > 0, F.round(delta / previous * 100.0, 1)),
        "delta": delta,
    }


def soc_summary(requests: DataFrame, incidents: DataFrame | None, campaigns: DataFrame | None,
                timeframe: str | None, now: datetime) -> DataFrame:
    """One row of headline counts; both windows are counted in one pass over the requests."""
    ts = timestamp_field(requests)
    win = timeframe_windows(timeframe, now)
    bad, high = is_malicious(requests), is_high_severity(requests)
    if win:
        cur = in_range(ts, win["start"], win["end"])
        prev = in_range(ts, win["prev_start"], win["prev_end"])
        rows = requests.where(in_range(ts, win["prev_start"], win["end"]))
    else:
        cur, prev, rows = F.lit(True), F.lit(False), requests
    req = rows.agg(
        F.count_if(cur).alias("total_requests"), F.count_if(cur & bad).alias("malicious_requests"),
        F.count_if(cur & bad & high).alias("_high"),
        F.count_if(prev).alias("_prev_requests"), F.count_if(prev & bad).alias("_prev_malicious"),
    ).withColumn("one", F.lit(1))
    if incidents is not None:
        its = timestamp_field(incidents)
        shown = in_range(its, win["start"], win["end"]) if win else F.lit(True)
        inc = incidents.agg(
            F.count_if(shown).alias("_incidents"),
            F.count_if(shown & is_high_severity(incidents)).alias("_inc_high"),
        ).withColumn("one", F.lit(1))
        req = req.join(F.broadcast(inc), "one")
    else:
        req = req.withColumns({"_incidents": F.lit(0), "_inc_high": F.lit(0)})
    if campaigns is not None:
        req = req.join(F.broadcast(campaign_metadata(campaigns).withColumn("one", F.lit(1))), "one")
    else:
        req = req.withColumns({"active_campaigns": F.lit(0).cast("bigint"), "campaigns_last_updated": F.lit(None).cast("timestamp")})

    out = [
        F.col("total_requests"), F.col("malicious_requests"),
        F.when(F.col("_incidents") > 0, F.col("_incidents")).otherwise(F.col("malicious_requests")).alias("total_incidents"),
        "active_campaigns", "campaigns_last_updated",
        F.when(F.col("_inc_high") > 0, F.col("_inc_high")).otherwise(F.col("_high")).alias("high_severity_incidents"),
    ]
    if win:
        for name, prev_name in (("total_requests", "_prev_requests"), ("malicious_requests", "_prev_malicious")):
            out += [c.alias(f"{name}_trend_{k}") for k, c in trend(F.col(name), F.col(prev_name)).items()]
        out.append(F.lit(f"vs {win['label']}").alias("comparison_label"))
    return req.select(*out)


def active_campaigns(df: DataFrame, refreshed: datetime, **thresholds) -> DataFrame:
    """Campaign table as stored by a scheduled refresh."""
    return attack_campaigns(df, **thresholds).withColumns({
        "status": F.lit("active"), "materialized_at": F.lit(refreshed).cast("timestamp_ntz")})


def read_campaigns(stored: DataFrame, limit: int = 50) -> DataFrame:
    return stored.where("status = 'active'").orderBy(F.desc("total_attacks"), "ip").limit(limit)


def campaign_metadata(stored: DataFrame) -> DataFrame:
    return stored.agg(F.count_if(F.col("status") == "active").alias("active_campaigns"),
                      F.max("materialized_at").alias("campaigns_last_updated"))


def alerting_group_counts(df: DataFrame, now: datetime | None = None, hours: int = 1) -> DataFrame:
    """Alerting rows per endpoint group in the last ``hours``."""
    ts = timestamp_field(df)
    rows = df.where(is_alerting(df))
    if now is not None:
        rows = rows.where(ts >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOUR"))
    return rows.groupBy(endpoint_group(field(df, "uri", "string")).alias("endpoint_group")).agg(
        F.count(F.lit(1)).alias("count"))


def group_counts(df: DataFrame) -> DataFrame:
    """Rows per endpoint group of one alert batch."""
    return df.groupBy(endpoint_group(field(df, "uri", "string")).alias("endpoint_group")).agg(
        F.count(F.lit(1)).alias("count"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))


def values_at(df: DataFrame, value: str, places: list[int], buckets: int = 4096) -> dict[int, float]:
    """The values at the given places (from 0) of the ascending order of a column of numbers, exactly.

    Each pass cuts the range that still holds a place into ``buckets`` and counts them; the bucket with the place,
    narrowed to the values that occur in it, is the next range, until it is one value. Memory doesn't depend on
    how many different values there are, and no pass sorts.
    """
    v, found = F.col(value), {}
    ends = df.agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("n")).first()
    ranges = {(ends.low, ends.high, 0): sorted(set(places))} if ends.n else {}
    while ranges:
        narrower: dict[tuple, list[int]] = {}
        for (low, high, before), wanted in ranges.items():
            if low == high:
                found.update(dict.fromkeys(wanted, low))
                continue
            width = high / buckets - low / buckets
            place = F.least(F.floor((v - low) / width) if width else F.when(v == low, 0).otherwise(1), F.lit(buckets - 1)).alias("bucket")
            counts = df.where((v >= low) & (v <= high)).groupBy(place).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("n"))
            for r in sorted(counts.collect(), key=lambda r: r.low):
                own = [p for p in wanted if before <= p < before + r.n]
                if own:
                    narrower[r.low, r.high, before] = own
                before += r.n
        ranges = narrower
    return found


def percentiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles of a column, interpolated between neighbours; null and NaN are no values."""
    rows = df.select(F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("v")).where("v is not null")
    n = rows.count()
    if not n:
        return [None] * len(shares)
    places = [share * (n - 1) for share in shares]
    at = values_at(rows, "v", [p for place in places for p in (math.floor(place), math.ceil(place))])
    return [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in places]


def latency_summary(df: DataFrame, value: str) -> DataFrame:
    """Mean, median, 95th percentile (interpolated) and maximum, rounded to 3 digits; null and NaN are no values."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    p50, p95 = (F.round(F.lit(p).cast("double"), 3) for p in percentiles(df, value, [0.5, 0.95]))
    return df.agg(F.round(F.avg(v), 3).alias("mean"), F.round(F.max(v), 3).alias("max")).select(
        "mean", p50.alias("p50"), p95.alias("p95"), "max")
