"""Run summary and analyst reports as tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.functions.columns import pick
from logwarden.operators.aggregates import timestamp_field
from logwarden.operators.analyst import analyst_rows, explanation, recommendations
from logwarden.operators.baselines import attack_baselines, baseline_comparison_24h, endpoint_min_floors
from logwarden.operators.predicates import is_malicious
from logwarden.operators.vectors import knn, match_rows

TOP_TYPES, TOP_RULES, SAMPLE_ALERTS = 5, 10, 10


def run_counts(scored: DataFrame) -> DataFrame:
    """Stage, label and ML counts of a run in one pass; every stage keeps its rows."""
    def has(name: str, test) -> Column:
        return F.count_if(test(F.col(name))) if name in scored.columns else F.lit(0).cast("bigint")

    label = F.coalesce("final_label", F.lit("benign"))
    return scored.agg(
        F.count(F.lit(1)).alias("scored_records"),
        F.count_if(F.col("should_alert")).alias("alerts"),
        has("parse_error", lambda c: c).alias("parse_errors"),
        F.count_if(label == "benign").alias("benign"),
        F.count_if(label == "suspicious").alias("suspicious"),
        F.count_if(label == "malicious").alias("malicious"),
        has("ml_label", lambda c: c.isNotNull() & (c != "")).alias("ml_predictions"),
        has("ml_label", lambda c: F.lower(c) == "benign").alias("ml_benign"),
        has("ml_label", lambda c: F.lower(c) == "attack").alias("ml_attack"),
    )


def top_values(df: DataFrame, column: str, limit: int, name: str = "value") -> DataFrame:
    return (
        df.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias(name))
        .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), name).limit(limit)
    )


def top_attack_types(alerts: DataFrame, limit: int = TOP_TYPES) -> DataFrame:
    return top_values(alerts, "attack_type", limit, "attack_type")


def top_matched_rules(alerts: DataFrame, limit: int = TOP_RULES) -> DataFrame:
    return top_values(alerts.select(F.explode("matched_rule_ids").alias("rule_id")), "rule_id", limit, "rule_id")


def source_counts(alerts: DataFrame) -> DataFrame:
    return (
        alerts.select(F.explode("detection_sources").alias("source")).where("source <> ''")
        .groupBy("source").agg(F.count(F.lit(1)).alias("count")).orderBy("source")
    )


def sample_alerts(alerts: DataFrame, limit: int = SAMPLE_ALERTS) -> DataFrame:
    """First alerts in input order."""
    order = [c for c in ("file", "line_number", "event_id") if c in alerts.columns]
    return alerts.orderBy(*order).limit(limit).select(
        *[pick(alerts, *names, default=default).alias(name) for name, names, default in [
            ("source_ip", ["source_ip"], "-"), ("method", ["http_method"], "-"), ("uri", ["uri"], "-"),
            ("label", ["final_label", "rule_label"], "-"), ("risk_score", ["risk_score", "rule_score"], 0),
            ("attack_type", ["attack_type"], "-")]])


def report_tables(scored: DataFrame) -> dict[str, DataFrame]:
    """All tables of a run report, by name."""
    alerts = scored.where("should_alert")
    return {
        "counts": run_counts(scored), "top_attack_types": top_attack_types(alerts),
        "top_matched_rules": top_matched_rules(alerts), "sources": source_counts(alerts),
        "sample_alerts": sample_alerts(alerts),
    }


def recent_incidents(incidents: DataFrame | None, requests: DataFrame, limit: int = 100,
                     start: datetime | None = None) -> DataFrame:
    """Newest incidents; malicious requests stand in when there is no incident row."""
    def newest(df: DataFrame) -> DataFrame:
        ts = timestamp_field(df)
        rows = df if start is None else df.where(ts >= F.lit(start).cast("timestamp_ntz"))
        return analyst_rows(rows)

    order = [F.desc("timestamp"), F.col("event_id")]
    fallback = newest(requests.where(is_malicious(requests))).orderBy(*order).limit(limit).withColumn("_p", F.lit(1))
    if incidents is None:
        return fallback.drop("_p")
    own = newest(incidents).orderBy(*order).limit(limit).withColumn("_p", F.lit(0))
    both = own.unionByName(fallback, allowMissingColumns=True)
    first = F.broadcast(both.agg(F.min("_p").alias("_p")))
    return both.join(first, "_p").drop("_p").orderBy(*order)


def managed_incident_list(managed: DataFrame, limit: int = 100) -> DataFrame:
    newest = F.coalesce(*[F.col(c).cast("string") for c in ("created_at", "updated_at", "cooldown_until") if c in managed.columns])
    return managed.orderBy(newest.desc(), "incident_id").limit(limit)


def find_by_id(incidents: DataFrame | None, requests: DataFrame, wanted: str) -> DataFrame:
    """The row with that incident, event or stored id; incidents come before requests."""
    def hits(df: DataFrame, base: int) -> DataFrame:
        rank = F
        for i, name in enumerate(n for n in ("incident_id", "event_id", "_id") if n in df.columns):
            rank = rank.when(F.col(name).cast("string") == wanted, F.lit(base + i))
        ranked = df.withColumn("_rank", rank.otherwise(F.lit(None).cast("int"))).where("_rank is not null")
        first = ranked.orderBy("_rank").limit(1)
        return analyst_rows(first.drop("_rank")).withColumn("_p", F.lit(base))

    rows = hits(requests, 10)
    if incidents is not None:
        rows = hits(incidents, 0).unionByName(rows, allowMissingColumns=True)
    return rows.orderBy("_p").limit(1).drop("_p")


def baseline_snapshot(requests: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """Baselines, floors and the 24-hour comparison."""
    baselines = attack_baselines(requests)
    return {
        "baselines": baselines.orderBy("hour_of_week", "endpoint_group"),
        "endpoint_floors": endpoint_min_floors(requests).orderBy("endpoint_group"),
        "comparison_last_24h": baseline_comparison_24h(requests, baselines, now),
    }


def incident_detail(row: DataFrame, patterns: DataFrame, k: int = 3) -> DataFrame:
    """Analyst row with its nearest patterns, recommendations and explanation."""
    matches = match_rows(knn(row.select(F.col("event_id").alias("pattern_id"), "embedding"), patterns, k, "pattern_id"), patterns)
    found = matches.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "pattern_id", "attack_type", "name", "severity", "score", "remediation"))).alias("patterns"))
    joined = row.join(found, F.col("event_id") == F.col("query_id"), "left").drop("query_id")
    remedy = F.get(F.filter(F.transform("patterns", lambda p: p["remediation"]), lambda r: F.size(r) > 0), F.lit(0))
    return joined.select("*", recommendations(F.col("attack_type"), F.coalesce(remedy, F.array().cast("array<string>"))).alias("recommendations"),
                         explanation().alias("explanation"))
