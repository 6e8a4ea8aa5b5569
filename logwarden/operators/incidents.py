"""Correlation of alerts into incidents and the alert gates.

An incident row holds bounded columns only. Its events, endpoints and endpoint
groups are separate tables keyed by ``correlation_id``.
"""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logwarden.functions.columns import field, pick
from logwarden.functions.scales import incident_severity
from logwarden.functions.text import any_timestamp, endpoint_group, hour_of_week
from logwarden.operators.aggregates import alerting_group_counts, group_counts
from logwarden.operators.baselines import above_baseline, with_baseline
from logwarden.operators.ranks import top_k_per_group
from logwarden.session import materialize

# Behaviour thresholds and the evidence limit of a stored incident.
RECON_ENDPOINTS, BRUTE_FORCE_EVENTS, MULTI_VECTOR_TYPES = 5, 15, 2
EVIDENCE_LIMIT = 100
# Smallest time bucket of the overlap join.
BUCKET_MINUTES = 30
HIGH_SEVERITIES = ["high", "critical"]

# Incident titles.
TITLES = {
    "reconnaissance": "Broad reconnaissance from IP ",
    "brute_force": "Brute-force burst from IP ",
    "multi_vector": "Multi-vector attack from IP ",
}


def group_priority(group: Column) -> Column:
    """0 sensitive, 1 api, 2 other, 3 root; lower is more sensitive."""
    return (
        F.when(group == "sensitive", 0).when(group.startswith("api"), 1).when(group == "root", 3).otherwise(2)
    )


def alert_events(alerts: DataFrame, window_minutes: int = 5) -> DataFrame:
    """Alerts with address, window, URI, attack type and score under fixed names."""
    ts = pick(alerts, "timestamp", "ts", "event_time")
    kind = alerts.select(ts.alias("t")).schema["t"].dataType.simpleString()
    if kind == "string":
        ts = any_timestamp(ts)
    uri = F.coalesce(F.nullif(field(alerts, "uri", "string"), F.lit("")), pick(alerts, "original_url").cast("string"), F.lit(""))
    score = F.coalesce(F.nullif(field(alerts, "risk_score", "double"), F.lit(0.0)),
                       pick(alerts, "score").cast("double"), F.lit(0.0))
    kind_of = F.coalesce(F.nullif(field(alerts, "attack_type", "string"), F.lit("")),
                         pick(alerts, "category").cast("string"), F.lit(""))
    events = alerts.select(
        F.coalesce(F.nullif(field(alerts, "source_ip", "string"), F.lit("")), F.lit("unknown_ip")).alias("source_ip"),
        ts.cast("timestamp_ntz").alias("ts"), pick(alerts, "event_id", "_id").alias("event_id"),
        uri.alias("uri"), kind_of.alias("attack_type"), score.alias("score"),
        *[F.col(c) for c in ("embedding", "is_mark") if c in alerts.columns],
    )
    return events.withColumns({
        "window_start": F.window("ts", f"{window_minutes} minutes").start,
        "endpoint_group": endpoint_group(F.col("uri")),
    })


def correlate(alerts: DataFrame, window_minutes: int = 5, recon: int = RECON_ENDPOINTS,
              brute_force: int = BRUTE_FORCE_EVENTS, multi_vector: int = MULTI_VECTOR_TYPES) -> DataFrame:
    """One incident per address and time window. Runs one job to count the events.

    Events are first counted per (address, window, group, URI, type): a flood from one
    address shrinks before it is shuffled, and the distinct URI count is split by URI.
    """
    events = alert_events(alerts, window_minutes)
    key = ["source_ip", "window_start"]
    named = (F.col("attack_type") != "") & ~F.lower("attack_type").isin("normal", "benign")
    base = events.groupBy(*key, "endpoint_group", "uri", F.when(named, F.col("attack_type")).alias("attack_type")).agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("top"), F.min(F.struct("ts", "event_id")).alias("first"))
    # Three aggregates follow; written once so the alerts are read once.
    base = materialize(base, "correlation")

    facts = base.groupBy(*key).agg(
        F.sum("n").alias("evidence_count"),
        F.count_distinct(F.nullif(F.col("uri"), F.lit(""))).alias("endpoint_count"),
        F.min(F.when(F.col("attack_type").isNotNull(), F.struct("first", "attack_type")))["attack_type"].alias("first_type"),
    )
    types = base.where("attack_type is not null").groupBy(*key, "attack_type").agg(F.lit(1).alias("x")).groupBy(*key).agg(
        F.array_sort(F.collect_set("attack_type")).alias("attack_types"))
    # Risk: best score inside the most sensitive group; equal groups by first event.
    per_group = base.groupBy(*key, "endpoint_group").agg(F.max("top").alias("top"), F.min("first").alias("first"))
    risk = per_group.groupBy(*key).agg(F.min(F.struct(
        group_priority(F.col("endpoint_group")).alias("p"), "first", "top"))["top"].alias("max_risk_score"))

    joined = facts.join(types, key, "left").join(risk, key)
    joined = joined.withColumn("attack_types", F.coalesce("attack_types", F.array().cast("array<string>")))
    return describe_incidents(joined, window_minutes, recon, brute_force, multi_vector)


def describe_incidents(facts: DataFrame, window_minutes: int = 5, recon: int = RECON_ENDPOINTS, brute_force: int = BRUTE_FORCE_EVENTS,
                       multi_vector: int = MULTI_VECTOR_TYPES, keep: list[str] | None = None) -> DataFrame:
    """Behaviour, id, title and severity of counted address windows, of a batch or of a stream.

    ``facts`` has source_ip, window_start, evidence_count, endpoint_count, first_type, attack_types and max_risk_score.
    """
    behaviour = (
        F.when(F.col("endpoint_count") >= recon, "reconnaissance")
        .when(F.col("evidence_count") >= brute_force, "brute_force")
        .when(F.size("attack_types") >= multi_vector, "multi_vector").otherwise("single")
    )
    joined = facts.withColumn("behavior_type", behaviour)
    stamp = F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    title = F
    for name, text in TITLES.items():
        title = title.when(F.col("behavior_type") == name, F.concat(F.lit(text), F.col("source_ip")))
    title = title.otherwise(F.concat(F.coalesce("first_type", F.lit("Security anomaly")), F.lit(" activity from IP "), F.col("source_ip")))
    return joined.select(
        F.concat(F.lit("corr-"), F.substring(F.md5(F.concat_ws(":", "source_ip", stamp, "behavior_type")), 1, 12)).alias("correlation_id"),
        title.alias("title"), "behavior_type", "source_ip", "attack_types", "evidence_count", "endpoint_count",
        "max_risk_score", incident_severity(F.col("max_risk_score")).alias("severity"), "window_start",
        (F.col("window_start") + F.expr(f"INTERVAL {window_minutes} MINUTE")).alias("window_end"), *(keep or []),
    )


def incident_events(alerts: DataFrame, incidents: DataFrame, window_minutes: int = 5) -> DataFrame:
    """Event rows of each incident."""
    return alert_events(alerts, window_minutes).join(
        incidents.select("correlation_id", "source_ip", "window_start"), ["source_ip", "window_start"])


def incident_endpoints(alerts: DataFrame, incidents: DataFrame, window_minutes: int = 5) -> DataFrame:
    """Distinct target URIs of each incident as rows."""
    return incident_events(alerts, incidents, window_minutes).where("uri <> ''").groupBy(
        "correlation_id", "uri", "endpoint_group").agg(F.count(F.lit(1)).alias("events"))


def incident_groups(alerts: DataFrame, incidents: DataFrame, window_minutes: int = 5) -> DataFrame:
    """Distinct endpoint groups of each incident; an incident without URIs has ``default``."""
    key = ["source_ip", "window_start"]
    pairs = alert_events(alerts, window_minutes).where("uri <> ''").select(*key, "endpoint_group").distinct()
    return incidents.select("correlation_id", *key).join(pairs, key, "left").select(
        "correlation_id", "window_start", F.coalesce("endpoint_group", F.lit("default")).alias("endpoint_group"))


def incident_evidence(alerts: DataFrame, window_minutes: int = 5, limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """Last ``limit`` events per address and window, oldest first, as a bounded array."""
    events = alert_events(alerts, window_minutes).select(
        "source_ip", "window_start", "ts", "event_id", "endpoint_group", "score")
    kept = top_k_per_group(events, ["source_ip", "window_start"], [F.desc("ts"), F.desc("event_id")], limit, "_rank")
    return kept.groupBy("source_ip", "window_start").agg(F.array_sort(F.collect_list(F.struct(
        "ts", F.col("event_id").cast("string").alias("event_id"), F.col("endpoint_group").alias("grp"), "score"))).alias("evidence"))


def incident_scores(alerts: DataFrame, window_minutes: int = 5) -> DataFrame:
    """What decides the score of each address and window: its most sensitive endpoint groups, in the order
    they were seen, each with its first event and its best score over all events.

    Less sensitive groups never decide, so they are left out. Same form as ``incident_evidence``, but
    with an entry per group instead of one per event, and nothing is cut.
    """
    key = ["source_ip", "window_start"]
    groups = alert_events(alerts, window_minutes).groupBy(*key, "endpoint_group").agg(
        F.max("score").alias("score"), F.min(F.struct("ts", "event_id")).alias("first"))
    ranked = groups.withColumn("rank", group_priority(F.col("endpoint_group")))
    best = ranked.groupBy(*key).agg(F.min("rank").alias("rank"))
    return ranked.join(best, [*key, "rank"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(
        "first.ts", "first.event_id", F.col("endpoint_group").alias("grp"), "score"))).alias("evidence"))


def incident_vectors(alerts: DataFrame, window_minutes: int = 5) -> DataFrame:
    """First event vector of each address and window."""
    events = alert_events(alerts, window_minutes)
    return events.where("embedding is not null and size(embedding) > 0").groupBy("source_ip", "window_start").agg(
        F.min_by("embedding", F.struct("ts", "event_id")).alias("embedding"))


def baseline_gate(alerts: DataFrame, incidents: DataFrame, requests: DataFrame | None = None,
                  now: datetime | None = None, baselines: DataFrame | None = None,
                  floors: DataFrame | None = None, window_minutes: int = 5, sigma: float = 3.0,
                  min_floor: int = 50, stored_hours: int = 1) -> DataFrame:
    """Per incident and endpoint group: the current count against its baseline.

    The count is the larger of this batch and the last ``stored_hours`` of stored requests.
    """
    groups = incident_groups(alerts, incidents, window_minutes)
    batch = group_counts(alerts).withColumnRenamed("count", "_batch")
    counted = groups.join(batch, "endpoint_group", "left")
    if requests is not None:
        stored = alerting_group_counts(requests, now, stored_hours).withColumnRenamed("count", "_stored")
        counted = counted.join(stored, "endpoint_group", "left")
    else:
        counted = counted.withColumn("_stored", F.lit(None).cast("bigint"))
    counted = counted.withColumns({
        "current_count": F.greatest(F.coalesce("_batch", F.lit(0)), F.coalesce("_stored", F.lit(0))),
        "hour_of_week": hour_of_week(F.col("window_start")),
    }).drop("_batch", "_stored")
    return above_baseline(with_baseline(counted, baselines, floors, min_floor), "current_count", sigma)


def gate_incidents(alerts: DataFrame, incidents: DataFrame, gate: DataFrame, false_positives: DataFrame | None = None,
                   threshold: int = 80) -> DataFrame:
    """Incidents with ``decision`` and ``reason``, gates in order: severity, baseline, false positive.

    ``decision`` is ``below_severity``, ``below_baseline``, ``false_positive`` or ``pass``.
    ``false_positives`` holds ``correlation_id, similarity, notes`` of matched incidents.
    """
    passing = gate.groupBy("correlation_id").agg(
        F.bool_or("should_alert").alias("_above"), F.max("deviation_ratio").alias("max_deviation"),
        F.count(F.lit(1)).alias("_groups"))
    out = incidents.join(passing, "correlation_id", "left")
    if false_positives is not None:
        out = out.join(false_positives.select("correlation_id", "similarity", "notes"), "correlation_id", "left")
    else:
        out = out.withColumns({"similarity": F.lit(None).cast("double"), "notes": F.lit(None).cast("string")})
    low = (F.col("max_risk_score") < threshold) & ~F.col("severity").isin(HIGH_SEVERITIES)
    quiet = ~F.coalesce("_above", F.lit(False))
    known = F.col("similarity").isNotNull()
    decision = F.when(low, "below_severity").when(quiet, "below_baseline").when(known, "false_positive").otherwise("pass")
    reason = (
        F.when(low, F.concat(F.lit("Below severity threshold ("), F.format_string("%.1f", "max_risk_score"), F.lit(f" < {threshold})")))
        .when(quiet, F.concat(F.lit("Below dynamic anomaly baseline for "), F.col("_groups").cast("string"), F.lit(" target group(s)")))
        .when(known, F.concat(F.lit("Similarity "), F.format_string("%.3f", "similarity"), F.lit(" with a known false positive ("),
                              F.coalesce("notes", F.lit("matched known false positive pattern")), F.lit(")")))
    )
    return out.withColumns({"decision": decision, "reason": reason}).drop("_above", "_groups")


def suppressed_incidents(gated: DataFrame) -> DataFrame:
    """Incidents stored as resolved: all suppressed ones except those of low severity."""
    return gated.where(F.col("decision").isin("below_baseline", "false_positive")).select(
        "*", F.lit("resolved").alias("status"), F.col("decision").alias("resolution"),
        F.col("reason").alias("resolution_notes"), F.lit(False).alias("alert_sent"))


def _latest_running(batches):
    """Per alert the latest begun cooldown that runs at its time; rows come by bucket and time, cooldowns first.

    A cooldown that ends before a later begun one can't be an answer any more, so a stack of the others is kept: ends
    fall and begins rise to its top, and what has ended is taken from the top.
    """
    key, running = None, []
    for batch in batches:
        alerts, begins, found = [], [], []
        for *group, at, until, incident, alert in zip(*[column.to_pylist() for column in batch.columns]):
            if group != key:
                key, running = group, []
            while running and running[-1][0] <= (at if until is None else until):
                running.pop()
            if until is not None:
                running.append((until, at, incident))
            elif running:
                alerts.append(alert)
                begins.append(running[-1][1])
                found.append(running[-1][2])
        schema = batch.schema
        yield pa.RecordBatch.from_arrays(
            [pa.array(alerts, schema.field("correlation_id").type), pa.array(begins, pa.int64()), pa.array(found, schema.field("incident_id").type)],
            names=["correlation_id", "begun", "incident_id"])


def overlapping_active(incidents: DataFrame, active: DataFrame, now: str = "window_start") -> DataFrame:
    """Each incident with the active stored one that shares an address, had begun by then and still cools down.

    Of several the latest begun (``created_at``) is taken, then the smallest id. Address lists are exploded and
    time is cut into buckets, so a busy address is split. A cooldown is filed in the (at most two) buckets it touches
    of the size that fits its length, buckets doubling from level to level; an incident looks into its bucket of each
    level there is. A bucket is sorted by time and passed over once, so no pairs are formed, however crowded it is.
    """
    def micros(moment: str) -> Column:
        return F.unix_micros(F.col(moment).cast("timestamp"))

    def bucket(moment: str, level: Column) -> Column:
        return F.floor(micros(moment) / (F.lit(BUCKET_MINUTES * 60_000_000) * F.pow(F.lit(2), level))).cast("long")

    minutes = (micros("cooldown_until") - micros("created_at")) / 60_000_000
    right = active.where(F.col("status").isin("open", "cooldown")).where("cooldown_until > created_at").select(
        "incident_id", "created_at", "cooldown_until", F.explode("source_ips").alias("ip"),
        F.greatest(F.lit(0), F.ceil(F.log2(minutes / BUCKET_MINUTES))).cast("int").alias("level"))
    deepest = right.agg(F.max("level").alias("m")).first()["m"] or 0
    right = right.withColumn("bucket", F.explode(F.sequence(bucket("created_at", F.col("level")), bucket("cooldown_until", F.col("level")))))
    left = incidents.select("correlation_id", F.col(now).alias("_now"), F.explode("source_ips").alias("ip"))
    left = left.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest)))).withColumn("bucket", bucket("_now", F.col("level")))
    none = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    keys = ["ip", "level", "bucket"]
    rows = left.select(*keys, micros("_now").alias("at"), F.lit(None).cast("long").alias("until"), none(right, "incident_id"), "correlation_id").unionByName(
        right.select(*keys, micros("created_at").alias("at"), micros("cooldown_until").alias("until"), "incident_id", none(left, "correlation_id")))
    ordered = rows.where("ip is not null and bucket is not null").repartition(*keys).sortWithinPartitions(
        *keys, "at", F.col("until").isNull(), F.desc("incident_id"))
    types = [df.schema[name].dataType.simpleString() for df, name in ((left, "correlation_id"), (right, "incident_id"))]
    latest = ordered.mapInArrow(_latest_running, f"correlation_id {types[0]}, begun long, incident_id {types[1]}")
    return latest.groupBy("correlation_id").agg(
        F.min_by("incident_id", F.struct((-F.col("begun")).alias("t"), "incident_id")).alias("incident_id"))


def action_counts(actions: DataFrame) -> DataFrame:
    """Result counters of one alert batch."""
    return actions.agg(
        F.count(F.lit(1)).alias("correlated_count"),
        F.count_if(F.col("action") == "NEW_ALERT").alias("alert_sent_count"),
        F.count_if(F.col("action") == "MERGED").alias("merged_count"),
        F.count_if(F.col("action") == "SUPPRESSED").alias("suppressed_count"),
    )
