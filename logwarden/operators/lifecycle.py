"""Incident lifecycle per address: new alert, merge during cooldown, escalation.

The only sequential part of the system. Spark partitions by address and sorts by
window; the fold below then streams over the rows, holding one address's open
incident at a time. Its evidence is held as the one endpoint group that decides the
score: the most sensitive one, the earliest of equal ones, with its best score. Events
of a later window can only raise that score or bring a more sensitive group, so nothing
else has to be kept, however many events an incident has.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from hashlib import md5

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from logwarden.functions.scales import SEVERITY_RANK

COOLDOWN_MINUTES = 30
EVIDENCE_TYPE = "array<struct<ts:timestamp_ntz,event_id:string,grp:string,score:double>>"
OUTPUT = ("correlation_id string, source_ip string, window_start timestamp_ntz, incident_id string, action string, "
          "reason string, severity string, max_risk_score double, cooldown_until timestamp_ntz")
_PRIORITY = {"sensitive": 0, "root": 3}


Evidence = list[tuple[str, str, float]]  # event id, endpoint group, score; oldest first


@dataclass
class Lead:
    """The endpoint group that decides an incident's score, and the best score in it."""

    rank: int
    group: str
    score: float


@dataclass
class OpenIncident:
    incident_id: str
    severity: str
    cooldown_until: datetime
    lead: Lead | None = None


def sensitivity(group: str) -> int:
    return 1 if group.startswith("api") else _PRIORITY.get(group, 2)


def extend(lead: Lead | None, evidence: Evidence) -> Lead | None:
    """The lead after later evidence, which may have one entry per event or one per group with its best score.

    Extending by two lists one after the other is extending by both together.
    """
    for _, group, score in evidence:
        rank = sensitivity(group)
        if lead is None or rank < lead.rank:
            lead = Lead(rank, group, score)
        elif group == lead.group and score > lead.score:
            lead = Lead(rank, group, score)
    return lead


def priority_score(evidence: Evidence) -> float:
    """Best score in the most sensitive endpoint group; the earliest of equal groups."""
    lead = extend(None, evidence)
    return lead.score if lead else 0.0


def severity_for(score: float) -> str:
    return "critical" if score >= 90 else "high" if score >= 70 else "medium" if score >= 40 else "low"


def advance(state: OpenIncident | None, row: dict, cooldown: timedelta) -> tuple[OpenIncident, dict]:
    """Next open incident of the address and the action taken for one correlated incident."""
    now, incoming = row["window_start"], row["severity"]
    if state is None or state.cooldown_until <= now:
        new_id = f"INC-{now:%Y%m%d}-{md5(row['correlation_id'].encode()).hexdigest()[:12].upper()}"
        opened = OpenIncident(new_id, incoming, now + cooldown, extend(None, row["evidence"]))
        return opened, {"action": "NEW_ALERT", "risk": row["max_risk_score"],
                        "reason": "Created new incident and entered cooldown"}
    lead = extend(state.lead, row["evidence"])
    risk = lead.score if lead else 0.0
    merged = severity_for(risk)
    escalated = SEVERITY_RANK[incoming] > SEVERITY_RANK[state.severity]
    if escalated:
        final = max(merged, incoming, key=SEVERITY_RANK.get)
        result = {"action": "NEW_ALERT", "risk": risk,
                  "reason": f"Severity escalation ({state.severity} -> {incoming}) during cooldown"}
    else:
        final = merged
        result = {"action": "MERGED", "risk": risk,
                  "reason": f"Merged into active incident {state.incident_id} during cooldown"}
    return OpenIncident(state.incident_id, final, now + cooldown, lead), result


def evidence_tuples(items: Iterable) -> Evidence:
    return [(e["event_id"], e["grp"], float(e["score"])) for e in (items if items is not None else [])]


def output_row(row: dict, state: OpenIncident, result: dict) -> dict:
    return {
        "correlation_id": row["correlation_id"], "source_ip": row["source_ip"], "window_start": row["window_start"],
        "incident_id": state.incident_id, "action": result["action"], "reason": result["reason"],
        "severity": state.severity, "max_risk_score": float(result["risk"]), "cooldown_until": state.cooldown_until,
    }


def _fold(cooldown: timedelta, keep_evidence: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        address, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if row["source_ip"] != address:
                    address, state = row["source_ip"], None
                row["evidence"] = evidence_tuples(row["evidence"])
                if row["is_state"]:
                    state = OpenIncident(row["incident_id"], row["severity"], row["window_start"], extend(None, row["evidence"]))
                    continue
                state, result = advance(state, row, cooldown)
                done = output_row(row, state, result)
                if keep_evidence:
                    lead = [state.lead] if state.lead else []
                    done["evidence"] = [{"ts": None, "event_id": None, "grp": held.group, "score": held.score} for held in lead]
                out.append(done)
            if out:
                yield pd.DataFrame(out)

    return run


def process_incidents(incidents: DataFrame, evidence: DataFrame, active: DataFrame | None = None,
                      cooldown_minutes: int = COOLDOWN_MINUTES, keep_evidence: bool = False) -> DataFrame:
    """Action and resulting incident state for every correlated incident, in window order.

    ``evidence`` is what ``incident_scores`` gives: per address and window the most sensitive groups
    with their best scores. ``keep_evidence`` adds the state's evidence, the deciding group, to go on from.
    ``active`` carries open incidents of earlier runs: ``source_ip, incident_id, severity,
    cooldown_until, evidence``. Event time drives the cooldown.
    """
    rows = incidents.join(evidence, ["source_ip", "window_start"], "left").select(
        "source_ip", "window_start", "correlation_id", "severity", F.col("max_risk_score").cast("double").alias("max_risk_score"),
        F.col("evidence").cast(EVIDENCE_TYPE).alias("evidence"), F.lit(None).cast("string").alias("incident_id"),
        F.lit(False).alias("is_state"), F.lit(1).alias("_order"))
    if active is not None:
        rows = rows.unionByName(active.select(
            "source_ip", F.col("cooldown_until").cast("timestamp_ntz").alias("window_start"), F.lit(None).cast("string").alias("correlation_id"), "severity",
            F.lit(0.0).alias("max_risk_score"), F.col("evidence").cast(EVIDENCE_TYPE).alias("evidence"), "incident_id",
            F.lit(True).alias("is_state"), F.lit(0).alias("_order")))
    ordered = rows.repartition("source_ip").sortWithinPartitions("source_ip", "_order", "window_start").drop("_order")
    schema = OUTPUT + (f", evidence {EVIDENCE_TYPE}" if keep_evidence else "")
    return ordered.mapInPandas(_fold(timedelta(minutes=cooldown_minutes), keep_evidence), schema)


def managed_incidents(actions: DataFrame, incidents: DataFrame) -> DataFrame:
    """Stored incidents: latest state, union of types, summed evidence."""
    facts = actions.select("correlation_id", "incident_id", "source_ip", "window_start", "severity",
                           "max_risk_score", "cooldown_until").join(
        incidents.select("correlation_id", "title", "behavior_type", "attack_types", "evidence_count"), "correlation_id")
    types = (
        facts.select("incident_id", F.explode("attack_types").alias("t")).distinct()
        .groupBy("incident_id").agg(F.array_sort(F.collect_set("t")).alias("attack_types"))
    )
    last = F.max(F.struct("window_start", "severity", "max_risk_score", "cooldown_until"))
    first = F.min(F.struct("window_start", "correlation_id", "title", "behavior_type"))
    rows = facts.groupBy("incident_id", "source_ip").agg(
        first.alias("f"), last.alias("l"), F.sum("evidence_count").alias("evidence_count"),
        F.count(F.lit(1)).alias("windows"))
    return rows.join(types, "incident_id", "left").select(
        "incident_id", F.col("f.correlation_id").alias("correlation_id"), F.col("f.title").alias("title"),
        F.col("f.behavior_type").alias("behavior_type"), F.array("source_ip").alias("source_ips"),
        F.coalesce("attack_types", F.array().cast("array<string>")).alias("attack_types"),
        "evidence_count", "windows", F.col("l.max_risk_score").alias("max_risk_score"),
        F.col("l.severity").alias("severity"), F.lit("cooldown").alias("status"),
        F.col("l.cooldown_until").alias("cooldown_until"), F.col("f.window_start").alias("created_at"),
        F.col("l.window_start").alias("updated_at"), F.lit(True).alias("alert_sent"),
    )


def batch_actions(gated: DataFrame, actions: DataFrame) -> DataFrame:
    """One action per correlated incident: suppressed by a gate, or what the lifecycle did."""
    suppressed = gated.where("decision <> 'pass'").select(
        "correlation_id", F.lit("SUPPRESSED").alias("action"), F.col("correlation_id").alias("incident_id"), "reason")
    return suppressed.unionByName(actions.select("correlation_id", "action", "incident_id", "reason"))


def mark_false_positive(incidents: DataFrame, incident_id: str, notes: str, now: datetime) -> tuple[DataFrame, DataFrame]:
    """The incident table with one incident resolved, and its false-positive row to upsert.

    The vector is the incident's own or the first one among its evidence.
    """
    hit = F.col("incident_id") == incident_id
    own = F.col("embedding") if "embedding" in incidents.columns else F.lit(None).cast("array<float>")
    evidence_type = incidents.schema["evidence"].dataType.simpleString() if "evidence" in incidents.columns else ""
    if "embedding:" in evidence_type:
        first = F.get(F.filter("evidence", lambda e: e["embedding"].isNotNull() & (F.size(e["embedding"]) > 0)), F.lit(0))
        own = F.coalesce(F.when(F.size(own) > 0, own), first["embedding"])
    vector = F.when(F.size(own) > 0, own)
    row = incidents.where(hit & vector.isNotNull()).limit(1).select(
        F.lit(incident_id).alias("incident_id"), F.lit(notes).alias("notes"), vector.alias("embedding"),
        F.lit(now).cast("timestamp_ntz").alias("created_at"),
        F.coalesce(F.col("title"), F.lit("False Positive")).alias("title"),
        F.coalesce(F.col("behavior_type"), F.lit("unknown")).alias("attack_type"))
    changes = {"status": "resolved", "resolution": "false_positive", "resolution_notes": notes}
    usable = hit & vector.isNotNull()
    updated = incidents.withColumns({
        name: F.when(usable, F.lit(value)).otherwise(F.col(name) if name in incidents.columns else F.lit(None).cast("string"))
        for name, value in changes.items()})
    return updated, row
