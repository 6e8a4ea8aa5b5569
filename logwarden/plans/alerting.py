"""An alert batch from correlation to action in one call."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame

from logwarden.operators.incidents import (
    baseline_gate, correlate, gate_incidents, incident_scores, incident_vectors, suppressed_incidents,
)
from logwarden.operators.lifecycle import COOLDOWN_MINUTES, batch_actions, managed_incidents, process_incidents
from logwarden.operators.vectors import false_positive_matches
from logwarden.session import materialize


class AlertBatch(NamedTuple):
    """Written tables of one batch: each correlated incident with its decision, what was done with
    it, and the incidents to store (those that passed, and the suppressed ones as resolved)."""

    gated: DataFrame
    actions: DataFrame
    managed: DataFrame
    suppressed: DataFrame


def process_alert_batch(alerts: DataFrame, requests: DataFrame | None = None, now: datetime | None = None, baselines: DataFrame | None = None,
                        floors: DataFrame | None = None, known: DataFrame | None = None, active: DataFrame | None = None,
                        window_minutes: int = 5, sigma: float = 3.0, min_floor: int = 50, threshold: int = 80, similarity: float = 0.90,
                        cooldown_minutes: int = COOLDOWN_MINUTES, stored_hours: int = 1, **limits: int) -> AlertBatch:
    """Correlates alerts and passes the incidents through severity, baseline and false-positive gates and the lifecycle.

    The baseline gate compares the larger of the batch's count and that of the last ``stored_hours`` of
    ``requests`` before ``now``. ``known`` holds false positives (incident_id, embedding, notes); incidents are compared by the first vector of
    their alerts (column ``embedding``), if there is one. ``active`` holds open incidents of earlier batches, see ``process_incidents``.
    """
    incidents = materialize(correlate(alerts, window_minutes, **limits), "incidents")
    gate = baseline_gate(alerts, incidents, requests, now, baselines, floors, window_minutes, sigma, min_floor, stored_hours)
    matched = None
    if known is not None and "embedding" in alerts.columns:
        vectors = incidents.join(incident_vectors(alerts, window_minutes), ["source_ip", "window_start"])
        matched = false_positive_matches(vectors, known, similarity)
    gated = materialize(gate_incidents(alerts, incidents, gate, matched, threshold), "gated")
    passed = gated.where("decision = 'pass'")
    done = materialize(process_incidents(passed, incident_scores(alerts, window_minutes), active, cooldown_minutes), "actions")
    return AlertBatch(gated, batch_actions(gated, done), managed_incidents(done, passed), suppressed_incidents(gated))
