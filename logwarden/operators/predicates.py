"""Row predicates over flat or nested request tables."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.functions.columns import field, path_col, pick

# Labels and attack types that decide the predicates.
ML_ATTACK_LABELS = ["malicious", "suspicious", "attack"]
ROW_ATTACK_LABELS = ["malicious", "suspicious", "attack", "attacker", "anomaly", "anomalous"]
NO_ATTACK_TYPES = ["", "Unknown", "unknown", "normal", "benign"]
NO_ATTACK_TYPES_ROW = ["unknown", "", "none", "normal", "benign"]
HIGH_WORDS = ["HIGH", "CRITICAL"]
RISK_MALICIOUS, RISK_HIGH, RISK_ALERT = 70, 80, 80


def _yes(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False))


def _any(terms: list[Column]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | _yes(t)
    return out


def _named_attack(c: Column) -> Column:
    return c.isNotNull() & ~c.isin(NO_ATTACK_TYPES)


def is_malicious(df: DataFrame) -> Column:
    """Stored rows: any of six signs."""
    return _any([
        field(df, "ml_label").isin(ML_ATTACK_LABELS),
        field(df, "ml_should_alert"),
        field(df, "should_alert"),
        _named_attack(field(df, "attack_type", "string")),
        _named_attack(field(df, "ml_attack_type", "string")),
        field(df, "risk_score", "double") >= RISK_MALICIOUS,
    ])


def is_malicious_wide(df: DataFrame) -> Column:
    """As ``is_malicious`` but flat and nested fields each count, where both exist."""
    def both(flat: str, nested: str) -> list[Column]:
        return [c for c in (path_col(df, flat), path_col(df, nested)) if c is not None]

    terms: list[Column] = []
    for c in both("ml_label", "detection.ml.label") + both("prediction.label", "prediction.label")[:1]:
        terms.append(c.isin(ML_ATTACK_LABELS))
    terms += both("ml_should_alert", "detection.ml.should_alert") + both("should_alert", "scoring.should_alert")
    for c in both("attack_type", "detection.rules.attack_type") + both("ml_attack_type", "detection.ml.attack_type"):
        terms.append(_named_attack(c.cast("string")))
    for c in both("risk_score", "scoring.risk_score"):
        terms.append(c.cast("double") >= RISK_MALICIOUS)
    return _any(terms)


def row_label(df: DataFrame) -> Column:
    raw = F.lower(F.trim(F.coalesce(field(df, "final_label", "string"), field(df, "ml_label", "string"),
                                    pick(df, "label").cast("string"))))
    return F.coalesce(F.nullif(raw, F.lit("")), F.lit("unknown"))


def row_attack_type(df: DataFrame) -> Column:
    raw = F.trim(F.coalesce(F.nullif(field(df, "attack_type", "string"), F.lit("")), field(df, "ml_attack_type", "string")))
    return F.coalesce(F.nullif(raw, F.lit("")), F.lit("Unknown"))


def is_malicious_row(df: DataFrame) -> Column:
    """Single-row form used by analysts: label, attack type or risk."""
    return _any([
        row_label(df).isin(ROW_ATTACK_LABELS),
        ~F.lower(row_attack_type(df)).isin(NO_ATTACK_TYPES_ROW),
        field(df, "risk_score", "double") >= RISK_MALICIOUS,
    ])


def is_alerting(df: DataFrame) -> Column:
    return _any([field(df, "should_alert"), field(df, "final_label").isin("malicious", "suspicious")])


def is_high_severity(df: DataFrame) -> Column:
    words = [path_col(df, p) for p in ("severity", "risk_level", "scoring.risk_level", "rule_severity",
                                       "detection.rules.severity")]
    terms = [c.isin([*HIGH_WORDS, *[w.lower() for w in HIGH_WORDS]]) for c in words if c is not None]
    return _any([*terms, field(df, "risk_score", "double") >= RISK_HIGH])


def should_alert_incident(df: DataFrame, threshold: int = RISK_ALERT) -> Column:
    risk = pick(df, "risk_score", "score", "final_score", "rule_score", skip_blank=True).try_cast("double")
    severity = pick(df, "severity", "risk_level", "rule_severity", skip_blank=True)
    return _any([risk >= threshold, F.upper(F.trim(severity.cast("string"))).isin(HIGH_WORDS)])


def timeframe_delta(timeframe: str | None) -> timedelta | None:
    """``Nm``, ``Nh`` or ``Nd``; ``all`` and unreadable text mean no limit."""
    m = re.fullmatch(r"\s*(-?\d+)\s*([mhd])\s*", (timeframe or "").lower())
    if not m:
        return None
    return timedelta(**{{"m": "minutes", "h": "hours", "d": "days"}[m[2]]: int(m[1])})


def cutoff(timeframe: str | None, now: datetime) -> datetime | None:
    delta = timeframe_delta(timeframe)
    return None if delta is None else now - delta


def since(ts: Column, start: datetime | None) -> Column:
    """Literal comparison, so the scan can push it down and prune partitions."""
    return F.lit(True) if start is None else ts >= F.lit(start).cast("timestamp_ntz")


def in_range(ts: Column, start: datetime, end: datetime) -> Column:
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))


def timeframe_windows(timeframe: str | None, now: datetime) -> dict | None:
    """Current window ``[start, now)``, the one before it, and its label."""
    delta = timeframe_delta(timeframe)
    if not delta:
        return None
    n, unit = re.fullmatch(r"(-?\d+)([mhd])", timeframe.lower().strip()).groups()
    word = {"m": "minute", "h": "hour", "d": "day"}[unit]
    label = f"last {word}" if int(n) == 1 else f"last {int(n)} {word}s"
    start = now - delta
    return {"start": start, "end": now, "prev_start": start - delta, "prev_end": start, "label": label}


def similar_enough(score: Column, threshold: float = 0.90) -> Column:
    return score >= threshold


def usable_for_evaluation(text: Column, label: Column) -> Column:
    return _yes((F.length(text) > 0) & (F.length(label) > 0) & (label != "unknown"))


def assert_same_rows(features: DataFrame, upstream: DataFrame, allow_partial: bool = False) -> DataFrame:
    """``features`` unchanged; raises when it has fewer or more rows than its source."""
    if not allow_partial:
        n, m = features.count(), upstream.count()
        if n != m:
            raise ValueError(f"feature table is incomplete: {n} rows, source has {m}")
    return features


def missing_key_count(df: DataFrame, key: str = "event_id") -> DataFrame:
    """How many rows an upsert would leave out for lack of a key."""
    missing = F.col(key).isNull() | (F.col(key).cast("string") == "")
    return df.agg(F.count_if(missing).alias("rows_without_key"), F.count_if(~missing).alias("rows_with_key"))
