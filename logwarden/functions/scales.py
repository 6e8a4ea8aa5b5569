"""Severity and label scales. Three severity scales exist and stay separate."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Attack types that mean none.
BENIGN_WORDS = ["unknown", "none", "normal", "benign"]

# Order of severities.
SEVERITY_RANK = {"none": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}


def _ladder(score: Column, steps: list[tuple[int, str]], last: str) -> Column:
    out = F
    for limit, name in steps:
        out = out.when(score >= limit, F.lit(name))
    return out.otherwise(F.lit(last))


def label_of(score: Column, suspicious: int = 25, malicious: int = 70) -> Column:
    return _ladder(score, [(malicious, "malicious"), (suspicious, "suspicious")], "benign")


def risk_level(score: Column) -> Column:
    return _ladder(score, [(90, "critical"), (70, "high"), (40, "medium"), (25, "low")], "none")


def incident_severity(score: Column) -> Column:
    return _ladder(score, [(90, "critical"), (70, "high"), (40, "medium")], "low")


def analyst_severity(score: Column) -> Column:
    return _ladder(score, [(90, "critical"), (75, "high"), (50, "medium"), (1, "low")], "unknown")


def severity_rank(name: Column) -> Column:
    n = F.lower(F.trim(name))
    out = F
    for word, rank in SEVERITY_RANK.items():
        out = out.when(n == word, F.lit(rank))
    return out.otherwise(F.lit(0))


def severity_name(rank: Column) -> Column:
    names = F.array(*[F.lit(w) for w in SEVERITY_RANK])
    return F.element_at(names, F.greatest(F.lit(0), F.least(rank, F.lit(4))) + 1)


def clean_attack_type(c: Column) -> Column:
    """Attack type text, NULL when blank or a benign word."""
    t = F.trim(c)
    return F.when((t != "") & ~F.lower(t).isin(BENIGN_WORDS), t)
