"""The whole log-to-verdict flow as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logwarden.operators.features import extract_features, feature_columns
from logwarden.operators.ml import predict
from logwarden.operators.normalize import normalize
from logwarden.operators.parse import parse_by_server, parse_log
from logwarden.operators.preprocess import preprocess
from logwarden.operators.risk import score_risk
from logwarden.operators.rules import detect
from logwarden.session import materialize, spread


def analyze_normalized(normalized: DataFrame, rules: list[dict] | None = None, models: tuple | None = None,
                       threshold: float = 0.5) -> DataFrame:
    """Normalized requests to scored requests; narrow projections only, so one stage."""
    detected = detect(extract_features(preprocess(normalized)), rules)
    if models is not None:
        binary, attack_type = models[0], models[1]
        detected = predict(detected, binary, attack_type, feature_columns(detected), threshold)
    return score_risk(detected)


def analyze_lines(lines: DataFrame, server_type: str | None = None, rules: list[dict] | None = None,
                  models: tuple | None = None, namespace: str | None = None) -> DataFrame:
    """Log lines (``line``, ``line_number``, ``file``) to scored requests.

    Apache and Nginx lines stay one lazy plan. W3C lines need joins to carry their headers,
    so such parsed records are staged first: the optimizer derives conditions from joins
    through every later projection, which a plan this wide cannot afford. What is staged is dealt
    out again: a few small files, however many rows, would leave the scoring to a few tasks.
    """
    if server_type and server_type.lower() != "iis":
        parsed = parse_log(lines, server_type, namespace=namespace)
    elif server_type:
        parsed = spread(materialize(parse_log(lines, server_type, namespace=namespace), "parsed"), "file", "line_number")
    else:
        parsed = spread(materialize(parse_by_server(lines, namespace=namespace), "parsed"), "file", "line_number")
    return analyze_normalized(normalize(parsed), rules, models)


def alerts_of(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("should_alert"))
