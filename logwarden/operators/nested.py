"""Flat request rows to the nested stored document and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.functions.columns import has_path
from logwarden.schema import FEATURE_PREFIX, SCHEMA_VERSION

# Nested field <- flat names, first present wins.
TOP_LEVEL = ["_id", "event_id", "timestamp", "server_type", "line_number", "parse_status",
             "flags", "physical_line_range"]
REQUEST = {
    "source_ip": ["source_ip", "ip", "client_ip"],
    "method": ["http_method", "method", "request_http_method"],
    "uri": ["uri", "original_url", "url", "request_http_request"],
    "query_string": ["query_string", "query"],
    "status_code": ["status_code", "response_http_status_code"],
    "response_size": ["response_size", "response_content_length"],
    "user_agent": ["user_agent", "request_user_agent"],
    "raw_log": ["raw_log", "raw", "line"],
}
PREPROCESSED = ["normalized_uri", "normalized_query_string", "normalized_user_agent", "normalized_request"]
DECODE = {
    "depth": ["decode_depth"], "changed": ["decode_changed"],
    "depth_uri": ["decode_depth_uri"], "changed_uri": ["decode_changed_uri"],
    "depth_query": ["decode_depth_query_string", "decode_depth_query"],
    "changed_query": ["decode_changed_query_string", "decode_changed_query"],
    "limit_reached": ["decode_limit_reached"], "removed_control_chars": ["removed_control_chars"],
}
RULES = {"score": ["rule_score"], "severity": ["rule_severity"], "matched_ids": ["matched_rule_ids"],
         "matched_rules": ["matched_rules"], "attack_type": ["attack_type"]}
ML = {"label": ["ml_label"], "attack_type": ["ml_attack_type"],
      "probability": ["ml_attack_probability"], "should_alert": ["ml_should_alert"]}
SCORING = ["risk_score", "risk_bonus", "risk_level", "final_label", "should_alert",
           "detection_method", "detection_sources", "primary_signal", "risk_input_scores"]


def _struct(df: DataFrame, spec: dict[str, list[str]]) -> list[Column]:
    out = []
    for name, sources in spec.items():
        found = [F.col(s) for s in sources if s in df.columns]
        if found:
            out.append((F.coalesce(*found) if len(found) > 1 else found[0]).alias(name))
    return out


def feature_vector_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(FEATURE_PREFIX)
            and c not in ("feature_version", "feature_names")]


def flat_to_nested(df: DataFrame) -> DataFrame:
    """Stored layout of flat rows; a table that is nested already comes back unchanged."""
    if has_path(df.schema, "request.uri") or has_path(df.schema, "scoring.risk_score"):
        return df
    out = [F.lit(SCHEMA_VERSION).alias("_schema_version")]
    out += [F.col(c) for c in TOP_LEVEL if c in df.columns]

    def add(name: str, fields: list[Column]) -> None:
        if fields:
            out.append(F.struct(*fields).alias(name))

    add("request", _struct(df, REQUEST))
    decode = _struct(df, DECODE)
    pre = _struct(df, {c: [c] for c in PREPROCESSED})
    add("preprocessed", pre + ([F.struct(*decode).alias("decode")] if decode else []))
    vector = feature_vector_columns(df)
    features = [F.col("feature_version").alias("version")] if "feature_version" in df.columns else []
    if vector:
        keys = F.array(*[F.lit(c[len(FEATURE_PREFIX):]) for c in vector])
        features.append(F.map_from_arrays(keys, F.array(*[F.col(c).cast("double") for c in vector])).alias("vector"))
    add("features", features)
    rules, ml = _struct(df, RULES), _struct(df, ML)
    add("detection", ([F.struct(*rules).alias("rules")] if rules else []) + ([F.struct(*ml).alias("ml")] if ml else []))
    add("scoring", _struct(df, {c: [c] for c in SCORING}))
    if "embedding" in df.columns:
        out.append(F.col("embedding"))
    return df.select(*out)


def nested_to_flat(df: DataFrame, feature_names: list[str] | None = None) -> DataFrame:
    """Flat columns of the nested layout; features named in ``feature_names`` become columns."""
    out: dict[str, Column] = {}
    roots = {"request", "preprocessed", "features", "detection", "scoring", "_schema_version"}
    for c in df.columns:
        if c not in roots:
            out[c] = F.col(c)

    def take(flat: str, path: str) -> None:
        if has_path(df.schema, path):
            out[flat] = F.col(path)

    for name, sources in REQUEST.items():
        take(sources[0], f"request.{name}")
    take("ip", "request.source_ip")
    take("method", "request.method")
    take("raw", "request.raw_log")
    for name in PREPROCESSED:
        take(name, f"preprocessed.{name}")
    for name, sources in DECODE.items():
        take(sources[0], f"preprocessed.decode.{name}")
    take("feature_version", "features.version")
    if has_path(df.schema, "features.vector"):
        for name in feature_names or []:
            out[FEATURE_PREFIX + name] = F.try_element_at("features.vector", F.lit(name))
    for name, sources in RULES.items():
        take(sources[0], f"detection.rules.{name}")
    for name, sources in ML.items():
        take(sources[0], f"detection.ml.{name}")
    if "scoring" in df.columns:
        for name in df.schema["scoring"].dataType.fieldNames():
            take(name, f"scoring.{name}")
    return df.select(*[c.alias(n) for n, c in out.items()])
