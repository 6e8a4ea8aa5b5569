"""Field lists and stored-document layout."""

from __future__ import annotations

SCHEMA_VERSION = 2
FEATURE_PREFIX = "feature_"
FEATURE_VERSION = "handcrafted_v2"

# HTTP methods and server types accepted in logs.
HTTP_METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "CONNECT", "TRACE"]
SERVER_TYPES = ["apache", "nginx", "iis"]

# Columns of a parsed record.
PARSED_FIELDS = [
    "event_id", "timestamp", "source_ip", "request", "http_method", "raw_uri", "original_url",
    "http_version", "status_code", "response_size", "referrer", "user_agent", "format_profile",
    "extra_tail", "data_line_number", "server_type", "raw_log", "line_number",
    "parse_error", "parse_status", "error_message",
]

# Columns of a normalized record, in order.
COMMON_FIELDS = [
    "event_id", "timestamp", "source_ip", "http_method", "original_url", "raw_uri", "uri",
    "query_string", "fragment", "status_code", "status_code_invalid", "response_size",
    "response_size_missing", "response_size_invalid", "user_agent", "referrer", "server_type",
    "raw_log", "line_number", "parse_status", "parse_error", "parse_error_message",
    "normalize_status", "normalize_errors", "error_message",
]

# Columns added by preprocessing.
PREPROCESS_FIELDS = [
    "decoded_uri", "decoded_query_string", "decoded_user_agent",
    "normalized_uri", "normalized_query_string", "normalized_user_agent",
    "normalized_method", "normalized_url", "normalized_request", "normalized_request_fields",
    "decode_depth_uri", "decode_depth_query_string", "decode_depth_user_agent", "decode_depth",
    "decode_changed_uri", "decode_changed_query_string", "decode_changed_user_agent",
    "decode_changed",
    "decode_limit_reached_uri", "decode_limit_reached_query_string",
    "decode_limit_reached_user_agent", "decode_limit_reached",
    "removed_control_chars_uri", "removed_control_chars_query_string",
    "removed_control_chars_user_agent", "removed_control_chars",
    "preprocess_status", "preprocess_errors",
]

# The numeric feature vector, in order.
FEATURE_NAMES = [
    "uri_length", "query_length", "user_agent_length",
    "param_count", "avg_param_name_length", "avg_param_value_length",
    "uri_special_char_count", "uri_digit_count", "uri_alpha_count", "uri_slash_count",
    "uri_backslash_count", "uri_dot_count", "uri_quote_count", "uri_angle_bracket_count",
    "uri_percent_count", "uri_equals_count", "uri_hyphen_count", "uri_entropy",
    "query_special_char_count", "query_digit_count", "query_alpha_count", "query_slash_count",
    "query_backslash_count", "query_dot_count", "query_quote_count",
    "query_angle_bracket_count", "query_percent_count", "query_equals_count",
    "query_ampersand_count", "query_semicolon_count", "query_hyphen_count", "query_entropy",
    "ua_special_char_count", "ua_digit_count", "ua_alpha_count", "ua_slash_count",
    "ua_dot_count", "ua_quote_count", "ua_percent_count", "ua_hyphen_count", "ua_entropy",
    "status_code_missing", "status_code_invalid", "response_size_missing",
    "response_size_invalid",
    "decode_depth", "decode_changed", "decode_depth_uri", "decode_changed_uri",
    "decode_depth_query", "decode_changed_query", "decode_depth_user_agent",
    "decode_changed_user_agent", "decode_limit_reached", "removed_control_chars",
    "has_sql_keyword", "has_sqli_evasion_pattern", "has_xss_keyword", "has_path_traversal",
    "is_scanner_user_agent",
]

# Flat column name -> place in the nested stored document.
NESTED_PATHS = {
    "source_ip": "request.source_ip",
    "ip": "request.source_ip",
    "client_ip": "request.source_ip",
    "method": "request.method",
    "http_method": "request.method",
    "request_http_method": "request.method",
    "uri": "request.uri",
    "original_url": "request.uri",
    "url": "request.uri",
    "request_http_request": "request.uri",
    "query_string": "request.query_string",
    "query": "request.query_string",
    "status_code": "request.status_code",
    "response_http_status_code": "request.status_code",
    "response_size": "request.response_size",
    "response_content_length": "request.response_size",
    "user_agent": "request.user_agent",
    "request_user_agent": "request.user_agent",
    "raw_log": "request.raw_log",
    "raw": "request.raw_log",
    "line": "request.raw_log",
    "normalized_uri": "preprocessed.normalized_uri",
    "normalized_query_string": "preprocessed.normalized_query_string",
    "normalized_user_agent": "preprocessed.normalized_user_agent",
    "normalized_request": "preprocessed.normalized_request",
    "decode_depth": "preprocessed.decode.depth",
    "decode_changed": "preprocessed.decode.changed",
    "decode_depth_uri": "preprocessed.decode.depth_uri",
    "decode_changed_uri": "preprocessed.decode.changed_uri",
    "decode_depth_query_string": "preprocessed.decode.depth_query",
    "decode_depth_query": "preprocessed.decode.depth_query",
    "decode_changed_query_string": "preprocessed.decode.changed_query",
    "decode_changed_query": "preprocessed.decode.changed_query",
    "decode_limit_reached": "preprocessed.decode.limit_reached",
    "removed_control_chars": "preprocessed.decode.removed_control_chars",
    "feature_version": "features.version",
    "rule_score": "detection.rules.score",
    "rule_severity": "detection.rules.severity",
    "matched_rule_ids": "detection.rules.matched_ids",
    "matched_rules": "detection.rules.matched_rules",
    "attack_type": "detection.rules.attack_type",
    "ml_label": "detection.ml.label",
    "ml_attack_type": "detection.ml.attack_type",
    "ml_attack_probability": "detection.ml.probability",
    "ml_should_alert": "detection.ml.should_alert",
    "risk_score": "scoring.risk_score",
    "risk_bonus": "scoring.risk_bonus",
    "risk_level": "scoring.risk_level",
    "final_label": "scoring.final_label",
    "should_alert": "scoring.should_alert",
    "detection_method": "scoring.detection_method",
    "detection_sources": "scoring.detection_sources",
    "primary_signal": "scoring.primary_signal",
    "risk_input_scores": "scoring.risk_input_scores",
}
