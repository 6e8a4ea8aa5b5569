"""Rows in the shape analysts read: defaults, explanations, recommendations, alert text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.functions.columns import field, path_col, pick
from logwarden.functions.scales import analyst_severity
from logwarden.operators.predicates import row_attack_type, row_label

# Tokens named in an explanation.
TOKEN_LABELS = {"union": "UNION", "select": "SELECT", "../": "../", "<script": "<script>",
                "onerror=": "onerror", "javascript:": "javascript:"}

# Advice per attack family; the first family whose word occurs in the attack type applies.
RECOMMENDATIONS = [
    (["sql"], ["Bind every query value as a parameter.", "Reject input that does not match the expected type and length.",
               "Turn on the firewall's rules against SQL in requests.", "Look through the database log for queries from this time."]),
    (["xss"], ["Escape user input wherever a page shows it.", "Accept only the characters that each field needs.",
               "Set a content security policy that forbids inline scripts.", "Test the pages that show this parameter."]),
    (["traversal", "path"], ["Resolve the path and check that it stays below the served folder.", "Drop requests that hold parent-folder steps.",
                             "Give the service account no rights outside its own folder.", "Go through all routes that hand out files."]),
]
DEFAULT_RECOMMENDATION = ["Read the whole request by hand.", "Look for other alerts of the same address.",
                          "Log more detail on this endpoint for some days."]
RAW_LOG_LIMIT = 500
_NO_STRINGS = "array<string>"


def prediction_score(df: DataFrame) -> Column:
    """ML probability in 0..1 (percent values scaled), else risk / 100, else 0."""
    raw = pick(df, "ml_attack_probability", "detection.ml.probability", "ml_confidence",
               "detection.ml.confidence", "ml_score", "detection.ml.score").cast("double")
    scaled = F.when(raw > 1.0, raw / 100).otherwise(raw)
    risk = field(df, "risk_score", "double") / 100
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(scaled, risk, F.lit(0.0))))


def analyst_rows(df: DataFrame) -> DataFrame:
    """Stored request or incident rows with defaults filled and scores derived."""
    ids = pick(df, "incident_id", "event_id", "_id").cast("string")
    score = prediction_score(df)
    risk = F.coalesce(field(df, "risk_score", "double").cast("int"), (score * 100).cast("int"))
    level = F.lower(F.trim(F.coalesce(field(df, "risk_level", "string"), field(df, "rule_severity", "string"),
                                      pick(df, "severity").cast("string"))))
    rule_ids = F.coalesce(field(df, "matched_rule_ids", _NO_STRINGS), F.array().cast(_NO_STRINGS))
    stored = field(df, "detection_sources", _NO_STRINGS)
    derived = F.array_compact(F.array(
        F.when((F.size(rule_ids) > 0) | (F.coalesce(field(df, "rule_score", "int"), F.lit(0)) > 0), "rules"),
        F.when(F.coalesce(F.lower(field(df, "ml_label", "string")).isin("attack", "malicious", "suspicious"), F.lit(False))
               | F.coalesce(field(df, "ml_should_alert", "boolean"), F.lit(False)), "ml"),
        F.when(F.coalesce(field(df, "risk_bonus", "int"), F.lit(0)) > 0, "features")))

    def text(name: str, default: str) -> Column:
        return F.coalesce(F.nullif(field(df, name, "string"), F.lit("")), F.lit(default))

    ts = pick(df, "timestamp", "ts")
    base = df.select(
        F.coalesce(ids, F.lit("")).alias("incident_id"),
        F.coalesce(pick(df, "event_id", "_id").cast("string"), F.lit("")).alias("event_id"),
        ts.alias("timestamp"), text("source_ip", "Unknown").alias("ip"), text("method", "-").alias("method"),
        text("uri", "-").alias("uri"), row_attack_type(df).alias("attack_type"),
        risk.alias("risk_score"), F.round(score, 4).alias("prediction_score"),
        F.nullif(level, F.lit("")).alias("severity"), row_label(df).alias("verdict"),
        text("user_agent", "").alias("user_agent"), text("raw_log", "").alias("raw"),
        text("normalized_uri", "").alias("normalized_request"), rule_ids.alias("matched_rule_ids"),
        F.coalesce(field(df, "should_alert", "boolean"), F.lit(False)).alias("should_alert"),
        text("detection_method", "hybrid").alias("detection_method"),
        F.when(F.size(stored) > 0, stored).otherwise(derived).alias("detection_sources"),
        text("primary_signal", "unknown").alias("primary_signal"),
        *([F.col("embedding")] if "embedding" in df.columns else []),
    )
    return base.withColumn("severity", F.coalesce("severity", analyst_severity(F.col("risk_score"))))


def explanation(most_rules: int | None = None, most_tokens: int | None = None) -> Column:
    """Sentence on why an analyst row was flagged; names all rules and tokens unless bounded."""
    text = F.lower(F.concat_ws(" ", "uri", "raw"))
    tokens = F.array_compact(F.array(*[F.when(text.contains(k), v) for k, v in TOKEN_LABELS.items()]))
    parts = F.array_compact(F.array(
        F.when(F.lower("attack_type") != "unknown", F.concat(F.lit("classified as "), "attack_type")),
        F.when(F.size("matched_rule_ids") > 0, F.concat(F.lit("matched rules: "), F.array_join(F.slice("matched_rule_ids", 1, most_rules) if most_rules else F.col("matched_rule_ids"), ", "))),
        F.when(F.size("detection_sources") > 0, F.concat(F.lit("hybrid sources: "), F.array_join("detection_sources", ", "))),
        F.when(F.size(tokens) > 0, F.concat(F.lit("contains suspicious tokens ("), F.array_join(F.slice(tokens, 1, most_tokens) if most_tokens else tokens, ", "), F.lit(")"))),
        F.concat(F.lit("risk score "), F.col("risk_score").cast("string")),
        F.concat(F.lit("prediction confidence "), F.round(F.col("prediction_score") * 100, 1).cast("string"), F.lit("%"))))
    return F.concat(F.lit("Flagged because: "), F.array_join(parts, "; "), F.lit("."))


def recommendations(attack_type: Column, remediation: Column | None = None) -> Column:
    """Remedies of a matched pattern, else the advice for the attack family."""
    low = F.lower(F.trim(F.coalesce(attack_type, F.lit("unknown"))))

    def listed(texts: list[str]) -> Column:
        return F.array(*[F.lit(t) for t in texts])

    out = F
    if remediation is not None:
        out = out.when(F.size(remediation) > 0, remediation)
    for words, texts in RECOMMENDATIONS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, listed(texts))
    return out.otherwise(listed(DEFAULT_RECOMMENDATION))


def embedding_text(df: DataFrame) -> Column:
    """Stable text form of a request for embedding; falls back to the request or raw text."""
    def clean(*names: str) -> Column:
        found = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
        return F.coalesce(*found, F.lit("")) if found else F.lit("")

    method, uri = clean("normalized_method", "http_method"), clean("normalized_uri", "uri")
    query, agent = clean("normalized_query_string", "query_string"), clean("normalized_user_agent", "user_agent")
    raw, depth = clean("raw_uri", "original_url"), clean("decode_depth")
    parts = F.concat_ws(
        " | ",
        F.when(method != "", F.concat(F.lit("method="), method)),
        F.when(uri != "", F.concat(F.lit("path="), uri)),
        F.when(query != "", F.concat(F.lit("query="), query)),
        F.when(agent != "", F.concat(F.lit("user_agent="), agent)),
        F.when((raw != "") & (raw != uri) & (raw != F.concat_ws("?", uri, query)), F.concat(F.lit("raw_url="), raw)),
        F.when((depth != "") & ~depth.isin("0", "0.0"), F.concat(F.lit("decode_depth="), depth)))
    return F.when(parts != "", parts).otherwise(clean("normalized_request", "raw_log"))


def stored_embedding_text(df: DataFrame) -> Column:
    """Request text with its attack category in front; benign names are left out."""
    def text(name: str) -> Column:
        return F.nullif(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit(None).cast("string")

    kind = F.coalesce(text("attack_type"), text("ml_attack_type"), F.lit(""))
    kind = F.when(F.lower(kind).isin("unknown", "none", "normal", "benign"), "").otherwise(kind)
    body = F.coalesce(text("normalized_request"), text("uri"), text("raw_log"), F.lit(""))
    return F.trim(F.concat_ws(" ", kind, body))


# Accepted names of each alert field, first present wins.
ALERT_ALIASES = {
    "incident_id": ["incident_id", "_id", "event_id", "id"],
    "timestamp": ["timestamp", "event_time", "time", "created_at"],
    "severity": ["severity", "risk_level", "rule_severity"],
    "attack_type": ["attack_type", "attack", "category"],
    "risk_score": ["risk_score", "score", "final_score", "rule_score"],
    "source_ip": ["source_ip", "ip", "client_ip", "remote_addr"],
    "method": ["method", "http_method", "request_method"],
    "uri": ["uri", "raw_uri", "original_url", "url", "path"],
    "message": ["message", "description", "summary"],
    "prediction_label": ["prediction_label", "prediction.label"],
    "prediction_score": ["prediction_score", "prediction.score"],
    "matched_pattern": ["matched_pattern", "matched_rule", "matched_rule_id", "pattern_id"],
    "similarity_score": ["similarity_score", "similarity", "vector_score"],
    "dashboard_url": ["dashboard_url", "dashboard_link"],
    "raw_log": ["raw_log", "raw", "raw_line"],
}
ALERT_LISTS = {
    "mitre": ["mitre", "mitre_techniques", "mitre_ids"],
    "recommendations": ["recommendations", "recommendation", "remediation", "mitigation"],
}


def alert_events(df: DataFrame) -> DataFrame:
    """Alert fields picked from incident tables with differing column names."""
    def number_text(name: str, c: Column) -> Column:
        if name in ("risk_score", "prediction_score", "similarity_score"):
            d = c.try_cast("double")
            short = F.regexp_replace(F.format_string("%.3f", d), r"\.?0+$", "")
            return F.when(d.isNotNull(), short).otherwise(c.cast("string"))
        return c.cast("string")

    out = [number_text(n, pick(df, *names)).alias(n) for n, names in ALERT_ALIASES.items()]
    for name, names in ALERT_LISTS.items():
        cols = []
        for n in names:
            c = path_col(df, n)
            if c is not None:
                is_list = df.select(c.alias("x")).schema["x"].dataType.typeName() == "array"
                cols.append(c.cast(_NO_STRINGS) if is_list else F.when(c.isNotNull(), F.array(c.cast("string"))))
        out.append(F.coalesce(*cols, F.array().cast(_NO_STRINGS)).alias(name))
    return df.select(*out)


def alert_text() -> Column:
    """Message body of an alert row; only fields that are present appear."""
    def line(label: str, c: Column) -> Column:
        return F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{label}: "), c))

    def listed(name: str) -> Column:
        return F.filter(name, lambda x: x.isNotNull() & (x != ""))

    request = F.concat_ws(" ", F.nullif("method", F.lit("")), F.nullif("uri", F.lit("")))
    prediction = F.concat_ws(" / ", F.nullif("prediction_label", F.lit("")), F.nullif("prediction_score", F.lit("")))
    raw = F.when(F.length("raw_log") > RAW_LOG_LIMIT, F.concat(F.substring("raw_log", 1, RAW_LOG_LIMIT - 3), F.lit("..."))).otherwise(F.col("raw_log"))
    advice = F.concat_ws("\n", F.lit("Recommendations:"), F.transform(listed("recommendations"), lambda r: F.concat(F.lit("- "), r)))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), F.upper(F.coalesce("severity", F.lit("unknown"))), F.lit("] Security Incident Alert")),
        line("Incident", F.col("incident_id")), line("Time", F.col("timestamp")), line("Attack", F.col("attack_type")),
        line("Risk score", F.col("risk_score")), line("Source IP", F.col("source_ip")), line("Request", request),
        line("Prediction", prediction), line("MITRE", F.array_join(listed("mitre"), ", ")),
        line("Matched pattern", F.col("matched_pattern")), line("Similarity", F.col("similarity_score")),
        line("Dashboard", F.col("dashboard_url")), line("Message", F.col("message")),
        F.when(F.size("recommendations") > 0, advice), line("Raw log", raw),
    )
