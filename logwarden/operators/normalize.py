"""Parsed records to the common 25-column request row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.functions.text import clean_text, split_uri, strip, to_int, valid_ip
from logwarden.schema import COMMON_FIELDS, HTTP_METHODS, SERVER_TYPES

LOG_TIME = r"^\d{1,2}/[A-Za-z]{3}/\d{4}:\d{1,2}:\d{1,2}:\d{1,2} [+-]\d{2}:?\d{2}$"


def log_timestamp(text: Column, server_type: Column) -> Column:
    """Instant of a log timestamp; the accepted format depends on the server type."""
    apache = F.when(text.rlike(LOG_TIME), F.try_to_timestamp(
        F.regexp_replace(text, r"([+-]\d{2}):?(\d{2})$", "$1$2"), F.lit("d/MMM/yyyy:H:m:s Z")))
    iis = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?$"),
                 F.concat(text, F.lit("+00:00")).try_cast("timestamp"))
    zone = text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & text.rlike("[T ]")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"),
                 F.when(zone, text).otherwise(F.when(text.rlike("[T ]"), F.concat(text, F.lit("Z"))).otherwise(text))
                 .try_cast("timestamp"))
    return F.when(server_type.isin("apache", "nginx"), apache).when(server_type == "iis", iis).otherwise(iso)


def tz_offset(text: Column) -> Column:
    """UTC offset written in the source timestamp."""
    return F.nullif(F.regexp_extract(text, r"([+-]\d{2}:?\d{2}|Z)$", 1), F.lit(""))


def normalize(parsed: DataFrame) -> DataFrame:
    """One row per parsed record; bad values become NULL or 0 and are named in ``normalize_errors``."""
    def raw(name: str) -> Column:
        return F.col(name) if name in parsed.columns else F.lit(None).cast("string")

    status_text = F.lower(strip(F.coalesce(raw("parse_status").cast("string"), F.lit(""))))
    base = parsed.withColumns({
        "_pstatus": F.when(status_text.isin("success", "error"), status_text).otherwise("error"),
        "_pstatus_error": F.when(status_text == "", "parse_status_missing").when(
            ~status_text.isin("success", "error"), "parse_status_invalid"),
        "_server": F.lower(clean_text(raw("server_type"))),
        "_stamp": clean_text(raw("timestamp")),
        "_ip_text": clean_text(raw("source_ip")),
        "_method_text": F.upper(clean_text(raw("http_method"))),
        "_uri_text": clean_text(raw("raw_uri")),
        "_status_text": clean_text(raw("status_code")),
        "_size_text": clean_text(raw("response_size")),
        "_message": clean_text(raw("error_message")),
    })
    failed = F.coalesce(raw("parse_error").cast("boolean"), F.lit(False)) | (F.col("_pstatus") == "error")
    server = F.when(F.col("_server").isin(SERVER_TYPES), F.col("_server"))
    step = base.withColumns({
        "_failed": failed,
        "_server_ok": server,
        "_ts": log_timestamp(F.col("_stamp"), F.coalesce(server, F.lit("unknown"))),
        "_ip": valid_ip(F.col("_ip_text")),
        "_method": F.when(F.col("_method_text").isin(HTTP_METHODS), F.col("_method_text")),
        "_status": to_int(F.col("_status_text")),
        "_size": to_int(F.col("_size_text")),
    })
    strict = ~F.col("_failed")
    # Status: blank or unreadable is invalid only for a parsed record; range likewise.
    bad_status = strict & (F.col("_status").isNull() | ~F.coalesce(F.col("_status").between(100, 599), F.lit(False)))
    size_missing = F.col("_size_text").isNull()
    bad_size = strict & ~size_missing & (F.col("_size").isNull() | F.coalesce(F.col("_size") < 0, F.lit(False)))
    errors = F.array_compact(F.array(
        F.col("_pstatus_error"),
        F.when(F.col("_failed"), "parse_error"),
        F.when(F.col("_server_ok").isNull(), "server_type_invalid"),
        F.when(F.col("_stamp").isNotNull() & F.col("_ts").isNull(), "timestamp_invalid"),
        F.when(F.col("_ip").isNull() & (F.col("_ip_text").isNotNull() | strict), "source_ip_invalid"),
        F.when(F.col("_method").isNull() & (F.col("_method_text").isNotNull() | strict), "http_method_invalid"),
        F.when(bad_status, "status_code_invalid"),
        F.when(bad_size, "response_size_invalid"),
    ))
    uri = split_uri(F.col("_uri_text"))
    extra = [c for c in ("file", "flags", "physical_line_range") if c in parsed.columns]
    out = step.withColumn("_errors", errors).select(
        *extra,
        raw("event_id").alias("event_id"),
        F.col("_ts").alias("timestamp"),
        F.col("_ip").alias("source_ip"),
        F.col("_method").alias("http_method"),
        F.coalesce(clean_text(raw("original_url")), F.col("_uri_text")).alias("original_url"),
        F.col("_uri_text").alias("raw_uri"),
        uri["uri"].alias("uri"), uri["query_string"].alias("query_string"), uri["fragment"].alias("fragment"),
        F.when(bad_status, F.lit(0)).otherwise(F.coalesce(F.col("_status"), F.lit(0))).cast("int").alias("status_code"),
        bad_status.alias("status_code_invalid"),
        F.when(bad_size, F.lit(0)).otherwise(F.coalesce(F.col("_size"), F.lit(0))).cast("bigint").alias("response_size"),
        size_missing.alias("response_size_missing"),
        bad_size.alias("response_size_invalid"),
        clean_text(raw("user_agent")).alias("user_agent"),
        clean_text(raw("referrer")).alias("referrer"),
        F.col("_server_ok").alias("server_type"),
        raw("raw_log").alias("raw_log"),
        raw("line_number").alias("line_number"),
        F.col("_pstatus").alias("parse_status"),
        F.col("_failed").alias("parse_error"),
        F.col("_message").alias("parse_error_message"),
        F.when(F.size("_errors") > 0, "error").otherwise("success").alias("normalize_status"),
        F.col("_errors").alias("normalize_errors"),
        F.coalesce("_message", F.when(F.size("_errors") > 0, F.concat(
            F.lit("normalize_errors="), F.array_join("_errors", ",")))).alias("error_message"),
    )
    return out.select(*extra, *COMMON_FIELDS)
