"""CSV, JSON and HTTP-block inputs turned into access-log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logwarden.functions.text import strip
from logwarden.operators.ordered import fill_forward, running_count
from logwarden.session import materialize

# Accepted column names of each request field, first match wins.
FIELD_ALIASES = {
    "raw_uri": ["raw_uri", "original_url", "uri", "url", "uri_path", "path", "request_uri",
                "cs_uri_stem", "request_http_request"],
    "http_method": ["http_method", "method", "verb", "cs_method", "request_http_method"],
    "status_code": ["status_code", "status", "http_status", "response_status", "sc_status",
                    "response_http_status_code"],
    "response_size": ["response_size", "bytes", "size", "content_length",
                      "response_content_length", "sc_bytes"],
    "source_ip": ["source_ip", "ip", "client_ip", "remote_addr", "c_ip", "src_ip"],
    "user_agent": ["user_agent", "ua", "cs_user_agent", "request_user_agent"],
    "referrer": ["referrer", "referer", "cs_referer", "request_referer"],
    "http_version": ["http_version", "protocol", "request_protocol", "request_http_protocol"],
    "timestamp": ["timestamp", "time", "date_time", "datetime", "@timestamp"],
}
# What a request field is when no column holds it.
FIELD_DEFAULTS = {"raw_uri": "/", "http_method": "GET", "source_ip": "0.0.0.0",
                  "http_version": "HTTP/1.1", "referrer": "-", "user_agent": "-"}

# Timestamp formats accepted when rendering, and the one written.
LINE_TIME_FORMATS = ["dd/MMM/yyyy:HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ssXXX"]
LINE_TIME_OUTPUT = "dd/MMM/yyyy:HH:mm:ss Z"

REQUEST_LINE = r"^([A-Z]{2,16})\s+(\S.*?)(?:\s+(HTTP/\d(?:\.\d)?))?$"


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header; every column is text. A byte-order mark is dropped.

    ``multi_line`` reads quoted fields with line breaks, at the price of one task per file.
    """
    return (spark.read.option("header", "true").option("recursiveFileLookup", "true")
            .option("escape", '"').option("multiLine", str(multi_line).lower()).csv(path))


def read_json(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """JSON lines, or files holding one object or one array of objects."""
    return (spark.read.option("multiLine", str(not lines).lower())
            .option("recursiveFileLookup", "true").json(path))


def normalize_keys(df: DataFrame) -> DataFrame:
    """Lower-case column names with ``_`` for ``-`` and space; the last of equal names wins."""
    names: dict[str, str] = {}
    for c in df.columns:
        names[c.strip().strip('"').strip("'").lower().replace("-", "_").replace(" ", "_")] = c
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()])


def resolve_request_fields(df: DataFrame) -> DataFrame:
    """Common request row: first non-empty alias of each field, else its default."""
    rows = normalize_keys(df)

    def first(field: str) -> Column:
        found = [F.nullif(F.col(f"`{a}`").cast("string"), F.lit("")) for a in FIELD_ALIASES[field] if a in rows.columns]
        value = F.coalesce(*found) if found else F.lit(None).cast("string")
        default = FIELD_DEFAULTS.get(field)
        return F.coalesce(F.nullif(strip(value), F.lit("")), F.lit(default)) if default else strip(value)

    def number(field: str, default: int) -> Column:
        value = first(field)
        return F.coalesce(F.when(value.rlike(r"^[+-]?\d+$"), value.try_cast("bigint")), F.lit(default).cast("bigint"))

    return rows.select(
        first("source_ip").alias("source_ip"),
        first("timestamp").alias("timestamp"),
        F.upper(first("http_method")).alias("http_method"),
        first("raw_uri").alias("raw_uri"),
        first("http_version").alias("http_version"),
        number("status_code", 200).alias("status_code"),
        number("response_size", 0).alias("response_size"),
        first("referrer").alias("referrer"),
        first("user_agent").alias("user_agent"),
    )


def line_time(text: Column, now: Column | None = None) -> Column:
    """Timestamp text as written in an access log; unreadable text becomes ``now``.

    Offsets in the input are kept as they are.
    """
    t = strip(F.coalesce(text, F.lit("")))
    colon_free = F.regexp_replace(t, r"([+-]\d{2}):(\d{2})$", "$1$2")
    zoned = F.regexp_replace(colon_free, "Z$", "+0000")
    iso = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})([+-]\d{4})$"
    iso_local = F.try_to_timestamp(
        F.concat(F.regexp_extract(zoned, iso, 1), F.lit(" "), F.regexp_extract(zoned, iso, 2)),
        F.lit("yyyy-MM-dd HH:mm:ss"))
    plain = F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss"))
    apache = F.try_to_timestamp(t, F.lit(LINE_TIME_OUTPUT))
    local_format = "dd/MMM/yyyy:HH:mm:ss"
    return (
        F.when(apache.isNotNull(), t)
        .when(zoned.rlike(iso) & iso_local.isNotNull(),
              F.concat(F.date_format(iso_local, local_format), F.lit(" "), F.regexp_extract(zoned, iso, 3)))
        .when(plain.isNotNull(), F.concat(F.date_format(plain, local_format), F.lit(" +0000")))
        .otherwise(F.date_format(now if now is not None else F.current_timestamp(), LINE_TIME_OUTPUT))
    )


def render_log_line(df: DataFrame, now: Column | None = None) -> Column:
    """Combined access-log line of a common request row."""
    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))

    request = F.concat_ws(" ", "http_method", "raw_uri", "http_version")
    return F.concat(
        F.col("source_ip"), F.lit(" - - ["), line_time(F.col("timestamp"), now), F.lit("] "),
        quoted(request), F.lit(" "), F.col("status_code").cast("string"), F.lit(" "),
        F.col("response_size").cast("string"), F.lit(" "),
        quoted(F.col("referrer")), F.lit(" "), quoted(F.col("user_agent")),
    )


def http_blocks(lines: DataFrame) -> DataFrame:
    """Requests written as a request line followed by ``Header: value`` lines.

    Input: file, physical_line, line. Output: file, physical_line and either the
    request fields of a block or ``passthrough`` for any other text line.
    """
    text = strip(F.col("line"))
    is_request = text.rlike(REQUEST_LINE)
    # A block lives until a blank line or a line that is neither request nor header.
    state = (
        F.when(is_request, F.lit("open"))
        .when(text == "", F.lit("closed"))
        .when(~text.contains(":"), F.lit("closed"))
    )
    # Each step reads its input more than once, so the steps are staged.
    marked = materialize(fill_forward(lines.withColumn("_text", text), ["file"], "physical_line", state, "_state"), "marked")
    numbered = materialize(running_count(
        marked, ["file"], "physical_line", F.col("_text").rlike(REQUEST_LINE), "_block_no"), "blocks")
    in_block = F.col("_state") == "open"

    key = F.lower(strip(F.substring_index("_text", ":", 1)))
    value = strip(F.substring(F.col("_text"), F.instr("_text", ":") + 1, F.length("_text")))
    requests = numbered.where(in_block).groupBy("file", "_block_no").agg(
        F.min("physical_line").alias("physical_line"),
        F.min_by("_text", "physical_line").alias("_request"),
        # A header given twice keeps its last value.
        *[
            F.max(F.when(~F.col("_text").rlike(REQUEST_LINE) & (key == header),
                         F.struct("physical_line", value.alias("v"))))["v"].alias(name)
            for header, name in [("user-agent", "_ua"), ("referer", "_referer"), ("referrer", "_referrer")]
        ],
    ).select(
        "file", "physical_line",
        F.regexp_extract("_request", REQUEST_LINE, 1).alias("method"),
        strip(F.regexp_extract("_request", REQUEST_LINE, 2)).alias("raw_uri"),
        F.coalesce(F.nullif(F.regexp_extract("_request", REQUEST_LINE, 3), F.lit("")), F.lit("HTTP/1.1")).alias("http_version"),
        F.coalesce("_ua", F.lit("-")).alias("user_agent"),
        F.coalesce(F.nullif(F.col("_referer"), F.lit("")), F.nullif(F.col("_referrer"), F.lit("")), F.lit("-")).alias("referrer"),
        F.lit(None).cast("string").alias("passthrough"),
    )
    other = numbered.where(~F.coalesce(in_block, F.lit(False)) & (F.col("_text") != ""))
    return requests.unionByName(other.select(
        "file", "physical_line", F.col("_text").alias("passthrough")), allowMissingColumns=True)


def http_block_lines(lines: DataFrame, now: Column | None = None) -> DataFrame:
    """HTTP blocks rendered as access-log lines; other lines stay as they are."""
    blocks = http_blocks(lines)
    rows = blocks.select(
        "file", "physical_line", "passthrough", F.lit("0.0.0.0").alias("source_ip"),
        F.lit(None).cast("string").alias("timestamp"),
        F.col("method").alias("http_method"), "raw_uri", "http_version",
        F.lit(200).alias("status_code"), F.lit(0).alias("response_size"), "referrer", "user_agent",
    )
    return rows.select("file", "physical_line",
                       F.coalesce("passthrough", render_log_line(rows, now)).alias("line"))


def structured_to_lines(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows of any CSV or JSON request table as access-log lines."""
    rows = resolve_request_fields(df)
    return rows.select(render_log_line(rows, now).alias("line"))
