"""Access-log lines to parsed records (Apache, Nginx, IIS W3C)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.functions.columns import pinned
from logwarden.functions.text import strip, to_int, valid_ip
from logwarden.operators.ordered import fill_forward, running_count
from logwarden.operators.ranks import top_k_per_group
from logwarden.schema import HTTP_METHODS, PARSED_FIELDS
from logwarden.session import materialize

# Access-log grammar. A quoted field without quotes inside is tried
# first, then a request that may hold quotes; each form may carry trailing text.
_PREFIX = r"(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"
_TAIL = r"(?:\s+(.+))?"
_STRICT, _LOOSE = r'"([^"]*)"\s+', r'"(.*)"\s+'
_STATUS_SIZE = r"(\S+)\s+(\S+)"
_AGENT = r'\s+"([^"]*)"\s+"([^"]*)"'
LINE_FORMS = [
    ("combined", True, _PREFIX + _STRICT + _STATUS_SIZE + _AGENT + _TAIL),
    ("common", True, _PREFIX + _STRICT + _STATUS_SIZE + _TAIL),
    ("combined", False, _PREFIX + _LOOSE + _STATUS_SIZE + _AGENT + _TAIL),
    ("common", False, _PREFIX + _LOOSE + _STATUS_SIZE + _TAIL),
]

# Request field grammar and the markers it must not hold.
REQUEST_FULL = r"^(\S+)\s+(.+?)\s+(HTTP/\d(?:\.\d)?)$"
REQUEST_BARE = r"^(\S+)\s+(\S.*)$"
REQUEST_VERSION = r"HTTP/\d(?:\.\d)?"
REQUEST_MARKERS = "[\n\r\t]|\\\\[nrt]"

_NAMES = {"apache": "Apache", "nginx": "Nginx"}
_MARK = "\u0001"

_LINE_STRUCT = ("struct<profile:string,source_ip:string,timestamp:string,request:string,"
                "status:string,size:string,referrer:string,user_agent:string,extra_tail:string>")


def _form_struct(line: Column, profile: str, strict: bool, pattern: str) -> Column:
    """Groups of one line form, or NULL when the whole line does not match.

    One pass rewrites the line as its groups between marks; lines that already
    hold the mark character take the slower group-by-group way.
    """
    groups = 8 if profile == "combined" else 6
    full = f"(?d)^{pattern}$"
    marked = F.regexp_replace(line, full, _MARK + _MARK.join(f"${i}" for i in range(1, groups + 1)))
    fast = F.split(marked, _MARK)
    slow = F.array(F.lit(""), *[F.regexp_extract(line, full, i) for i in range(1, groups + 1)])
    parts = F.when(line.contains(_MARK), F.when(line.rlike(full), slow)).when(
        marked.startswith(_MARK), fast)

    def to_struct(p: Column) -> Column:
        tail = F.nullif(F.get(p, F.lit(groups)), F.lit(""))
        name = F.when(tail.isNotNull() & F.lit(strict), profile + "_with_tail").otherwise(profile)
        dash = F.lit("-")
        return F.struct(
            name, p[1], p[2], p[3], p[4], p[5],
            p[6] if groups == 8 else dash, p[7] if groups == 8 else dash, tail,
        ).cast(_LINE_STRUCT)

    # transform over a one-element array evaluates the split once for all fields
    return F.when(parts.isNotNull(), F.transform(F.array(parts), to_struct)[0])


def _request_parts(request: Column) -> dict[str, Column]:
    full = request.rlike(f"(?d){REQUEST_FULL}")
    bare = ~full & ~request.rlike(REQUEST_VERSION) & request.rlike(f"(?d){REQUEST_BARE}")

    def group(i: int) -> Column:
        return F.when(full, F.regexp_extract(request, f"(?d){REQUEST_FULL}", i)).when(
            bare, F.regexp_extract(request, f"(?d){REQUEST_BARE}", i))

    method = F.upper(group(1))
    error = (
        F.when(request.rlike(REQUEST_MARKERS), "Request field contains forbidden control marker")
        .when(~full & ~bare, "Request field does not match expected format")
        .when(~method.isin(HTTP_METHODS), "Invalid http_method in request field")
    )
    version = F.when(full, F.regexp_extract(request, f"(?d){REQUEST_FULL}", 3))
    return {"method": method, "uri": group(2), "version": version, "error": error}


def _size(text: Column) -> Column:
    return F.when(text == "-", F.lit(0).cast("bigint")).otherwise(to_int(text))


def _checked(request_error: Column, ip: Column, status: Column, size: Column) -> Column:
    """First validation error, in the order the fields are checked."""
    return F.coalesce(
        request_error,
        F.when(ip.isNull(), F.lit("Invalid source_ip")),
        F.when(status.isNull() | ~status.between(100, 599), F.lit("Invalid status_code")),
        F.when(size.isNull() | (size < 0), F.lit("Invalid response_size")),
    )


def access_line(line: Column) -> Column:
    """First matching form of an Apache or Nginx line as a struct, NULL if none matches."""
    clean = strip(line)
    return F.coalesce(*[_form_struct(clean, *form) for form in LINE_FORMS])


def event_id(server_type: Column, line_number: Column, raw: Column, namespace: Column | None = None) -> Column:
    """``server:line[:namespace]:first 12 hex digits of the line's SHA-1``."""
    digest = F.substring(F.sha1(F.encode(raw, "UTF-8")), 1, 12)
    parts = [server_type, line_number.cast("string")] + ([namespace] if namespace is not None else [])
    return F.concat_ws(":", *parts, digest)


def _finish(df: DataFrame, server_type: str, namespace: str | None) -> DataFrame:
    """Common columns of success and error records; error records keep only the raw text."""
    failed = F.col("error_message").isNotNull()
    kept = {"raw_log", "line_number", "error_message"}
    blanked = [c for c in df.columns if c in PARSED_FIELDS and c not in kept]
    out = df.withColumns({c: F.when(~failed, F.col(c)) for c in blanked}).withColumns({
        "server_type": F.lit(server_type),
        "parse_error": failed,
        "parse_status": F.when(failed, "error").otherwise("success"),
    })
    ns = F.col(namespace) if namespace else None
    out = out.withColumn("event_id", event_id(F.col("server_type"), F.col("line_number"), F.col("raw_log"), ns))
    extra = [c for c in ("file",) if c in out.columns]
    return out.select(*extra, *PARSED_FIELDS)


def parse_access_log(lines: DataFrame, server_type: str = "apache", namespace: str | None = None) -> DataFrame:
    """Apache or Nginx lines (``line``, ``line_number``) to parsed records."""
    base = lines.withColumn("_l", pinned(access_line(F.col("line"))))
    req = _request_parts(F.col("_l.request"))
    fields = base.withColumns({
        "_method": req["method"], "_uri": req["uri"], "_version": req["version"], "_req_error": req["error"],
        "_ip": valid_ip(F.col("_l.source_ip")), "_status": to_int(F.col("_l.status")), "_size": _size(F.col("_l.size")),
    })
    no_form = (f"No {_NAMES[server_type]} log pattern matched: supported profiles are "
               "combined/common with optional trailing custom fields")
    error = F.when(F.col("_l").isNull(), F.lit(no_form)).otherwise(
        _checked(F.col("_req_error"), F.col("_ip"), F.col("_status"), F.col("_size")))
    out = fields.select(
        *[c for c in ("file", "line_number") if c in lines.columns],
        *([namespace] if namespace and namespace not in ("file", "line_number") else []),
        F.col("line").alias("raw_log"),
        F.col("_l.timestamp").alias("timestamp"), F.col("_ip").alias("source_ip"),
        F.col("_l.request").alias("request"), F.col("_method").alias("http_method"),
        F.col("_uri").alias("raw_uri"), F.col("_uri").alias("original_url"),
        F.col("_version").alias("http_version"), F.col("_status").cast("int").alias("status_code"),
        F.col("_size").alias("response_size"), F.col("_l.referrer").alias("referrer"),
        F.col("_l.user_agent").alias("user_agent"), F.col("_l.profile").alias("format_profile"),
        F.col("_l.extra_tail").alias("extra_tail"), F.lit(None).cast("bigint").alias("data_line_number"),
        error.alias("error_message"),
    )
    return _finish(out, server_type, namespace)


# Shell-like splitting of W3C data lines.
_PIECE = r""""(?:[^"\\]|\\.)*"|'[^']*'|(?:[^\s"'\\]|\\.)+"""
_TOKEN = f"(?:{_PIECE})+"


def split_quoted(line: Column) -> Column:
    """Fields of a line with shell quoting and escapes; NULL when a quote stays open."""
    def unquote(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
        return (
            F.when(piece.startswith('"'), F.regexp_replace(inner, r'\\(["\\])', "$1"))
            .when(piece.startswith("'"), inner)
            .otherwise(F.regexp_replace(piece, r"\\(.)", "$1"))
        )

    tokens = F.regexp_extract_all(line, F.lit(_TOKEN), F.lit(0))
    unquoted = F.transform(tokens, lambda t: F.array_join(
        F.transform(F.regexp_extract_all(t, F.lit(_PIECE), F.lit(0)), unquote), ""))
    closed = line.rlike(rf"^\s*(?:{_TOKEN}(?:\s+|$))*$")
    return F.when(~line.rlike(r"""["'\\]"""), F.split(line, r"\s+")).when(closed, unquoted)


def _named(name: str) -> Column:
    """Value of a W3C field by header name; of equal names the last counts."""
    pos = F.array_position(F.reverse("_fields"), name)
    return F.when(pos > 0, F.get(F.reverse("_parts"), (pos - 1).cast("int")))


def parse_iis_log(lines: DataFrame, namespace: str | None = None) -> DataFrame:
    """W3C lines (``file``, ``line_number``, ``line``) to parsed records.

    ``#Fields:`` sets the columns of the lines below it in the same file.
    """
    text = strip(F.col("line"))
    header = F.when(text.startswith("#Fields:"), F.filter(
        F.split(strip(F.substring(text, F.lit(9), F.length(text))), r"\s+"), lambda f: f != ""))
    filled = fill_forward(lines, ["file"], "line_number", header, "_fields")
    data = filled.where((text != "") & ~text.startswith("#")).withColumn("_parts", split_quoted(text))
    no_header = F.coalesce(F.size("_fields") <= 0, F.lit(True)) | F.col("_fields").isNull()
    raw_uri = F.when(
        (_named("cs-uri-stem") != "") & (_named("cs-uri-query") != "") & (_named("cs-uri-query") != "-"),
        F.concat(_named("cs-uri-stem"), F.lit("?"), _named("cs-uri-query"))).otherwise(_named("cs-uri-stem"))
    stamp = F.when((_named("date") != "") & (_named("time") != ""), F.concat_ws(" ", _named("date"), _named("time")))
    has_size = F.array_contains("_fields", "sc-bytes")
    fields = data.withColumns({
        "_method": F.upper(_named("cs-method")), "_uri": raw_uri, "_stamp": stamp,
        "_ip": valid_ip(_named("c-ip")), "_status": to_int(_named("sc-status")),
        "_size": F.when(has_size, _size(_named("sc-bytes"))).otherwise(F.lit(0).cast("bigint")),
        "_ref": F.when(F.array_contains("_fields", "cs(Referer)"), _named("cs(Referer)")).otherwise("-"),
        "_ua": F.when(F.array_contains("_fields", "cs(User-Agent)"), _named("cs(User-Agent)")).otherwise("-"),
    })
    method_error = F.when(~F.coalesce(F.col("_method").isin(HTTP_METHODS), F.lit(False)),
                          F.lit("Invalid http_method in request field"))
    ip_error = F.when(F.col("_ip").isNull(), F.lit("Invalid source_ip"))
    unclosed = F.when(text.rlike(r"\\$"), "No escaped character").otherwise("No closing quotation")
    error = (
        F.when(no_header, F.lit("Missing #Fields header before IIS data line"))
        .when(F.col("_parts").isNull(), F.concat(F.lit("Malformed quoted IIS fields: "), unclosed))
        .when(F.size("_parts") != F.size("_fields"), F.format_string(
            "IIS field count mismatch: expected %d, got %d", F.size("_fields"), F.size("_parts")))
        .otherwise(F.coalesce(ip_error, _checked(method_error, F.col("_ip"), F.col("_status"), F.col("_size"))))
    )
    out = fields.select(
        "file", "line_number", *([namespace] if namespace and namespace not in ("file", "line_number") else []),
        F.col("line").alias("raw_log"), F.col("_stamp").alias("timestamp"), F.col("_ip").alias("source_ip"),
        F.lit(None).cast("string").alias("request"), F.col("_method").alias("http_method"),
        F.col("_uri").alias("raw_uri"), F.col("_uri").alias("original_url"),
        F.lit(None).cast("string").alias("http_version"), F.col("_status").cast("int").alias("status_code"),
        F.col("_size").alias("response_size"), F.col("_ref").alias("referrer"), F.col("_ua").alias("user_agent"),
        F.lit("w3c").alias("format_profile"), F.lit(None).cast("string").alias("extra_tail"),
        error.alias("error_message"),
    )
    # Counting reads its input twice; the lines should be parsed once.
    counted = running_count(materialize(out, "w3c"), ["file"], "line_number", F.col("error_message").isNull(), "data_line_number")
    return _finish(counted, "iis", namespace)


# Parser per server type; register a function (lines DataFrame -> parsed DataFrame) to add one.
PARSERS: dict[str, Callable[..., DataFrame]] = {
    "apache": lambda lines, **kw: parse_access_log(lines, "apache", **kw),
    "nginx": lambda lines, **kw: parse_access_log(lines, "nginx", **kw),
    "iis": parse_iis_log,
}


def parse_log(lines: DataFrame, server_type: str, **options) -> DataFrame:
    return PARSERS.get(server_type.lower(), PARSERS["apache"])(lines, **options)


def parse_by_server(lines: DataFrame, **options) -> DataFrame:
    """Lines of many files, each with its own ``server_type`` column."""
    kind = F.lower("server_type")
    known = [s for s in PARSERS if s != "apache"]
    parts = [parse_log(lines.where(kind == s), s, **options) for s in known]
    out = parse_log(lines.where(~F.coalesce(kind.isin(known), F.lit(False))), "apache", **options)
    for part in parts:
        out = out.unionByName(part)
    return out


def detect_server_type(lines: DataFrame, sample_size: int | None = None) -> DataFrame:
    """Server type per file: W3C header, else the better parser; tie apache.

    All lines count, in one aggregate; with ``sample_size`` only the first of each file.

    Apache and Nginx share one grammar, so their counts are equal and apache wins.
    """
    text = strip(F.col("line"))
    sample = lines.where(text != "")
    if sample_size:
        sample = top_k_per_group(sample, ["file"], [F.col("line_number")], sample_size)
    req = _request_parts(F.col("_l.request"))
    parsed = sample.withColumn("_l", access_line(F.col("line")))
    ok = F.col("_l").isNotNull() & _checked(
        req["error"], valid_ip(F.col("_l.source_ip")), to_int(F.col("_l.status")), _size(F.col("_l.size"))).isNull()
    return parsed.groupBy("file").agg(
        F.bool_or(text.startswith("#Fields:") | text.startswith("#Software:")).alias("_iis"),
        F.count_if(ok).alias("parsed_lines"),
    ).select("file", "parsed_lines", F.when(F.col("_iis"), "iis").otherwise("apache").alias("server_type"))


def detect_server_type_by_keyword(lines: DataFrame, head: int | None = None) -> DataFrame:
    """Server type per file from words in its lines (the first ``head``, if given); first hit wins."""
    text = F.lower(strip(F.col("line")))
    hit = (
        F.when(text.startswith("#fields:") | text.contains("cs-method") | text.contains("w3c"), "iis")
        .when(text.contains("nginx"), "nginx")
        .when(text.contains("apache"), "apache")
    )
    return (
        (lines.where(F.col("physical_line") <= head) if head else lines)
        .groupBy("file")
        .agg(F.min_by(hit, F.when(hit.isNotNull(), F.col("physical_line"))).alias("_hit"))
        .select("file", F.coalesce("_hit", F.lit("apache")).alias("server_type"))
    )
