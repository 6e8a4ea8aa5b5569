"""Sixty numeric request features, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.functions.decode import percent_decode
from logwarden.schema import FEATURE_NAMES, FEATURE_PREFIX, FEATURE_VERSION

# Keyword lists.
SQL_KEYWORDS = ["select", "union", "insert", "update", "delete", "drop",
                "information_schema", "sleep(", "benchmark(", "or 1=1", "and 1=1"]
XSS_KEYWORDS = ["<script", "<svg", "<img", "onerror=", "onload=", "javascript:",
                "document.cookie", "srcdoc=", "ontoggle="]
TRAVERSAL_KEYWORDS = ["../", "..\\", "/etc/passwd", "win.ini", "boot.ini"]
SCANNER_AGENTS = ["sqlmap", "nikto", "acunetix", "nessus", "openvas",
                  "nmap", "gobuster", "ffuf", "dirbuster"]
SPECIAL_CHARS = "'\"<>;(){}[]./\\=%-&|"
# SQL evasion patterns, matched without regard to case.
SQLI_EVASION = r"(?:'|\b)(?:\s|/\*.*?\*/|%0a|%0d|%09)*(?:or|and)(?:\s|/\*.*?\*/|%0a|%0d|%09)+\d+\s*=\s*\d+"
UNION_SELECT = r"\bunion(?:\s|/\*.*?\*/)+select\b"


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``; one or two are counted by byte search."""
    if len(chars) > 2:
        return F.length(text) - F.length(F.translate(text, chars, ""))
    counts = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in chars]
    return counts[0] if len(counts) == 1 else counts[0] + counts[1]


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, base 2, rounded to 4 digits."""
    n = F.length(text)

    def term(acc: Column, ch: Column) -> Column:
        p = (n - F.length(F.replace(text, ch, F.lit("")))) / n
        return acc - p * F.log2(p)

    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(n > 0, F.round(F.aggregate(chars, F.lit(0.0), term), 4)).otherwise(F.lit(0.0))


def contains_any(text: Column, words: list[str]) -> Column:
    lowered = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | lowered.contains(w)
    return out


def query_params(query: Column) -> Column:
    """``array<struct<name,value>>`` of a query string; blanks kept, both parts decoded."""
    def decoded(t: Column) -> Column:
        return percent_decode(F.replace(t, F.lit("+"), F.lit(" ")))

    def one(part: Column) -> Column:
        name = F.substring_index(part, "=", 1)
        value = F.substring(part, F.length(name) + 2, F.length(part))
        return F.struct(decoded(name).alias("name"), decoded(value).alias("value"))

    return F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), one)


def _mean_length(params: Column, part: str) -> Column:
    total = F.aggregate(params, F.lit(0), lambda a, p: a + F.length(p[part]))
    return F.when(F.size(params) > 0, F.round(total / F.size(params), 4)).otherwise(F.lit(0.0))


def _char_counts(prefix: str, text: Column) -> dict[str, Column]:
    return {
        f"{prefix}_special_char_count": count_chars(text, SPECIAL_CHARS),
        f"{prefix}_digit_count": F.regexp_count(text, F.lit(r"\p{Nd}")),
        f"{prefix}_alpha_count": F.regexp_count(text, F.lit(r"\p{L}")),
        f"{prefix}_slash_count": count_chars(text, "/"),
        f"{prefix}_backslash_count": count_chars(text, "\\"),
        f"{prefix}_dot_count": count_chars(text, "."),
        f"{prefix}_quote_count": count_chars(text, "'\""),
        f"{prefix}_angle_bracket_count": count_chars(text, "<>"),
        f"{prefix}_percent_count": count_chars(text, "%"),
        f"{prefix}_equals_count": count_chars(text, "="),
        f"{prefix}_ampersand_count": count_chars(text, "&"),
        f"{prefix}_semicolon_count": count_chars(text, ";"),
        f"{prefix}_hyphen_count": count_chars(text, "-"),
        f"{prefix}_entropy": entropy(text),
    }


def truthy(df: DataFrame, name: str) -> Column:
    """Flag as 0/1: booleans, non-zero numbers and the words 1, true, yes, y, error."""
    if name not in df.columns:
        return F.lit(0)
    kind = df.schema[name].dataType.simpleString()
    c = F.col(name)
    if kind == "boolean":
        flag = c
    elif kind == "string":
        flag = F.lower(F.trim(c)).isin("1", "true", "yes", "y", "error")
    else:
        flag = c != 0
    return F.coalesce(flag.cast("int"), F.lit(0))


def _whole(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).try_cast("int"), F.lit(0)) if name in df.columns else F.lit(0)


def extract_features(df: DataFrame) -> DataFrame:
    """Adds ``feature_*`` columns, ``feature_version`` and ``feature_names``."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")

    url = F.when(text("normalized_url") != "", text("normalized_url")).when(
        text("normalized_query_string") != "",
        F.concat_ws("?", text("normalized_uri"), text("normalized_query_string"))).otherwise(text("normalized_uri"))
    method = F.lower(F.coalesce(F.nullif(text("normalized_method"), F.lit("")), text("http_method")))
    rebuilt = F.concat(F.lit("method="), method, F.lit(" | url="), url,
                       F.lit(" | user_agent="), text("normalized_user_agent"))
    request = F.when(text("normalized_request") != "", text("normalized_request")).otherwise(
        F.trim(F.regexp_replace(rebuilt, r"\s+", " ")))
    base = df.withColumns({
        "_uri": text("normalized_uri"), "_query": text("normalized_query_string"),
        "_ua": text("normalized_user_agent"), "_request": request,
    })
    base = base.withColumn("_params", query_params(F.col("_query")))
    uri, query, ua, req = F.col("_uri"), F.col("_query"), F.col("_ua"), F.col("_request")

    def evasion(t: Column) -> Column:
        return t.rlike(f"(?i){SQLI_EVASION}") | t.rlike(f"(?i){UNION_SELECT}")

    values = {
        "uri_length": F.length(uri), "query_length": F.length(query), "user_agent_length": F.length(ua),
        "param_count": F.size("_params"),
        "avg_param_name_length": _mean_length(F.col("_params"), "name"),
        "avg_param_value_length": _mean_length(F.col("_params"), "value"),
        **_char_counts("uri", uri), **_char_counts("query", query), **_char_counts("ua", ua),
        **{n: truthy(df, n) for n in ("status_code_missing", "status_code_invalid",
                                      "response_size_missing", "response_size_invalid")},
        "decode_depth": _whole(df, "decode_depth"), "decode_changed": truthy(df, "decode_changed"),
        "decode_depth_uri": _whole(df, "decode_depth_uri"), "decode_changed_uri": truthy(df, "decode_changed_uri"),
        "decode_depth_query": _whole(df, "decode_depth_query_string"),
        "decode_changed_query": truthy(df, "decode_changed_query_string"),
        "decode_depth_user_agent": _whole(df, "decode_depth_user_agent"),
        "decode_changed_user_agent": truthy(df, "decode_changed_user_agent"),
        "decode_limit_reached": truthy(df, "decode_limit_reached"),
        "removed_control_chars": truthy(df, "removed_control_chars"),
        "has_sql_keyword": contains_any(req, SQL_KEYWORDS).cast("int"),
        "has_sqli_evasion_pattern": (evasion(query) | evasion(req)).cast("int"),
        "has_xss_keyword": contains_any(req, XSS_KEYWORDS).cast("int"),
        "has_path_traversal": contains_any(req, TRAVERSAL_KEYWORDS).cast("int"),
        "is_scanner_user_agent": contains_any(ua, SCANNER_AGENTS).cast("int"),
    }
    return base.select(
        *df.columns,
        *[values[n].alias(FEATURE_PREFIX + n) for n in FEATURE_NAMES],
        F.lit(FEATURE_VERSION).alias("feature_version"),
        F.array(*[F.lit(n) for n in FEATURE_NAMES]).alias("feature_names"),
    )


def feature_columns(df: DataFrame) -> list[str]:
    """Feature columns present, in the fixed order, then any others sorted."""
    preferred = [FEATURE_PREFIX + n for n in FEATURE_NAMES if FEATURE_PREFIX + n in df.columns]
    rest = sorted(c for c in df.columns if c.startswith(FEATURE_PREFIX) and c not in preferred
                  and c not in ("feature_names", "feature_version"))
    return preferred + rest


def numeric_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Feature columns as doubles, NULL and text that is no number as 0."""
    columns = columns or feature_columns(df)
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in columns})
