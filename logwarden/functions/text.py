"""Text helpers shared by parsing and normalising."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters that text trimming removes: ASCII white space, separators, NEL, NBSP.
TRIM_CHARS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _ipv6_pattern() -> str:
    """Grammar of IPv6 text: eight groups, or fewer around one ``::``."""
    h = "[0-9a-f]{1,4}"
    forms = [f"(?:{h}:){{7}}{h}", f"(?:{h}:){{1,7}}:"]
    forms += [f"(?:{h}:){{1,{7 - n}}}(?::{h}){{1,{n}}}" for n in range(1, 7)]
    forms += [f":(?:(?::{h}){{1,7}}|:)"]
    return "(?:" + "|".join(forms) + ")"


IPV6 = _ipv6_pattern()


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIM_CHARS))


def clean_text(c: Column) -> Column:
    """Trimmed text; blank and a lone ``-`` become NULL."""
    t = strip(c.cast("string"))
    return F.when((t != "") & (t != "-"), t)


def valid_ip(c: Column) -> Column:
    """Lower-cased IP text when it is a valid v4 or v6 address, else NULL."""
    t = F.lower(strip(c))
    no_zone = F.regexp_replace(t, r"(?<=[0-9a-f:])%[^%]+$", "")
    hexed = F.regexp_replace(no_zone, rf"(?<=:){IPV4}$", "0:0")
    return F.when(t.rlike(f"^{IPV4}$"), t).when(
        t.contains(":") & hexed.rlike(f"^{IPV6}$"), t)


def to_int(c: Column) -> Column:
    """Integer text to BIGINT; anything else to NULL."""
    t = strip(c.cast("string"))
    return F.when(t.rlike(r"^[+-]?[0-9]{1,18}$"), t.try_cast("bigint"))


def loose_int(c: Column, default: int = 0) -> Column:
    """Number text to BIGINT by truncation, as ``int(float(x))`` does."""
    return F.coalesce(c.try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def split_uri(raw_uri: Column) -> dict[str, Column]:
    """Path, query and fragment of a request target.

    The fragment starts at the first ``#``; the query at the first ``?`` before it.
    An absolute or scheme-relative target loses its scheme and host.
    """
    before = F.substring_index(raw_uri, "#", 1)
    whole_path = F.substring_index(before, "?", 1)
    host = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/]*"
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
    path = F.when(whole_path.rlike(host), F.regexp_replace(whole_path, host, "")).otherwise(
        F.regexp_replace(whole_path, scheme, ""))
    path = F.coalesce(F.nullif(path, F.lit("")), F.nullif(whole_path, F.lit("")))
    query = F.when(before.contains("?"), F.substring(before, F.length(whole_path) + 2, F.length(before)))
    fragment = F.substring(raw_uri, F.length(before) + 2, F.length(raw_uri))
    present = raw_uri.isNotNull() & (raw_uri != "")
    return {
        "uri": F.when(present, path),
        "query_string": F.when(present, F.coalesce(query, F.lit(""))),
        "fragment": F.when(present, F.nullif(fragment, F.lit(""))),
    }


# Words of sensitive endpoints.
SENSITIVE_WORDS = ["backup", "db", "admin", "config", "settings"]


def endpoint_group(uri: Column) -> Column:
    """Coarse group of a URI: sensitive, root, api_<name> or the first path segment."""
    path = F.lower(strip(F.coalesce(uri, F.lit(""))))
    path = strip(F.substring_index(path, "?", 1))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return (
        F.when(path.rlike("|".join(SENSITIVE_WORDS)), "sensitive")
        .when(first.isNull(), "root")
        .when((first == "api") & second.isNotNull(), F.concat(F.lit("api_"), second))
        .otherwise(first)
    )


# Accepted time formats.
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
    "dd/MMM/yyyy:HH:mm:ss Z",
]


def any_timestamp(c: Column) -> Column:
    """Timestamp text in ISO form or one of the accepted formats; NULL otherwise."""
    t = strip(c.cast("string"))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(t, F.lit(f)) for f in TIMESTAMP_FORMATS])


def hour_of_week(ts: Column) -> Column:
    """0 = Sunday 00:00 ... 167 = Saturday 23:00."""
    return ((F.dayofweek(ts) - 1) * 24 + F.hour(ts)).cast("int")
