"""Normalized rows to decoded, cleaned request text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.functions.columns import pinned
from logwarden.functions.decode import clean_unicode, decode_rounds, drop_controls, SPACES
from logwarden.schema import PREPROCESS_FIELDS

# Fixed value: decode rounds.
MAX_ROUNDS = 5
# Upstream may already hold these two.
_REUSABLE = {"decoded_uri", "decoded_query_string"}
_FIELDS = [("uri", "uri"), ("query_string", "query_string"), ("user_agent", "user_agent"),
           ("method", "http_method")]


def preprocess(df: DataFrame, max_rounds: int = MAX_ROUNDS, separator: str = " | ",
               max_length: int | None = None, overwrite: bool = True, full_nfkc: bool = False) -> DataFrame:
    """Adds the decoded and normalized text columns with their metadata.

    Texts are taken whole; with ``max_length`` longer ones are cut there and marked truncated.
    ``overwrite=False`` refuses a table that already holds them; otherwise the rows
    are marked ``preprocess_fields_overwritten``.
    """
    clash = sorted((set(df.columns) & set(PREPROCESS_FIELDS)) - _REUSABLE)
    if clash and not overwrite:
        raise ValueError("table already contains preprocessing columns: " + ", ".join(clash))

    def given(source: str) -> Column:
        return F.coalesce(F.col(source).cast("string"), F.lit("")) if source in df.columns else F.lit("")

    text = {f"_in_{n}": (F.substring(given(s), 1, max_length) if max_length else given(s)) for n, s in _FIELDS}
    cut = {f"_cut_{n}": (F.length(given(s)) > max_length if max_length else F.lit(False)) for n, s in _FIELDS}
    step1 = df.drop(*clash).withColumns({**text, **cut}) if not clash else df.withColumns({**text, **cut})
    step2 = step1.withColumns({
        "_d_uri": pinned(decode_rounds(F.col("_in_uri"), max_rounds)),
        "_d_query_string": pinned(decode_rounds(F.col("_in_query_string"), max_rounds, plus_first=True)),
        "_d_user_agent": pinned(decode_rounds(F.col("_in_user_agent"), max_rounds)),
    })
    step3 = step2.withColumns({
        "_f_uri": clean_unicode(F.col("_d_uri.text"), full_nfkc),
        "_f_query_string": clean_unicode(F.col("_d_query_string.text"), full_nfkc),
        "_f_user_agent": clean_unicode(F.col("_d_user_agent.text"), full_nfkc),
        "_f_method": clean_unicode(F.col("_in_method"), full_nfkc),
    })
    names = [n for n, _ in _FIELDS]
    step4 = step3.withColumns({f"_n_{n}": drop_controls(F.col(f"_f_{n}")) for n in names} | {
        f"_c_{n}": F.col(f"_f_{n}").rlike(r"[\p{Cc}\p{Cf}]") for n in names})
    url = F.when(F.col("_n_query_string") != "", F.concat_ws("?", "_n_uri", "_n_query_string")).otherwise(F.col("_n_uri"))
    step5 = step4.withColumn("_url", url)

    decoded = ["uri", "query_string", "user_agent"]
    depth = {n: F.col(f"_d_{n}.depth") for n in decoded}
    changed = {n: F.col(f"_d_{n}.text") != F.col(f"_in_{n}") for n in decoded}
    limit = {n: F.col(f"_d_{n}.limit_reached") for n in decoded}
    control = {n: F.col(f"_c_{n}") for n in names}
    request = F.trim(F.regexp_replace(F.concat_ws(
        separator,
        F.concat(F.lit("method="), F.col("_n_method")),
        F.concat(F.lit("url="), F.col("_url")),
        F.concat(F.lit("user_agent="), F.col("_n_user_agent"))), SPACES, " "))
    errors = F.array_compact(F.array(
        F.lit("preprocess_fields_overwritten" if clash else None).cast("string"),
        *[F.when(F.col(f"_cut_{n}"), f"{s}_truncated") for n, s in _FIELDS],
        *[F.when(limit[n], f"decode_limit_reached_{n}") for n in decoded],
        *[F.when(control[n], f"control_chars_removed_{s}") for n, s in _FIELDS],
    ))
    out = {
        "decoded_uri": F.col("_d_uri.text"),
        "decoded_query_string": F.col("_d_query_string.text"),
        "decoded_user_agent": F.col("_d_user_agent.text"),
        "normalized_uri": F.col("_n_uri"),
        "normalized_query_string": F.col("_n_query_string"),
        "normalized_user_agent": F.col("_n_user_agent"),
        "normalized_method": F.col("_n_method"),
        "normalized_url": F.col("_url"),
        "normalized_request": request,
        "normalized_request_fields": F.struct(
            F.col("_n_method").alias("method"), F.col("_url").alias("url"), F.col("_n_uri").alias("uri"),
            F.col("_n_query_string").alias("query_string"), F.col("_n_user_agent").alias("user_agent")),
        **{f"decode_depth_{n}": depth[n] for n in decoded},
        "decode_depth": F.greatest(*depth.values()),
        **{f"decode_changed_{n}": changed[n] for n in decoded},
        "decode_changed": changed["uri"] | changed["query_string"] | changed["user_agent"],
        **{f"decode_limit_reached_{n}": limit[n] for n in decoded},
        "decode_limit_reached": limit["uri"] | limit["query_string"] | limit["user_agent"],
        **{f"removed_control_chars_{n}": control[n] for n in decoded},
        "removed_control_chars": control["uri"] | control["query_string"] | control["user_agent"] | control["method"],
        "preprocess_errors": errors,
    }
    kept = [c for c in df.columns if c not in PREPROCESS_FIELDS]
    done = step5.select(*kept, *[c.alias(n) for n, c in out.items()])
    return done.withColumn("preprocess_status", F.when(F.size("preprocess_errors") > 0, "error").otherwise("success")) \
        .select(*kept, *PREPROCESS_FIELDS)
