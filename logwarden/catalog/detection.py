"""Decoding, features, rules and risk over web traffic, pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from logwarden.catalog.base import REQ, WEB_SQL, joined, register, requests, table, text_table, web_requests
from logwarden.functions.decode import clean_unicode, drop_controls
from logwarden.functions.text import split_uri, valid_ip
from logwarden.operators.features import (
    SCANNER_AGENTS, SPECIAL_CHARS, SQL_KEYWORDS, TRAVERSAL_KEYWORDS, XSS_KEYWORDS, count_chars,
    extract_features, query_params,
)
from logwarden.operators.analyst import embedding_text, stored_embedding_text
from logwarden.operators.preprocess import preprocess
from logwarden.operators.risk import score_risk
from logwarden.operators.rule_packs import BROAD_RULES, DEFAULT_RULES
from logwarden.operators.rules import detect, load_rules, match_rows
from logwarden.operators.text_blocks import character_entropy
from logwarden.schema import FEATURE_NAMES


def web_rows(spark, sf):
    """Web traffic with its target split, ready for decoding."""
    w = web_requests(spark, sf)
    parts = split_uri(F.col("raw_uri"))
    return w.withColumns({n: c for n, c in parts.items()}).withColumn("original_url", F.col("raw_uri"))


# Decoded and normalized fields of the same traffic; url_decode runs to its fixed point.
DECODED_SQL = WEB_SQL + """, s AS (SELECT *, split_part(raw_uri, '?', 1) AS u0,
     CASE WHEN contains(raw_uri, '?') THEN substr(raw_uri, length(split_part(raw_uri, '?', 1)) + 2) ELSE '' END AS q0 FROM web),
  d AS (SELECT *, url_decode(u0) AS u1, url_decode(url_decode(u0)) AS u2, url_decode(replace(q0, '+', ' ')) AS q1 FROM s),
  n AS (SELECT *, trim(lower(u2)) AS nu, trim(regexp_replace(lower(q1), ' +', ' ', 'g')) AS nq, lower(user_agent) AS na, lower(http_method) AS nm,
          (u1 <> u0)::INT + (u2 <> u1)::INT AS du, (q1 <> q0)::INT AS dq FROM d),
  pre AS (SELECT *, CASE WHEN nq <> '' THEN concat(nu, '?', nq) ELSE nu END AS url, greatest(du, dq) AS depth FROM n),
  req AS (SELECT *, concat('method=', nm, ' | url=', url, ' | user_agent=', na) AS request FROM pre)"""


@register("P11_uri_split", WEB_SQL + """ SELECT event_id, split_part(raw_uri, '?', 1) AS uri,
   CASE WHEN contains(raw_uri, '?') THEN substr(raw_uri, length(split_part(raw_uri, '?', 1)) + 2) ELSE '' END AS query_string, NULL::VARCHAR AS fragment FROM web""")
def p11(spark, sf):
    return web_rows(spark, sf).select("event_id", "uri", "query_string", "fragment")


@register("P11_page_url_split", """WITH a AS (SELECT page_id, url, split_part(url, '#', 1) AS b, CASE WHEN contains(url, '#') THEN substr(url, length(split_part(url, '#', 1)) + 2) END AS fragment FROM pages),
  c AS (SELECT *, split_part(b, '?', 1) AS w, CASE WHEN contains(b, '?') THEN substr(b, length(split_part(b, '?', 1)) + 2) ELSE '' END AS query_string FROM a)
  SELECT page_id, coalesce(nullif(regexp_replace(w, '^[a-z]+://[^/]*', ''), ''), w) AS uri, query_string, nullif(fragment, '') AS fragment FROM c""")
def p11_pages(spark, sf):
    parts = split_uri(F.col("url"))
    return text_table(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in parts.items()])


@register("P13_decode_rounds", DECODED_SQL + " SELECT event_id, u2 AS decoded_uri, q1 AS decoded_query_string, depth::INT AS decode_depth, depth > 0 AS decode_changed FROM req")
def p13(spark, sf):
    return preprocess(web_rows(spark, sf)).select("event_id", "decoded_uri", "decoded_query_string", "decode_depth", "decode_changed")


@register("P14_P16_normalized_request", DECODED_SQL + " SELECT event_id, nu AS normalized_uri, nq AS normalized_query_string, url AS normalized_url, request AS normalized_request FROM req")
def p16(spark, sf):
    return preprocess(web_rows(spark, sf)).select(
        "event_id", "normalized_uri", "normalized_query_string", "normalized_url", "normalized_request")


@register("P14_document_cleanup", r"""SELECT doc_id, length(t) AS n_clean, md5(t) AS digest FROM (
  SELECT doc_id, trim(regexp_replace(regexp_replace(lower(nfkc), '[\p{Cc}\p{Cf}]', '', 'g'), '[ \x{1680}\x{2028}\x{2029}]+', ' ', 'g'), ' ') AS t FROM (
    SELECT doc_id, text AS nfkc FROM documents))""")
def p14(spark, sf):
    d = text_table(spark, sf, "documents")
    t = drop_controls(clean_unicode(F.col("text")))
    return d.select("doc_id", F.length(t).cast("bigint").alias("n_clean"), F.md5(t).alias("digest"))


@register("P15_length_guard", "SELECT doc_id, length(text) > 2000 AS truncated, CASE WHEN length(text) > 2000 THEN 'error' ELSE 'success' END AS guard_status FROM documents")
def p15(spark, sf):
    d = text_table(spark, sf, "documents").select("doc_id", F.col("text").alias("http_method"))
    p = preprocess(d, max_length=2_000)
    cut = F.array_contains("preprocess_errors", "http_method_truncated")
    return p.select("doc_id", cut.alias("truncated"), F.when(cut, "error").otherwise("success").alias("guard_status"))


@register("P3_ip_validation", WEB_SQL + """ SELECT event_id, CASE WHEN k % 4 = 0 THEN source_ip WHEN k % 4 = 1 THEN concat('2001:db8::', k) END AS ip FROM web""")
def p3(spark, sf):
    w = table(spark, sf, "events").select("event_id", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k")).join(
        web_requests(spark, sf).select("event_id", "source_ip"), "event_id")
    text = (
        F.when(F.col("k") % 4 == 0, F.col("source_ip")).when(F.col("k") % 4 == 1, F.concat(F.lit("2001:DB8::"), F.col("k").cast("string")))
        .when(F.col("k") % 4 == 2, F.concat(F.col("source_ip"), F.lit(".9"))).otherwise("1.2.3.04")
    )
    return w.select("event_id", valid_ip(text).alias("ip"))


# --- features --------------------------------------------------------------------------------

def _chars(expr: str, chars: str) -> str:
    inner = "".join("\\" + c if c in "\\]^-[" else c for c in chars).replace("'", "''")
    return f"(length({expr}) - length(regexp_replace({expr}, '[{inner}]', '', 'g')))"


DOC_COUNTS = [("special", SPECIAL_CHARS), ("slash", "/"), ("dot", "."), ("quote", "'\""), ("percent", "%"), ("equals", "="), ("hyphen", "-")]


@register("F3_document_char_counts", "SELECT doc_id, " + ", ".join(f"{_chars('text', c)}::INT AS {n}_count" for n, c in DOC_COUNTS)
          + r", length(regexp_replace(text, '[^\p{Nd}]', '', 'g'))::INT AS digit_count, length(regexp_replace(text, '[^\p{L}]', '', 'g'))::INT AS alpha_count FROM documents")
def f3(spark, sf):
    d = text_table(spark, sf, "documents")
    return d.select("doc_id", *[count_chars(F.col("text"), c).alias(f"{n}_count") for n, c in DOC_COUNTS],
                    F.regexp_count("text", F.lit(r"\p{Nd}")).alias("digit_count"), F.regexp_count("text", F.lit(r"\p{L}")).alias("alpha_count"))


def entropy_sql(source: str, key: str, text: str) -> str:
    return f"""WITH c AS (SELECT {key}, ch, count(*) AS n FROM (SELECT {key}, unnest(string_split({text}, '')) AS ch FROM {source}) WHERE ch <> '' GROUP BY 1, 2),
      t AS (SELECT {key}, sum(n) AS total FROM c GROUP BY 1)
    SELECT {key}, round(-sum(n / total * log2(n / total)), 4) AS entropy FROM c JOIN t USING ({key}) GROUP BY 1"""


@register("F4_document_entropy", entropy_sql("documents", "doc_id", "text"))
def f4(spark, sf):
    return character_entropy(table(spark, sf, "documents"), "doc_id", F.col("text")).withColumnRenamed("doc", "doc_id")


@register("F4_page_entropy", entropy_sql("pages", "page_id", "html"))
def f4_pages(spark, sf):
    return character_entropy(table(spark, sf, "pages"), "page_id", F.col("html")).withColumnRenamed("doc", "page_id")


@register("F2_query_params", DECODED_SQL + """, p AS (SELECT event_id, unnest(string_split(nq, '&')) AS part FROM req WHERE nq <> ''),
  x AS (SELECT event_id, url_decode(replace(split_part(part, '=', 1), '+', ' ')) AS name,
     url_decode(replace(CASE WHEN contains(part, '=') THEN substr(part, length(split_part(part, '=', 1)) + 2) ELSE '' END, '+', ' ')) AS val FROM p WHERE part <> '')
  SELECT event_id, count(*)::INT AS param_count, round(avg(length(name)), 4) AS avg_param_name_length, round(avg(length(val)), 4) AS avg_param_value_length FROM x GROUP BY 1""")
def f2(spark, sf):
    f = extract_features(preprocess(web_rows(spark, sf)))
    return f.where("feature_param_count > 0").select(
        "event_id", F.col("feature_param_count").alias("param_count"), F.col("feature_avg_param_name_length").alias("avg_param_name_length"),
        F.col("feature_avg_param_value_length").alias("avg_param_value_length"))


@register("F2_page_query_params", """WITH q AS (SELECT page_id, split_part(split_part(url, '#', 1), '?', 2) AS q FROM pages),
  p AS (SELECT page_id, unnest(string_split(q, '&')) AS part FROM q WHERE q <> '')
  SELECT page_id, split_part(part, '=', 1) AS name, url_decode(substr(part, length(split_part(part, '=', 1)) + 2)) AS val FROM p WHERE part <> ''""")
def f2_pages(spark, sf):
    query = split_uri(F.col("url"))["query_string"]
    p = text_table(spark, sf, "pages").select("page_id", F.explode(query_params(query)).alias("p"))
    return p.select("page_id", F.col("p.name").alias("name"), F.col("p.value").alias("val"))


def _has(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(expr, w.replace("'", "''")) for w in words) + ")::INT"


EVASION_RE2 = r"(?i)(?:''|\b)(?:\s|/\*.*?\*/|%0a|%0d|%09)*(?:or|and)(?:\s|/\*.*?\*/|%0a|%0d|%09)+\d+\s*=\s*\d+"
UNION_RE2 = r"(?i)\bunion(?:\s|/\*.*?\*/)+select\b"
FLAGS_SQL = f"""{_has('request', SQL_KEYWORDS)} AS has_sql_keyword,
   (regexp_matches(nq, '{EVASION_RE2}') OR regexp_matches(request, '{EVASION_RE2}') OR regexp_matches(nq, '{UNION_RE2}') OR regexp_matches(request, '{UNION_RE2}'))::INT AS has_sqli_evasion_pattern,
   {_has('request', XSS_KEYWORDS)} AS has_xss_keyword, {_has('request', TRAVERSAL_KEYWORDS)} AS has_path_traversal, {_has('na', SCANNER_AGENTS)} AS is_scanner_user_agent"""


@register("F1_F10_request_features", DECODED_SQL + f""" SELECT event_id, length(nu)::INT AS uri_length, length(nq)::INT AS query_length, length(na)::INT AS user_agent_length,
   {_chars('nu', SPECIAL_CHARS)}::INT AS uri_special_char_count, {_chars('nq', SPECIAL_CHARS)}::INT AS query_special_char_count, {_chars('na', SPECIAL_CHARS)}::INT AS ua_special_char_count,
   depth::INT AS decode_depth, {FLAGS_SQL} FROM req""")
def f1(spark, sf):
    f = extract_features(preprocess(web_rows(spark, sf)))
    names = ["uri_length", "query_length", "user_agent_length", "uri_special_char_count", "query_special_char_count",
             "ua_special_char_count", "decode_depth", "has_sql_keyword", "has_sqli_evasion_pattern", "has_xss_keyword",
             "has_path_traversal", "is_scanner_user_agent"]
    return f.select("event_id", *[F.col(f"feature_{n}").alias(n) for n in names])


def _all_features_sql() -> str:
    """Every feature by name, over the decoded fields nu, nq and na and the parameter means."""
    signs = {"special": SPECIAL_CHARS, "slash": "/", "backslash": "\\", "dot": ".", "quote": "'\"", "angle_bracket": "<>", "percent": "%", "equals": "=",
             "ampersand": "&", "semicolon": ";", "hyphen": "-"}
    out = {"uri_length": "length(nu)", "query_length": "length(nq)", "user_agent_length": "length(na)", "param_count": "coalesce(param_count, 0)",
           "avg_param_name_length": "coalesce(name_length, 0.0::DOUBLE)", "avg_param_value_length": "coalesce(value_length, 0.0::DOUBLE)"}
    for prefix, text in (("uri", "nu"), ("query", "nq"), ("ua", "na")):
        for name, chars in signs.items():
            out[f"{prefix}_{name}{'_char' if name == 'special' else ''}_count"] = _chars(text, chars)
        out[f"{prefix}_digit_count"] = rf"length({text}) - length(regexp_replace({text}, '\p{{Nd}}', '', 'g'))"
        out[f"{prefix}_alpha_count"] = rf"length({text}) - length(regexp_replace({text}, '\p{{L}}', '', 'g'))"
        share = f"((length({text}) - length(replace({text}, ch, ''))) / length({text}))"
        out[f"{prefix}_entropy"] = f"CASE WHEN {text} = '' THEN 0.0::DOUBLE ELSE round(-list_sum(list_transform(list_distinct(string_split({text}, '')), lambda ch: {share} * log2({share}))), 4) END"
    out |= {"status_code_missing": "event_id % 2 = 0", "status_code_invalid": "event_id % 3 = 0", "response_size_missing": "event_id % 4 <> 0", "response_size_invalid": "event_id % 5 = 0"}
    for name, depth in (("", "depth"), ("_uri", "du"), ("_query", "dq"), ("_user_agent", "0")):
        out |= {f"decode_depth{name}": depth, f"decode_changed{name}": f"{depth} > 0"}
    out |= {"decode_limit_reached": "0", "removed_control_chars": "0"}
    return ", ".join(f"{out[n]} AS {n}" if n in ("avg_param_name_length", "avg_param_value_length") or n.endswith("entropy") else f"({out[n]})::INT AS {n}"
                     for n in FEATURE_NAMES if n in out)


@register("F1_F10_all_features", DECODED_SQL + """, part AS (SELECT event_id, unnest(string_split(nq, '&')) AS part FROM req WHERE nq <> ''),
  px AS (SELECT event_id, url_decode(replace(split_part(part, '=', 1), '+', ' ')) AS name,
     url_decode(replace(CASE WHEN contains(part, '=') THEN substr(part, length(split_part(part, '=', 1)) + 2) ELSE '' END, '+', ' ')) AS val FROM part WHERE part <> ''),
  pm AS (SELECT event_id, count(*) AS param_count, round(avg(length(name)), 4) AS name_length, round(avg(length(val)), 4) AS value_length FROM px GROUP BY 1)
  SELECT event_id, """ + _all_features_sql() + f", {FLAGS_SQL} FROM req LEFT JOIN pm USING (event_id)")
def f1_all(spark, sf):
    """All sixty features; flags come as booleans, numbers and words."""
    i = F.col("event_id")
    rows = web_rows(spark, sf).withColumns({
        "status_code_missing": i % 2 == 0, "status_code_invalid": F.when(i % 3 == 0, " Yes").otherwise("no"),
        "response_size_missing": i % 4, "response_size_invalid": F.when(i % 5 == 0, "ERROR")})
    f = extract_features(preprocess(rows))
    return f.select("event_id", *[F.col(f"feature_{n}").alias(n) for n in FEATURE_NAMES])


@register("F7_document_keyword_flags", f"""SELECT doc_id, {_has('lower(text)', SQL_KEYWORDS)} AS sql_words, {_has('lower(text)', XSS_KEYWORDS)} AS xss_words,
   {_has('lower(text)', TRAVERSAL_KEYWORDS)} AS traversal_words FROM documents""")
def f7(spark, sf):
    d = text_table(spark, sf, "documents").select("doc_id", F.col("text").alias("normalized_request"))
    f = extract_features(d)
    return f.select("doc_id", F.col("feature_has_sql_keyword").alias("sql_words"), F.col("feature_has_xss_keyword").alias("xss_words"),
                    F.col("feature_has_path_traversal").alias("traversal_words"))


# --- rules -----------------------------------------------------------------------------------

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The two look-ahead rules as plain matches, since DuckDB's engine has no look-ahead.
_NO_LOOKAHEAD = {
    "sqli_comment_with_context": [r"(?:--|#|/\*).*(?:'|\bunion\b|\bselect\b|\bor\b|\band\b|;)"],
    "sensitive_admin_success_or_forbidden": [
        r"(?:^|/)(?:admin|administrator|wp-admin|phpmyadmin|manager|console)(?:/|$)", r"\b(?:status=)?(?:200|401|403)\b"],
}


def hits_sql(rules: list[dict], columns: dict[str, str]) -> str:
    """One 0/1 column per rule over the given target expressions."""
    out = []
    for r in rules:
        target = columns.get(r["field"])
        if target is None:
            test = "false"
        elif r["type"] == "contains":
            test = f"contains(lower({target}), {_quoted(r['pattern'].lower())})"
        else:
            test = " AND ".join(f"regexp_matches({target}, {_quoted('(?i)' + p)})" for p in _NO_LOOKAHEAD.get(r["id"], [r["pattern"]]))
        out.append(f"({test}) AS {r['id']}")
    return ", ".join(out)


def verdict_sql(rules: list[dict], source: str, key: str, columns: dict[str, str]) -> str:
    ranks = {"none": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
    cats = sorted({r["category"] for r in rules})
    rows = " UNION ALL ".join(
        f"SELECT {key}, '{r['id']}' AS rule_id, '{r['category']}' AS category, {r['score']} AS score, {ranks[r['severity']]} AS rnk, {i} AS pos FROM h WHERE {r['id']}"
        for i, r in enumerate(rules))
    assert cats
    return f""", h AS (SELECT {key}, {hits_sql(rules, columns)} FROM {source}), m AS ({rows}),
      c AS (SELECT {key}, category, max(score) AS score, max(rnk) AS rnk FROM m GROUP BY 1, 2),
      t AS (SELECT {key}, least(100, sum(score) + 10 * (count(*) - 1))::INT AS rule_score, max(rnk) AS rnk,
              arg_max(category, {{'s': score, 'r': rnk, 'c': category}}) AS attack_type, array_to_string(list(category ORDER BY category), ',') AS attack_types,
              array_to_string(list(concat(category, '=', score) ORDER BY category), ',') AS score_by_category FROM c GROUP BY 1),
      ids AS (SELECT {key}, array_to_string(list(rule_id ORDER BY pos), ',') AS matched_rule_ids FROM m GROUP BY 1)
    SELECT {key}, coalesce(rule_score, 0) AS rule_score, CASE WHEN coalesce(rule_score, 0) >= 70 THEN 'malicious' WHEN coalesce(rule_score, 0) >= 25 THEN 'suspicious' ELSE 'benign' END AS rule_label,
      CASE coalesce(rnk, 0) WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS rule_severity,
      attack_type, coalesce(attack_types, '') AS attack_types, coalesce(score_by_category, '') AS score_by_category, coalesce(matched_rule_ids, '') AS matched_rule_ids
    FROM {source} LEFT JOIN t USING ({key}) LEFT JOIN ids USING ({key})"""


def verdict(detected, key):
    scores = F.transform(F.map_entries("score_by_category"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return detected.select(key, "rule_score", "rule_label", "rule_severity", "attack_type", joined("attack_types").alias("attack_types"),
                           joined(scores).alias("score_by_category"), joined("matched_rule_ids").alias("matched_rule_ids"))


WEB_TARGETS = {"request": "request", "query_string": "nq", "uri": "nu", "url": "url", "user_agent": "na", "raw_uri": "raw_uri",
               "decode_depth": "depth::VARCHAR", "removed_control_chars": "'false'"}


@register("D2_D7_rule_verdicts", DECODED_SQL + verdict_sql(DEFAULT_RULES, "req", "event_id", WEB_TARGETS))
def d2(spark, sf):
    return verdict(detect(preprocess(web_rows(spark, sf))), "event_id")


@register("D2_broad_rule_verdicts", DECODED_SQL + verdict_sql(BROAD_RULES, "req", "event_id", WEB_TARGETS))
def d2_broad(spark, sf):
    rules, _ = load_rules(BROAD_RULES)
    return verdict(detect(preprocess(web_rows(spark, sf)), rules), "event_id")


@register("D2_page_rule_verdicts", "WITH x AS (SELECT page_id, html AS request FROM pages)" + verdict_sql(BROAD_RULES, "x", "page_id", {"request": "request"}))
def d2_pages(spark, sf):
    p = text_table(spark, sf, "pages").select("page_id", F.col("html").alias("normalized_request"))
    return verdict(detect(p, BROAD_RULES), "page_id")


@register("J1_document_rule_matches", "WITH h AS (SELECT doc_id, " + hits_sql(BROAD_RULES, {"request": "text"}) + " FROM documents) " + " UNION ALL ".join(
    f"SELECT doc_id, '{r['id']}' AS id, '{r['category']}' AS category, {r['score']} AS score FROM h WHERE {r['id']}" for r in BROAD_RULES))
def j1(spark, sf):
    d = text_table(spark, sf, "documents").select("doc_id", F.col("text").alias("normalized_request"))
    return match_rows(detect(d, BROAD_RULES), "doc_id").select("doc_id", "id", "category", "score")


@register("D9_detector_errors", "SELECT 'error' AS detector_status, 13::INT AS missing_fields, count(*) AS n_rows FROM documents")
def d9(spark, sf):
    d = text_table(spark, sf, "documents").select("doc_id", F.col("text").alias("normalized_user_agent"))
    missing = F.size(F.filter("detector_errors", lambda e: e.startswith("field_missing:")))
    return detect(d).groupBy("detector_status", missing.alias("missing_fields")).agg(F.count(F.lit(1)).alias("n_rows"))


# --- risk ------------------------------------------------------------------------------------

RISK_INPUT_SQL = """WITH e AS (SELECT event_id, value, event_type, cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k FROM events),
 i AS (SELECT event_id, (k * 7) % 101 AS rule_score, event_type = 'click' OR k % 9 = 0 AS ml_signal, least(1.0, value / 300.0) AS p,
   CASE WHEN k % 3 = 0 THEN 'sqli' WHEN k % 3 = 1 THEN 'Unknown' END AS rt, CASE WHEN k % 4 = 0 THEN 'xss' WHEN k % 4 = 1 THEN 'sqli' ELSE 'unknown' END AS mt,
   (k % 2 = 0)::INT AS f_sql, (k % 5 = 0)::INT AS f_xss, (k % 7 = 0)::INT AS f_trav, (k % 11 = 0)::INT AS f_scan, k AS specials, k % 13 AS params,
   CASE WHEN k % 17 = 0 THEN 503 ELSE 200 END AS status FROM e),
 j AS (SELECT *, CASE WHEN ml_signal THEN greatest(0, least(100, trunc(p * 100)))::INT ELSE 0 END AS ml,
   8 * f_sql + 8 * f_xss + 8 * f_trav + 6 * f_scan + CASE WHEN specials >= 20 THEN 4 ELSE 0 END + CASE WHEN params >= 10 THEN 3 ELSE 0 END + CASE WHEN status >= 500 THEN 3 ELSE 0 END AS bonus,
   CASE WHEN rt <> 'Unknown' THEN rt END AS crt, CASE WHEN ml_signal AND mt <> 'unknown' THEN mt END AS cmt FROM i),
 z AS (SELECT *, least(100, greatest(rule_score, ml) + bonus) AS risk, rule_score > 0 AS rs FROM j)"""


@register("K1_K6_risk_scores", RISK_INPUT_SQL + """ SELECT event_id, ml AS ml_score, bonus AS risk_bonus, risk AS risk_score,
   CASE WHEN risk >= 70 THEN 'malicious' WHEN risk >= 25 THEN 'suspicious' ELSE 'benign' END AS final_label,
   CASE WHEN risk >= 90 THEN 'critical' WHEN risk >= 70 THEN 'high' WHEN risk >= 40 THEN 'medium' WHEN risk >= 25 THEN 'low' ELSE 'none' END AS risk_level,
   risk >= 25 AS should_alert,
   concat_ws(',', CASE WHEN rs THEN 'rules' END, CASE WHEN ml_signal THEN 'ml' END, CASE WHEN bonus > 0 THEN 'features' END) AS detection_sources,
   CASE WHEN rs AND ml_signal AND rule_score = ml THEN 'rules+ml' WHEN rule_score >= ml AND rs THEN 'rules' WHEN ml > rule_score AND ml_signal THEN 'ml' WHEN bonus > 0 THEN 'features' ELSE 'none' END AS primary_signal,
   CASE WHEN cmt IS NOT NULL AND (ml > rule_score OR crt IS NULL) THEN cmt ELSE coalesce(crt, cmt) END AS attack_type,
   concat_ws(',', crt, CASE WHEN cmt IS DISTINCT FROM crt THEN cmt END) AS attack_types FROM z""")
def k1(spark, sf):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    e = table(spark, sf, "events").withColumn("k", k)
    c = F.col("k")
    rows = e.select(
        "event_id", ((c * 7) % 101).alias("rule_score"), ((F.col("event_type") == "click") | (c % 9 == 0)).alias("ml_should_alert"),
        F.least(F.lit(1.0), F.col("value") / 300.0).alias("ml_attack_probability"),
        F.when(c % 3 == 0, "sqli").when(c % 3 == 1, "Unknown").alias("attack_type"),
        F.when(c % 4 == 0, "xss").when(c % 4 == 1, "sqli").otherwise("unknown").alias("ml_attack_type"),
        (c % 2 == 0).cast("int").alias("feature_has_sql_keyword"), (c % 5 == 0).cast("int").alias("feature_has_xss_keyword"),
        (c % 7 == 0).cast("int").alias("feature_has_path_traversal"), (c % 11 == 0).cast("int").alias("feature_is_scanner_user_agent"),
        c.alias("feature_uri_special_char_count"), (c % 13).alias("feature_param_count"),
        F.when(c % 17 == 0, 503).otherwise(200).alias("status_code"))
    s = score_risk(rows)
    return s.select("event_id", F.col("risk_input_scores.ml").alias("ml_score"), "risk_bonus", "risk_score", "final_label", "risk_level", "should_alert",
                    joined("detection_sources").alias("detection_sources"), "primary_signal", "attack_type", joined("attack_types").alias("attack_types"))


# --- text for embedding ----------------------------------------------------------------------

@register("P23_embedding_text", DECODED_SQL + """ SELECT event_id, concat_ws(' | ', concat('method=', nm), concat('path=', nu), CASE WHEN nq <> '' THEN concat('query=', nq) END,
   concat('user_agent=', na), CASE WHEN raw_uri <> nu AND raw_uri <> concat(nu, '?', nq) THEN concat('raw_url=', raw_uri) END,
   CASE WHEN depth > 0 THEN concat('decode_depth=', depth) END) AS embedding_text FROM req""")
def p23(spark, sf):
    p = preprocess(web_rows(spark, sf))
    return p.select("event_id", embedding_text(p).alias("embedding_text"))


@register("P24_stored_embedding_text", REQ + "SELECT event_id, trim(concat(coalesce(attack_type, ''), ' ', uri)) AS embedding_text FROM requests")
def p24(spark, sf):
    r = requests(spark, sf)
    return r.select("event_id", stored_embedding_text(r).alias("embedding_text"))

