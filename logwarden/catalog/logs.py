"""Log files and structured inputs, written from the event table and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from logwarden.catalog.base import WEB_SQL, joined, ntz, register, table, web_requests
from logwarden.catalog.detection import DECODED_SQL, FLAGS_SQL, WEB_TARGETS, verdict_sql
from logwarden.operators.normalize import normalize
from logwarden.operators.parse import detect_server_type, detect_server_type_by_keyword, parse_access_log, parse_iis_log
from logwarden.operators.rule_packs import DEFAULT_RULES
from logwarden.plans.flow import analyze_lines
from logwarden.session import new_work_path
from logwarden.sources import lines as S, sinks, structured as C
from logwarden.streaming.ingest import score_batch, stream_log_lines, upsert_stream

LINE_SQL = """concat(source_ip, ' - - [', strftime(ts, '%d/%b/%Y:%H:%M:%S'), ' +0000] "', http_method, ' ', raw_uri, ' HTTP/1.1" ', status_code, ' ',
   response_size, ' "', referrer, '" "', user_agent, '"')"""


def log_lines(spark, sf):
    """Access-log lines of the web traffic; the event id serves as line number."""
    w = web_requests(spark, sf)
    return w.select("event_id", C.render_log_line(w).alias("line"), F.col("event_id").alias("line_number"), F.lit("events").alias("file"))


def written_lines(spark, sf):
    """Log files on disk: continuation lines, bad UTF-8 and blank lines are mixed in."""
    rows = log_lines(spark, sf)
    extra = F.when(F.col("event_id") % 50 == 1, F.concat(F.col("line"), F.lit("\n\tcontinued "), F.col("event_id").cast("string"))).when(
        F.col("event_id") % 50 == 2, F.concat(F.col("line"), F.lit(" caf"), F.unhex(F.lit("E9")).cast("string"))).when(
        F.col("event_id") % 50 == 3, F.concat(F.col("line"), F.lit("\r\n   "))).otherwise(F.col("line"))
    path = new_work_path(spark, "logs") + "/nginx"
    rows.select(extra.alias("value")).write.text(path)
    return path


@register("S12_render_log_line", WEB_SQL + f" SELECT event_id, {LINE_SQL} AS line FROM web")
def s12(spark, sf):
    return log_lines(spark, sf).select("event_id", "line")


@register("S1_S4_log_records", WEB_SQL + f""" SELECT CASE event_id % 50 WHEN 1 THEN concat({LINE_SQL}, '\\n', chr(9), 'continued ', event_id) WHEN 2 THEN concat({LINE_SQL}, ' café') ELSE {LINE_SQL} END AS line,
   CASE event_id % 50 WHEN 1 THEN 'continuation_merged' WHEN 2 THEN 'decode_fallback_latin1' ELSE '' END AS flags,
   CASE event_id % 50 WHEN 1 THEN 1 ELSE 0 END::BIGINT AS extra_lines, 'nginx' AS server_type FROM web""")
def s1(spark, sf):
    r = S.read_log_records(spark, written_lines(spark, sf))
    return r.select("line", joined("flags").alias("flags"), (F.col("physical_line_range")[1] - F.col("physical_line_range")[0]).alias("extra_lines"), "server_type")


@register("R3_collector_quality", """SELECT count(*) FILTER (event_id % 50 = 2) AS decode_error_records, 0::BIGINT AS had_bom_records,
   count(*) FILTER (event_id % 50 = 1) AS continuation_merged_records FROM events""")
def r3(spark, sf):
    return S.collector_quality(S.read_log_records(spark, written_lines(spark, sf)))


@register("N1_line_numbers", "SELECT count(*) AS records, count(*) AS numbers, true AS consecutive FROM events")
def n1(spark, sf):
    r = S.read_log_records(spark, written_lines(spark, sf))
    per = r.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("line_number").alias("d"), F.max("line_number").alias("m"))
    return per.agg(F.sum("n").alias("records"), F.sum("d").alias("numbers"), F.bool_and((F.col("m") == F.col("n")) & (F.col("d") == F.col("n"))).alias("consecutive"))


@register("S5_S7_file_discovery", "SELECT true AS has_files, 'nginx' AS server_type, 'nginx__part' AS run_id_start")
def s5(spark, sf):
    path = written_lines(spark, sf)
    found = S.discover_files(spark, path[: -len("/nginx")])
    return found.groupBy("server_type", F.substring("run_id", 1, 11).alias("run_id_start")).agg(
        (F.count(F.lit(1)) > 0).alias("has_files")).select("has_files", "server_type", "run_id_start")


@register("P1_P8_parse_access_log", WEB_SQL + f""", l AS (SELECT *, {LINE_SQL} AS line FROM web)
   SELECT event_id AS line_number, concat('apache:', event_id, ':', substr(sha1(line), 1, 12)) AS event_id, strftime(ts, '%d/%b/%Y:%H:%M:%S +0000') AS timestamp,
     source_ip, http_method, raw_uri, 'HTTP/1.1' AS http_version, status_code, response_size, referrer, user_agent, 'combined' AS format_profile, 'success' AS parse_status FROM l""")
def p1(spark, sf):
    return parse_access_log(log_lines(spark, sf)).select(
        "line_number", "event_id", "timestamp", "source_ip", "http_method", "raw_uri", "http_version", "status_code",
        "response_size", "referrer", "user_agent", "format_profile", "parse_status")


@register("P1_P7_parse_damaged_lines", WEB_SQL + f""", l AS (SELECT *, event_id % 8 AS kind FROM web)
   SELECT event_id AS line_number, CASE kind WHEN 0 THEN 'Invalid source_ip' WHEN 1 THEN 'Invalid http_method in request field' WHEN 2 THEN 'Invalid status_code'
       WHEN 3 THEN 'Invalid response_size' WHEN 4 THEN 'No Nginx log pattern matched: supported profiles are combined/common with optional trailing custom fields' END AS error_message,
     CASE kind WHEN 5 THEN 'common' WHEN 6 THEN 'combined_with_tail' WHEN 7 THEN 'combined' END AS format_profile,
     CASE WHEN kind IN (5, 6) THEN raw_uri WHEN kind = 7 THEN concat(raw_uri, '"x') END AS raw_uri, CASE WHEN kind = 6 THEN 'rt=0.1' END AS extra_tail FROM l""")
def p7(spark, sf):
    kind = F.col("event_id") % 8
    w = web_requests(spark, sf).withColumns({
        "source_ip": F.when(kind == 0, "10.0.0.999").otherwise(F.col("source_ip")),
        "http_method": F.when(kind == 1, "FETCH").otherwise(F.col("http_method")),
        "status_code": F.when(kind == 2, 999).otherwise(F.col("status_code")),
        "response_size": F.when(kind == 3, "big").otherwise(F.col("response_size").cast("string")),
        "raw_uri": F.when(kind == 7, F.concat("raw_uri", F.lit('"x'))).otherwise(F.col("raw_uri")),
    })
    full = F.regexp_replace(C.render_log_line(w), r'\\"', '"')
    line = F.when(kind == 4, "garbage").when(kind == 5, F.regexp_replace(full, ' "[^"]*" "[^"]*"$', "")).when(
        kind == 6, F.concat(full, F.lit(" rt=0.1"))).otherwise(full)
    rows = w.select(line.alias("line"), F.col("event_id").alias("line_number"))
    return parse_access_log(rows, "nginx").select("line_number", "error_message", "format_profile", "raw_uri", "extra_tail")


def iis_lines(spark, sf):
    """W3C lines in four files; each file changes its header halfway and holds short rows."""
    w = web_requests(spark, sf)
    e = F.col("event_id")
    stem, query = F.substring_index("raw_uri", "?", 1), F.substring_index("raw_uri", "?", -1)
    query = F.when(F.col("raw_uri").contains("?"), query).otherwise("-")
    agent = F.concat(F.lit('"'), F.col("user_agent"), F.lit('"'))
    day, time = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    status = F.col("status_code").cast("string")
    old = F.concat_ws(" ", day, time, "source_ip", "http_method", stem, query, status, agent)
    new = F.concat_ws(" ", "source_ip", "http_method", stem, query, status, day, time, agent)
    late = F.floor(e / 4) % 2 == 1
    body = F.when(e % 9 == 0, F.concat_ws(" ", day, time)).when(late, new).otherwise(old)
    rows = w.select((e % 4).cast("string").alias("file"), (e * 3 + 10).alias("line_number"), body.alias("line"))
    head_old = "#Fields: date time c-ip cs-method cs-uri-stem cs-uri-query sc-status cs(User-Agent)"
    head_new = "#Fields: c-ip cs-method cs-uri-stem cs-uri-query sc-status date time cs(User-Agent)"
    heads = w.select((e % 4).cast("string").alias("file"), (e * 3 + 9).alias("line_number"), F.when(late, head_new).otherwise(head_old).alias("line"))
    comments = w.where(e % 5 == 0).select((e % 4).cast("string").alias("file"), (e * 3 + 8).alias("line_number"), F.lit("#Software: server").alias("line"))
    return rows.unionByName(heads).unionByName(comments)


@register("P5_P6_parse_iis", WEB_SQL + """ SELECT (event_id % 4)::VARCHAR AS file, event_id * 3 + 10 AS line_number,
     CASE WHEN event_id % 9 = 0 THEN 'IIS field count mismatch: expected 8, got 2' END AS error_message,
     CASE WHEN event_id % 9 <> 0 THEN source_ip END AS source_ip, CASE WHEN event_id % 9 <> 0 THEN raw_uri END AS raw_uri,
     CASE WHEN event_id % 9 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp, CASE WHEN event_id % 9 <> 0 THEN user_agent END AS user_agent,
     CASE WHEN event_id % 9 <> 0 THEN count(*) FILTER (event_id % 9 <> 0) OVER (PARTITION BY event_id % 4 ORDER BY event_id) END AS data_line_number FROM web""")
def p5(spark, sf):
    return parse_iis_log(iis_lines(spark, sf)).select(
        "file", "line_number", "error_message", "source_ip", "raw_uri", "timestamp", "user_agent", "data_line_number")


@register("N2_header_forward_fill", """SELECT event_id, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS last_signup FROM events""")
def n2(spark, sf):
    from logwarden.operators.ordered import fill_forward
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 3).alias("grp"), "event_type")
    return fill_forward(e, ["grp"], "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")), "last_signup", block_rows=512).select(
        "event_id", "last_signup")


@register("N3_gaps_and_islands", """SELECT event_id, count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS island FROM events""")
def n3(spark, sf):
    from logwarden.operators.ordered import running_count
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 3).alias("grp"), "event_type")
    return running_count(e, ["grp"], "event_id", F.col("event_type") == "view", "island", block_rows=512).select("event_id", "island")


@register("P9_server_type_by_content", """SELECT (event_id % 4)::VARCHAR AS file, 'iis' AS server_type FROM events GROUP BY 1
   UNION ALL SELECT 'events', 'apache'""")
def p9(spark, sf):
    both = iis_lines(spark, sf).unionByName(log_lines(spark, sf).select("file", "line_number", "line"))
    return detect_server_type(both).select("file", "server_type")


@register("P9_server_type_by_keyword", "SELECT kind AS file, CASE kind WHEN 'click' THEN 'nginx' ELSE 'apache' END AS server_type FROM (SELECT DISTINCT event_type AS kind FROM events)")
def p9_keyword(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("file"), (F.col("event_id") % 40).alias("physical_line"),
                                          F.concat(F.lit("served by "), F.when(F.col("event_type") == "click", "NGINX").otherwise("someone")).alias("line"))
    return detect_server_type_by_keyword(e)


@register("P10_P12_normalize", WEB_SQL + """ SELECT event_id AS line_number, date_trunc('second', ts)::TIMESTAMP AS timestamp, source_ip, http_method, split_part(raw_uri, '?', 1) AS uri,
     CASE WHEN contains(raw_uri, '?') THEN substr(raw_uri, length(split_part(raw_uri, '?', 1)) + 2) ELSE '' END AS query_string, status_code, response_size,
     nullif(referrer, '-') AS referrer, 'success' AS normalize_status, '' AS errors FROM web""")
def p10(spark, sf):
    n = normalize(parse_access_log(log_lines(spark, sf)))
    return n.select("line_number", ntz("timestamp").alias("timestamp"), "source_ip", "http_method", "uri", "query_string", "status_code", "response_size",
                    "referrer", "normalize_status", joined("normalize_errors").alias("errors"))


@register("P10_normalize_damaged", WEB_SQL + """ SELECT event_id AS line_number, 'error' AS normalize_status, CASE WHEN event_id % 2 = 0 THEN 'parse_error' ELSE 'timestamp_invalid' END AS errors,
     CASE WHEN event_id % 2 = 0 THEN 'No Apache log pattern matched: supported profiles are combined/common with optional trailing custom fields'
          ELSE 'normalize_errors=timestamp_invalid' END AS error_message FROM web""")
def p10_damaged(spark, sf):
    bad_time = F.regexp_replace("line", r"\[[^\]]*\]", "[yesterday]")
    rows = log_lines(spark, sf).withColumn("line", F.when(F.col("event_id") % 2 == 0, "garbage").otherwise(bad_time))
    n = normalize(parse_access_log(rows))
    return n.select("line_number", "normalize_status", joined("normalize_errors").alias("errors"), "error_message")


# --- structured inputs -----------------------------------------------------------------------

@register("S8_S11_csv_to_lines", WEB_SQL + f" SELECT {LINE_SQL} AS line FROM web")
def s8(spark, sf):
    w = web_requests(spark, sf)
    path = new_work_path(spark, "csv")
    w.select(F.col("timestamp").alias("Date Time"), F.col("source_ip").alias("src-ip"), F.col("http_method").alias("Verb"), F.col("raw_uri").alias("request_uri"),
             F.col("status_code").alias("sc-status"), F.col("response_size").alias("Content-Length"), F.col("referrer").alias("Referer"),
             F.col("user_agent").alias("cs-user-agent")).write.option("header", "true").option("escape", '"').csv(path)
    return C.structured_to_lines(C.read_csv(spark, path))


@register("S9_json_to_lines", WEB_SQL + f" SELECT {LINE_SQL} AS line FROM web")
def s9(spark, sf):
    w = web_requests(spark, sf)
    path = new_work_path(spark, "json")
    w.select("timestamp", F.col("source_ip").alias("remote_addr"), F.col("http_method").alias("method"), F.col("raw_uri").alias("url"),
             F.col("status_code").alias("status"), F.col("response_size").alias("bytes"), "referrer", F.col("user_agent").alias("ua")).write.json(path)
    return C.structured_to_lines(C.read_json(spark, path, lines=True))


@register("S10_http_blocks", WEB_SQL + """ SELECT http_method AS method, raw_uri, CASE WHEN event_id % 3 = 0 THEN 'HTTP/1.1' ELSE 'HTTP/1.0' END AS http_version, user_agent,
     CASE WHEN event_id % 2 = 0 THEN referrer ELSE '-' END AS referrer, NULL::VARCHAR AS passthrough FROM web
   UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, concat('note ', event_id) FROM web WHERE event_id % 10 = 0""")
def s10(spark, sf):
    w = web_requests(spark, sf)
    e = F.col("event_id")
    first = F.concat(F.concat_ws(" ", "http_method", "raw_uri"), F.when(e % 3 == 0, "").otherwise(" HTTP/1.0"))
    rows = F.array_compact(F.array(
        first, F.concat(F.lit("User-Agent:  "), "user_agent"), F.when(e % 2 == 0, F.concat(F.lit("Referer: "), "referrer")),
        F.lit("Host: example.org"), F.when(e % 4 == 0, F.lit("")), F.when(e % 10 == 0, F.concat(F.lit("note "), e.cast("string")))))
    lines = w.select(F.lit("dump").alias("file"), "event_id", F.posexplode(rows).alias("p", "line")).select(
        "file", (F.col("event_id") * 10 + F.col("p")).alias("physical_line"), "line")
    return C.http_blocks(lines).select("method", "raw_uri", "http_version", "user_agent", "referrer", "passthrough")


@register("S13_line_parts", WEB_SQL + f" SELECT count(*) AS n_lines, true AS small_parts FROM (SELECT {LINE_SQL} AS line FROM web)")
def s13(spark, sf):
    path = new_work_path(spark, "parts")
    limit = 256 * 1024
    sinks.write_line_parts(log_lines(spark, sf), path, limit)
    sizes = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 1).alias("b"))
    return sizes.agg(F.sum("n").alias("n_lines"), (F.max("b") <= limit).alias("small_parts"))


@register("S14_jsonl_round_trip", "SELECT event_id, user_id, event_type FROM events")
def s14(spark, sf):
    path = new_work_path(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf, "events").select("event_id", "user_id", "event_type"), path)
    return spark.read.schema("event_id bigint, user_id bigint, event_type string").json(path)


@register("S15_csv_export", """SELECT event_type AS event_type, concat('{"a":', event_id, '}') AS nested, event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id FROM events""")
def s15(spark, sf):
    path = new_work_path(spark, "export")
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.struct(F.col("event_id").alias("a")).alias("nested"))
    sinks.write_csv(e, path, ["event_type"])
    return spark.read.option("header", "true").option("escape", '"').csv(path)


# --- the whole flow --------------------------------------------------------------------------

ENTRY_SQL = DECODED_SQL + f""", f AS (SELECT *, {FLAGS_SQL} FROM req),
   v AS (SELECT * FROM ({verdict_sql(DEFAULT_RULES, 'req', 'event_id', WEB_TARGETS).replace(', h AS (', 'WITH h AS (', 1)}))
   , g AS (SELECT f.*, v.rule_score, v.attack_type, v.attack_types,
      8 * has_sql_keyword + 8 * has_xss_keyword + 8 * has_path_traversal + 6 * is_scanner_user_agent
      + CASE WHEN {" + ".join(f"(length({c}) - length(regexp_replace({c}, '[''\"<>;(){{}}[\\]./\\\\=%&|-]', '', 'g')))" for c in ('nu', 'nq', 'na'))} >= 20 THEN 4 ELSE 0 END
      + CASE WHEN status_code >= 500 THEN 3 ELSE 0 END AS bonus FROM f JOIN v USING (event_id)),
   z AS (SELECT *, least(100, rule_score + bonus) AS risk FROM g)
   SELECT event_id AS line_number, rule_score, bonus AS risk_bonus, risk AS risk_score, attack_type, attack_types,
     CASE WHEN risk >= 70 THEN 'malicious' WHEN risk >= 25 THEN 'suspicious' ELSE 'benign' END AS final_label FROM z"""


@register("ENTRY_A_lines_to_verdicts", ENTRY_SQL)
def entry_a(spark, sf):
    s = analyze_lines(log_lines(spark, sf).drop("event_id"), "apache")
    return s.select("line_number", "rule_score", "risk_bonus", "risk_score", "attack_type", joined("attack_types").alias("attack_types"), "final_label")


@register("T1_stream_scored_lines", ENTRY_SQL.replace("SELECT event_id AS line_number, rule_score", "SELECT rule_score"))
def t1_lines(spark, sf):
    """The same lines as log files that arrive one per micro-batch, scored and upserted, then again in one batch: a replay changes nothing.

    The table holds all verdicts with their id; the sixty features are not part of the report.
    """
    verdict = ["rule_score", "risk_bonus", "risk_score", "attack_type", "attack_types", "final_label"]
    folder, out = new_work_path(spark, "logs"), new_work_path(spark, "scored")
    log_lines(spark, sf).select("line").repartition(2).write.text(f"{folder}/apache")
    for checkpoint, files in (("-first", 1), ("-again", 2)):
        stream = stream_log_lines(spark, folder, "*.txt", files_per_batch=files)
        upsert_stream(stream, out, out + checkpoint, lambda batch: score_batch(batch, ["event_id", *verdict]), once=True).awaitTermination()
    return sinks.read_current(spark, out).select(*[joined(c).alias(c) if c == "attack_types" else c for c in verdict])
