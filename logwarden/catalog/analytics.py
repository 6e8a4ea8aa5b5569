"""Predicates, analyst aggregates, baselines, reports."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from logwarden.catalog.base import GROUP_SQL, MALICIOUS, REQ, joined, latest, ntz, register, requests, table
from logwarden.functions.text import endpoint_group
from logwarden.operators import aggregates as A, analyst, baselines as B, predicates as P
from logwarden.operators.nested import flat_to_nested, nested_to_flat
from logwarden.plans import reports as R

# --- predicates ------------------------------------------------------------------------------

register("W1_is_malicious", REQ + f"SELECT event_id FROM requests WHERE {MALICIOUS}")(
    lambda spark, sf: (lambda r: r.where(P.is_malicious(r)).select("event_id"))(requests(spark, sf)))


@register("W2_is_malicious_nested", REQ + f"SELECT event_id FROM requests WHERE {MALICIOUS}")
def w2(spark, sf):
    stored = flat_to_nested(requests(spark, sf))
    return stored.where(P.is_malicious_wide(stored)).select("event_id")


@register("W3_is_malicious_row", REQ + """SELECT event_id FROM requests WHERE final_label IN ('malicious', 'suspicious', 'attack')
   OR lower(coalesce(attack_type, 'unknown')) NOT IN ('unknown', '', 'none', 'normal', 'benign') OR risk_score >= 70""")
def w3(spark, sf):
    r = requests(spark, sf)
    return r.where(P.is_malicious_row(r)).select("event_id")


@register("W4_is_alerting", REQ + "SELECT event_id FROM requests WHERE should_alert OR final_label IN ('malicious', 'suspicious')")
def w4(spark, sf):
    r = requests(spark, sf)
    return r.where(P.is_alerting(r)).select("event_id")


@register("W5_is_high_severity", REQ + "SELECT event_id FROM requests WHERE upper(risk_level) IN ('HIGH', 'CRITICAL') OR risk_score >= 80")
def w5(spark, sf):
    stored = flat_to_nested(requests(spark, sf))
    return stored.where(P.is_high_severity(stored)).select("event_id")


@register("W6_timeframe_cutoff", "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 36 HOUR")
def w6(spark, sf):
    e = table(spark, sf, "events")
    return e.where(P.since(F.col("ts"), P.cutoff("36h", latest(e)))).select("event_id", "ts")


@register("W7_range_and_previous_window", """WITH n AS (SELECT max(ts) AS now FROM events)
  SELECT count(*) FILTER (ts >= now - INTERVAL 7 DAY AND ts < now) AS current_rows,
         count(*) FILTER (ts >= now - INTERVAL 14 DAY AND ts < now - INTERVAL 7 DAY) AS previous_rows FROM events, n""")
def w7(spark, sf):
    e = table(spark, sf, "events")
    w = P.timeframe_windows("7d", latest(e))
    ts = F.col("ts")
    return e.where(P.in_range(ts, w["prev_start"], w["end"])).agg(
        F.count_if(P.in_range(ts, w["start"], w["end"])).alias("current_rows"),
        F.count_if(P.in_range(ts, w["prev_start"], w["prev_end"])).alias("previous_rows"))


@register("W8_should_alert_incident", REQ + "SELECT event_id FROM requests WHERE risk_score >= 80 OR lower(risk_level) IN ('high', 'critical')")
def w8(spark, sf):
    r = requests(spark, sf)
    return r.where(P.should_alert_incident(r)).select("event_id")


@register("W10_usable_for_evaluation", """SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id)
  WHERE length(d.text) > 0 AND coalesce(CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, 'unknown') <> 'unknown'""")
def w10(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    label = F.coalesce(F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor"), F.lit("unknown"))
    return d.where(P.usable_for_evaluation(F.col("text"), label)).select("doc_id")


@register("W11_complete_output_guard", "SELECT count(*) AS feature_rows FROM events")
def w11(spark, sf):
    checked = P.assert_same_rows(requests(spark, sf), table(spark, sf, "events"))
    return checked.agg(F.count(F.lit(1)).alias("feature_rows"))


@register("W12_rows_without_key", """SELECT count(*) FILTER (event_type = 'error') AS rows_without_key,
  count(*) FILTER (event_type <> 'error') AS rows_with_key FROM events""")
def w12(spark, sf):
    e = table(spark, sf, "events").withColumn("event_id", F.when(F.col("event_type") != "error", F.col("event_id")))
    return P.missing_key_count(e)


# --- aggregates ------------------------------------------------------------------------------

@register("A1_attack_type_distribution", REQ + f"""SELECT coalesce(attack_type, 'Unknown') AS attack_type, count(*) AS count
  FROM requests WHERE {MALICIOUS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def a1(spark, sf):
    return A.attack_type_distribution(requests(spark, sf))


TOP_SQL = REQ + f"""SELECT source_ip AS ip, count(*) AS total_attacks,
    array_to_string(list_sort(list(DISTINCT attack_type) FILTER (attack_type IS NOT NULL)), ',') AS attack_types,
    min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT uri) AS target_count
  FROM requests WHERE {MALICIOUS} GROUP BY 1 ORDER BY total_attacks DESC, ip LIMIT 10"""


@register("A2_top_attacking_ips", TOP_SQL)
def a2(spark, sf):
    return A.top_attacking_ips(requests(spark, sf)).withColumn("attack_types", joined("attack_types"))


@register("A2_top_attacker_targets", REQ + f""", m AS (SELECT * FROM requests WHERE {MALICIOUS}),
  top AS (SELECT source_ip FROM m GROUP BY 1 ORDER BY count(*) DESC, source_ip LIMIT 10)
  SELECT source_ip AS ip, uri, count(*) AS hits FROM m WHERE source_ip IN (SELECT source_ip FROM top) GROUP BY 1, 2""")
def a2_targets(spark, sf):
    r = requests(spark, sf)
    return A.attack_targets(r, A.top_attacking_ips(r))


def campaign_sql(having: str, extra: str = "") -> str:
    return REQ + f""", g AS (SELECT source_ip AS ip, count(*) AS total_attacks,
      array_to_string(list_sort(list(DISTINCT attack_type) FILTER (attack_type IS NOT NULL)), ',') AS attack_types,
      min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT attack_type) AS attack_type_count, count(DISTINCT uri) AS target_count
      FROM requests WHERE {MALICIOUS} GROUP BY 1 {extra})
    SELECT *, CASE WHEN total_attacks >= 30 OR attack_type_count >= 4 THEN 'critical' WHEN total_attacks >= 15 OR attack_type_count >= 3 THEN 'high'
      WHEN total_attacks >= 8 OR attack_type_count >= 2 THEN 'medium' ELSE 'low' END AS risk_level
    FROM g WHERE {having} ORDER BY total_attacks DESC, ip"""


@register("A3_attack_campaigns", campaign_sql("total_attacks >= 50 AND attack_type_count >= 4") + " LIMIT 10")
def a3(spark, sf):
    return A.attack_campaigns(requests(spark, sf), 50, 4).withColumns(
        {"attack_types": joined("attack_types"), "attack_type_count": F.col("attack_type_count").cast("bigint")})


@register("A4_campaigns_any_threshold", campaign_sql("total_attacks >= 10 OR attack_type_count >= 3 OR target_count > 1"))
def a4(spark, sf):
    return A.attack_campaigns_any(requests(spark, sf)).withColumns(
        {"attack_types": joined("attack_types"), "attack_type_count": F.col("attack_type_count").cast("bigint")})


@register("A5_campaign_risk_levels", REQ + f""", g AS (SELECT source_ip, count(*) AS n, count(DISTINCT attack_type) AS t
    FROM requests WHERE {MALICIOUS} AND risk_score >= 60 GROUP BY 1)
  SELECT CASE WHEN n >= 30 OR t >= 4 THEN 'critical' WHEN n >= 15 OR t >= 3 THEN 'high' WHEN n >= 8 OR t >= 2 THEN 'medium' ELSE 'low' END AS risk_level,
    count(*) AS ips FROM g GROUP BY 1""")
def a5(spark, sf):
    rows = A.malicious_requests(requests(spark, sf).where("risk_score >= 60"))
    pairs = rows.groupBy("ip", "rule_attack_type").agg(F.count(F.lit(1)).alias("n"))
    per_ip = pairs.groupBy("ip").agg(F.sum("n").alias("n"), F.count("rule_attack_type").alias("t"))
    return per_ip.groupBy(A.campaign_risk_level(F.col("n"), F.col("t")).alias("risk_level")).agg(F.count(F.lit(1)).alias("ips"))


def rule_ids(df):
    """Requests with the rule ids an attack type stands for."""
    return df.withColumn("matched_rule_ids", F.when(
        F.col("attack_type").isNotNull(), F.array(F.concat(F.col("attack_type"), F.lit("_a")), F.concat(F.col("attack_type"), F.lit("_b")))))


@register("A6_ip_threat_scores", REQ + """, g AS (SELECT source_ip, count(*) AS total_requests,
     count(*) FILTER (should_alert OR final_label IN ('malicious', 'suspicious')) AS total_alerts,
     max(risk_score)::DOUBLE AS max_risk_score, avg(risk_score) AS a,
     array_to_string(list_sort(list(DISTINCT concat(attack_type, '_a+', attack_type, '_b')) FILTER (attack_type IS NOT NULL)), ',') AS triggered_rules
     FROM requests GROUP BY 1)
  SELECT source_ip, total_requests, total_alerts, max_risk_score, round(a, 6) AS avg_risk_score, triggered_rules FROM g
  ORDER BY max_risk_score DESC, total_alerts DESC, a DESC, source_ip LIMIT 10""")
def a6(spark, sf):
    return A.ip_threat_scores(rule_ids(requests(spark, sf))).select(
        "source_ip", "total_requests", "total_alerts", "max_risk_score", F.round("avg_risk_score", 6).alias("avg_risk_score"),
        joined(F.transform("triggered_rules", lambda r: F.array_join(r, "+"))).alias("triggered_rules"))


@register("A7_ip_blast_radius", REQ + """, ip AS (SELECT source_ip FROM requests GROUP BY 1 ORDER BY count(*) DESC, source_ip LIMIT 1),
  u AS (SELECT uri, count(*) AS count FROM requests WHERE source_ip = (SELECT source_ip FROM ip) GROUP BY 1)
  SELECT uri, count, round(count / (SELECT sum(count) FROM u) * 100.0, 2) AS percentage FROM u ORDER BY count DESC, uri LIMIT 10""")
def a7(spark, sf):
    r = requests(spark, sf)
    busiest = r.groupBy("source_ip").count().orderBy(F.desc("count"), "source_ip").first()["source_ip"]
    return A.ip_blast_radius(r, busiest)


@register("A8_attack_timeline_bins", REQ + f"""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS timestamp, coalesce(attack_type, 'Unknown') AS attack_type,
  count(*) AS count FROM requests WHERE {MALICIOUS} GROUP BY 1, 2""")
def a8(spark, sf):
    return A.attack_timeline(requests(spark, sf), size=6, unit="hour").withColumn("timestamp", ntz("timestamp"))


@register("A8_attack_timeline_since", REQ + f"""SELECT date_trunc('day', ts)::TIMESTAMP AS timestamp, coalesce(attack_type, 'Unknown') AS attack_type,
  count(*) AS count FROM requests WHERE {MALICIOUS} AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY
  GROUP BY 1, 2""")
def a8_since(spark, sf):
    r = requests(spark, sf)
    now = latest(table(spark, sf, "events"))
    return A.attack_timeline(r, unit="day", start=now - timedelta(days=7)).withColumn("timestamp", ntz("timestamp"))


def threat_sql(unit: str) -> str:
    return REQ + f"""SELECT date_trunc('{unit}', ts)::TIMESTAMP AS time_bucket, count(*) AS total_requests,
      count(*) FILTER (should_alert) AS total_alerts, round(avg(risk_score), 6) AS avg_risk_score FROM requests GROUP BY 1"""


def threat_query(unit: str):
    return lambda spark, sf: A.threat_timeline(requests(spark, sf), unit).select(
        ntz("time_bucket").alias("time_bucket"), "total_requests", "total_alerts", F.round("avg_risk_score", 6).alias("avg_risk_score"))


for _unit in ("hour", "day", "week"):
    register(f"A9_threat_timeline_{_unit}", threat_sql(_unit))(threat_query(_unit))

WEEKLY_SQL = REQ + f""", w AS (SELECT dayofweek(ts) * 24 + hour(ts) AS hour_of_week, {GROUP_SQL} AS endpoint_group,
    concat(isoyear(ts), '-', week(ts)) AS wk, count(*) AS n FROM requests WHERE should_alert GROUP BY 1, 2, 3),
  bl AS (SELECT hour_of_week, endpoint_group, avg(n) AS mean, stddev_pop(n) AS std_dev FROM w GROUP BY 1, 2)"""


@register("A10_attack_baselines", WEEKLY_SQL + """ SELECT hour_of_week::INT AS hour_of_week, endpoint_group, round(mean, 6) AS mean, round(std_dev, 6) AS std_dev FROM bl""")
def a10(spark, sf):
    return B.attack_baselines(requests(spark, sf)).select(
        "hour_of_week", "endpoint_group", F.round("mean", 6).alias("mean"), F.round("std_dev", 6).alias("std_dev"))


FLOOR_SQL = REQ + f""", h AS (SELECT {GROUP_SQL} AS endpoint_group, date_trunc('hour', ts) AS hr, count(*) AS n FROM requests GROUP BY 1, 2),
  l AS (SELECT endpoint_group, list_sort(list(n)) AS c FROM h GROUP BY 1),
  fl AS (SELECT endpoint_group, greatest(2, floor(c[least(floor(len(c) * 0.9)::BIGINT, len(c) - 1) + 1] * 1.0))::BIGINT AS min_floor FROM l)"""


@register("A11_endpoint_min_floors", FLOOR_SQL + " SELECT * FROM fl")
def a11(spark, sf):
    return B.endpoint_min_floors(requests(spark, sf), scale=1.0)


COMPARISON_SQL = WEEKLY_SQL + f""", n AS (SELECT date_trunc('hour', max(ts))::TIMESTAMP AS last FROM events),
  spine AS (SELECT unnest(generate_series(last - INTERVAL 23 HOUR, last, INTERVAL 1 HOUR)) AS timestamp FROM n),
  act AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS timestamp, count(*) AS c FROM requests WHERE {MALICIOUS} GROUP BY 1),
  thr AS (SELECT hour_of_week, sum(mean + 3 * std_dev) AS t FROM bl GROUP BY 1)
  SELECT s.timestamp, strftime(s.timestamp, '%H:00') AS label, (dayofweek(s.timestamp) * 24 + hour(s.timestamp))::INT AS hour_of_week,
    (dayofweek(s.timestamp) + 1)::INT AS day_of_week, hour(s.timestamp)::INT AS hour, coalesce(c, 0)::BIGINT AS actual_count,
    round(coalesce(t, 0), 2)::DOUBLE AS threshold
  FROM spine s LEFT JOIN act USING (timestamp) LEFT JOIN thr ON thr.hour_of_week = dayofweek(s.timestamp) * 24 + hour(s.timestamp)"""


@register("A12_baseline_comparison_24h", COMPARISON_SQL)
def a12(spark, sf):
    r = requests(spark, sf)
    return B.baseline_comparison_24h(r, B.attack_baselines(r), latest(table(spark, sf, "events")))


@register("A13_soc_summary", REQ + f""", n AS (SELECT max(ts) AS now FROM events),
  c AS (SELECT count(*) FILTER (cur) AS total_requests, count(*) FILTER (cur AND bad) AS malicious_requests,
          count(*) FILTER (cur AND bad AND high) AS high_severity_incidents, count(*) FILTER (prev) AS pr, count(*) FILTER (prev AND bad) AS pm
        FROM (SELECT ts >= now - INTERVAL 7 DAY AND ts < now AS cur, ts >= now - INTERVAL 14 DAY AND ts < now - INTERVAL 7 DAY AS prev,
                {MALICIOUS} AS bad, (risk_level IN ('high', 'critical') OR risk_score >= 80) AS high FROM requests, n))
  SELECT total_requests, malicious_requests, malicious_requests AS total_incidents, high_severity_incidents,
    CASE WHEN total_requests > pr THEN 'up' WHEN total_requests < pr THEN 'down' ELSE 'flat' END AS requests_direction,
    CASE WHEN pr > 0 THEN round((total_requests - pr) / pr * 100.0, 1) END AS requests_percent, total_requests - pr AS requests_delta,
    CASE WHEN malicious_requests > pm THEN 'up' WHEN malicious_requests < pm THEN 'down' ELSE 'flat' END AS malicious_direction,
    CASE WHEN pm > 0 THEN round((malicious_requests - pm) / pm * 100.0, 1) END AS malicious_percent, malicious_requests - pm AS malicious_delta,
    'vs last 7 days' AS comparison_label FROM c""")
def a13(spark, sf):
    r = requests(spark, sf)
    s = A.soc_summary(r, None, None, "7d", latest(table(spark, sf, "events")))
    renamed = {f"{a}_trend_{k}": f"{b}_{k}" for a, b in (("total_requests", "requests"), ("malicious_requests", "malicious"))
               for k in ("direction", "percent", "delta")}
    return s.withColumnsRenamed(renamed).drop("active_campaigns", "campaigns_last_updated")


@register("A14_daily_trend", REQ + """, d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, count(*) FILTER (should_alert) AS a FROM requests GROUP BY 1)
  SELECT day, CASE WHEN n > a THEN 'up' WHEN n < a THEN 'down' ELSE 'flat' END AS direction,
    CASE WHEN a > 0 THEN round((n - a) / a * 100.0, 1) END AS percent, n - a AS delta FROM d""")
def a14(spark, sf):
    d = requests(spark, sf).groupBy(ntz(F.date_trunc("day", "ts")).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("should_alert").alias("a"))
    return d.select("day", *[c.alias(n) for n, c in A.trend(F.col("n"), F.col("a")).items()])


@register("A15_last_hour_group_counts", REQ + f"""SELECT {GROUP_SQL} AS endpoint_group, count(*) AS count FROM requests
  WHERE should_alert AND ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1""")
def a15(spark, sf):
    return A.alerting_group_counts(requests(spark, sf), latest(table(spark, sf, "events")), hours=24)


@register("A16_batch_group_counts", REQ + f"SELECT {GROUP_SQL} AS endpoint_group, count(*) AS count FROM requests GROUP BY 1")
def a16(spark, sf):
    return A.group_counts(requests(spark, sf))


@register("P22_endpoint_group", REQ + f"SELECT event_id, {GROUP_SQL} AS endpoint_group FROM requests")
def p22(spark, sf):
    return requests(spark, sf).select("event_id", endpoint_group(F.col("uri")).alias("endpoint_group"))


@register("A18_campaign_metadata", REQ + f""",
  g AS (SELECT source_ip, count(*) AS n, count(DISTINCT attack_type) AS t FROM requests WHERE {MALICIOUS} GROUP BY 1),
  top AS (SELECT * FROM g WHERE n >= 50 AND t >= 3 ORDER BY n DESC, source_ip LIMIT 40)
  SELECT count(*) AS active_campaigns, (SELECT max(ts) FROM events) AS campaigns_last_updated FROM top""")
def a18(spark, sf):
    r = requests(spark, sf)
    return A.campaign_metadata(A.active_campaigns(r, latest(table(spark, sf, "events")), limit=40))


@register("A19_class_counts", "SELECT label::VARCHAR AS class, count(*) AS count FROM embeddings GROUP BY 1")
def a19(spark, sf):
    return A.class_counts(table(spark, sf, "embeddings"), "label")


@register("A20_latency_summary", """SELECT round(avg(value), 3) AS mean, round(quantile_cont(value, 0.5), 3) AS p50,
  round(quantile_cont(value, 0.95), 3) AS p95, round(max(value), 3) AS max FROM events""")
def a20(spark, sf):
    return A.latency_summary(table(spark, sf, "events"), "value")


@register("T10_materialized_campaigns", campaign_sql("total_attacks >= 50 AND attack_type_count >= 3") + " LIMIT 25")
def t10(spark, sf):
    r = requests(spark, sf)
    stored = A.active_campaigns(r, latest(table(spark, sf, "events")), limit=25)
    return A.read_campaigns(stored).drop("status", "materialized_at").withColumns(
        {"attack_types": joined("attack_types"), "attack_type_count": F.col("attack_type_count").cast("bigint")})


# --- the same operators on the large order tables --------------------------------------------

@register("A2_top_customers_by_orders", """SELECT o_custkey::VARCHAR AS ip, count(*) AS total_attacks,
    array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS attack_types, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen,
    count(DISTINCT o_orderkey % 7) AS target_count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def a2_orders(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("source_ip"), F.col("o_orderpriority").alias("attack_type"),
        (F.col("o_orderkey") % 7).cast("string").alias("uri"), F.col("o_orderdate").alias("ts"))
    return A.top_attacking_ips(o).withColumn("attack_types", joined("attack_types"))


@register("A8_shipping_timeline", """SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS timestamp, l_returnflag AS attack_type, count(*) AS count
  FROM lineitem GROUP BY 1, 2""")
def a8_lineitem(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("attack_type"), F.col("l_shipdate").alias("ts"))
    return A.attack_timeline(li, unit="month").withColumn("timestamp", ntz("timestamp"))


@register("A3_supplier_campaigns", """WITH g AS (SELECT l_suppkey::VARCHAR AS ip, count(*) AS total_attacks,
    array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS attack_types, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen,
    count(DISTINCT l_linestatus) AS attack_type_count, count(DISTINCT l_partkey) AS target_count FROM lineitem GROUP BY 1)
  SELECT *, CASE WHEN total_attacks >= 30 OR attack_type_count >= 4 THEN 'critical' WHEN total_attacks >= 15 OR attack_type_count >= 3 THEN 'high'
      WHEN total_attacks >= 8 OR attack_type_count >= 2 THEN 'medium' ELSE 'low' END AS risk_level
  FROM g WHERE total_attacks >= 50 AND attack_type_count >= 2 ORDER BY total_attacks DESC, ip LIMIT 10""")
def a3_lineitem(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("source_ip"), F.col("l_linestatus").alias("attack_type"),
        F.col("l_partkey").cast("string").alias("uri"), F.col("l_shipdate").alias("ts"))
    return A.attack_campaigns(li, 50, 2).withColumns(
        {"attack_types": joined("attack_types"), "attack_type_count": F.col("attack_type_count").cast("bigint")})


# --- analyst rows and reports ----------------------------------------------------------------

@register("P21_analyst_rows", REQ + """SELECT event_id::VARCHAR AS event_id, source_ip AS ip, uri, coalesce(attack_type, 'Unknown') AS attack_type, risk_score,
    round(risk_score / 100.0, 4)::DOUBLE AS prediction_score, risk_level AS severity, final_label AS verdict FROM requests""")
def p21(spark, sf):
    return analyst.analyst_rows(flat_to_nested(requests(spark, sf))).select(
        "event_id", "ip", "uri", "attack_type", "risk_score", "prediction_score", "severity", "verdict")


@register("P25_explanation", REQ + """SELECT event_id::VARCHAR AS event_id, concat('Flagged because: ',
    CASE WHEN attack_type IS NOT NULL THEN concat('classified as ', attack_type, '; matched rules: ', attack_type, '_a, ', attack_type, '_b; hybrid sources: rules; ') ELSE '' END,
    'risk score ', risk_score, '; prediction confidence ', risk_score, '.0%.') AS explanation FROM requests""")
def p25(spark, sf):
    rows = analyst.analyst_rows(rule_ids(requests(spark, sf)))
    return rows.select("event_id", analyst.explanation().alias("explanation"))


@register("P26_recommendations", REQ + """SELECT coalesce(attack_type, 'Unknown') AS attack_type,
    CASE WHEN attack_type = 'sqli' THEN 'Bind every query value as a parameter.' WHEN attack_type = 'xss' THEN 'Escape user input wherever a page shows it.'
         WHEN attack_type = 'traversal' THEN 'Resolve the path and check that it stays below the served folder.' ELSE 'Read the whole request by hand.' END AS first_step,
    count(*) AS rows FROM requests GROUP BY ALL""")
def p26(spark, sf):
    rows = requests(spark, sf).withColumn("attack_type", F.coalesce("attack_type", F.lit("Unknown")))
    return rows.groupBy("attack_type", analyst.recommendations(F.col("attack_type"))[0].alias("first_step")).agg(
        F.count(F.lit(1)).alias("rows"))


@register("P27_P28_alert_text", REQ + """SELECT event_id::VARCHAR AS incident_id, concat('[', upper(risk_level), '] Security Incident Alert', chr(10),
    'Incident: ', event_id, chr(10), CASE WHEN attack_type IS NOT NULL THEN concat('Attack: ', attack_type, chr(10)) ELSE '' END,
    'Risk score: ', risk_score, chr(10), 'Source IP: ', source_ip, chr(10), 'Request: ', uri) AS alert_text FROM requests WHERE should_alert""")
def p28(spark, sf):
    rows = requests(spark, sf).where("should_alert").drop("ts")
    return analyst.alert_events(rows).select("incident_id", analyst.alert_text().alias("alert_text"))


@register("P18_P20_nested_round_trip", REQ + "SELECT event_id, source_ip, uri, attack_type, risk_score, final_label, should_alert FROM requests")
def p20(spark, sf):
    return nested_to_flat(flat_to_nested(requests(spark, sf))).select(
        "event_id", "source_ip", "uri", "attack_type", "risk_score", "final_label", "should_alert")


@register("R1_A17_run_counts", REQ + """SELECT count(*) AS scored_records, count(*) FILTER (should_alert) AS alerts, 0::BIGINT AS parse_errors,
    count(*) FILTER (final_label = 'benign') AS benign, count(*) FILTER (final_label = 'suspicious') AS suspicious,
    count(*) FILTER (final_label = 'malicious') AS malicious, 0::BIGINT AS ml_predictions, 0::BIGINT AS ml_benign, 0::BIGINT AS ml_attack FROM requests""")
def r1(spark, sf):
    return R.run_counts(requests(spark, sf))


@register("R2_top_matched_rules", REQ + """, x AS (SELECT unnest([concat(attack_type, '_a'), concat(attack_type, '_b')]) AS rule_id
    FROM requests WHERE should_alert AND attack_type IS NOT NULL) SELECT rule_id, count(*) AS count FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def r2(spark, sf):
    return R.report_tables(with_sources(rule_ids(requests(spark, sf))))["top_matched_rules"]


def with_sources(df):
    return df.withColumn("detection_sources", F.array_compact(F.array(
        F.when(F.col("attack_type").isNotNull(), "rules"), F.when(F.col("risk_score") >= 70, "ml"))))


@register("N10_top_attack_types", REQ + """SELECT attack_type, count(*) AS count FROM requests WHERE should_alert AND attack_type IS NOT NULL
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def n10(spark, sf):
    return R.top_attack_types(requests(spark, sf).where("should_alert"))


@register("R2_signal_sources", REQ + """SELECT 'rules' AS source, count(*) AS count FROM requests WHERE should_alert AND attack_type IS NOT NULL
  UNION ALL SELECT 'ml', count(*) FROM requests WHERE should_alert AND risk_score >= 70""")
def r2_sources(spark, sf):
    return R.source_counts(with_sources(requests(spark, sf)).where("should_alert"))


@register("R2_sample_alerts", REQ + """SELECT source_ip, '-' AS method, uri, final_label AS label, risk_score, coalesce(attack_type, '-') AS attack_type
  FROM requests WHERE should_alert ORDER BY event_id LIMIT 10""")
def r2_sample(spark, sf):
    return R.sample_alerts(requests(spark, sf).withColumn("http_method", F.lit(None).cast("string")).where("should_alert"))


@register("R4_S19_J12_recent_incidents", REQ + f"""SELECT event_id::VARCHAR AS event_id, ts AS timestamp, source_ip AS ip, risk_score
  FROM requests WHERE {MALICIOUS} ORDER BY ts DESC, event_id::VARCHAR LIMIT 100""")
def r4(spark, sf):
    r = requests(spark, sf)
    return R.recent_incidents(r.where("risk_score > 1000"), r).select("event_id", "timestamp", "ip", "risk_score")


@register("S18_find_by_id", REQ + "SELECT event_id::VARCHAR AS event_id, source_ip AS ip, uri, risk_score FROM requests WHERE event_id = (SELECT max(event_id) FROM events)")
def s18(spark, sf):
    r = requests(spark, sf)
    wanted = table(spark, sf, "events").agg(F.max("event_id").alias("m")).first()["m"]
    return R.find_by_id(r.where("risk_score > 1000"), r, str(wanted)).select("event_id", "ip", "uri", "risk_score")


@register("R6_baseline_snapshot_floors", FLOOR_SQL.replace("* 1.0", "* 0.1") + " SELECT * FROM fl")
def r6(spark, sf):
    return R.baseline_snapshot(requests(spark, sf), latest(table(spark, sf, "events")))["endpoint_floors"]


@register("R6_baseline_snapshot_baselines", WEEKLY_SQL + """ SELECT hour_of_week::INT AS hour_of_week, endpoint_group, round(mean, 6) AS mean, round(std_dev, 6) AS std_dev FROM bl""")
def r6_baselines(spark, sf):
    stored = R.baseline_snapshot(requests(spark, sf), latest(table(spark, sf, "events")))["baselines"]
    return stored.select("hour_of_week", "endpoint_group", F.round("mean", 6).alias("mean"), F.round("std_dev", 6).alias("std_dev"))


@register("R6_baseline_snapshot_comparison", COMPARISON_SQL)
def r6_comparison(spark, sf):
    return R.baseline_snapshot(requests(spark, sf), latest(table(spark, sf, "events")))["comparison_last_24h"]
