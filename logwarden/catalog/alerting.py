"""Correlation, gates, lifecycle, upserts and the streaming twins."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window as W, functions as F

from logwarden.catalog.base import GROUP_SQL, REQ, joined, latest, register, request_rows, requests, table
from logwarden.operators import incidents as I, lifecycle as L
from logwarden.operators.baselines import above_baseline, attack_baselines, endpoint_min_floors, with_baseline
from logwarden.functions.text import endpoint_group, hour_of_week
from logwarden.session import materialize, new_work_path
from logwarden.sources import sinks
from logwarden.streaming import alerting as SA, ingest as SI

HOURS = 6
ALERTS_SQL = REQ + f""", alerts AS (SELECT event_id, ts, concat('10.0.0.', user_id % 8) AS source_ip, uri, attack_type, risk_score,
     time_bucket(INTERVAL {HOURS} HOUR, ts) AS window_start, {GROUP_SQL} AS grp FROM requests WHERE should_alert)"""
# Incident facts per address and window.
INCIDENT_SQL = ALERTS_SQL + """, p AS (SELECT *, CASE WHEN grp = 'sensitive' THEN 0 WHEN grp LIKE 'api%' THEN 1 WHEN grp = 'root' THEN 3 ELSE 2 END AS pri FROM alerts),
  lead AS (SELECT source_ip, window_start, arg_min(grp, {'p': pri, 't': ts, 'e': event_id}) AS grp,
             arg_min(attack_type, {'t': ts, 'e': event_id}) FILTER (attack_type IS NOT NULL) AS first_type,
             count(*) AS evidence_count, count(DISTINCT uri) AS endpoint_count,
             list_sort(list(DISTINCT attack_type) FILTER (attack_type IS NOT NULL)) AS types FROM p GROUP BY 1, 2),
  risk AS (SELECT p.source_ip, p.window_start, max(p.risk_score)::DOUBLE AS max_risk_score FROM p JOIN lead USING (source_ip, window_start, grp) GROUP BY 1, 2),
  inc0 AS (SELECT *, CASE WHEN endpoint_count >= 8 THEN 'reconnaissance' WHEN evidence_count >= 6 THEN 'brute_force'
             WHEN coalesce(len(types), 0) >= 3 THEN 'multi_vector' ELSE 'single' END AS behavior_type FROM lead JOIN risk USING (source_ip, window_start)),
  inc AS (SELECT concat('corr-', substr(md5(concat(source_ip, ':', strftime(window_start, '%Y-%m-%dT%H:%M:%S+00:00'), ':', behavior_type)), 1, 12)) AS correlation_id,
      CASE behavior_type WHEN 'reconnaissance' THEN concat('Broad reconnaissance from IP ', source_ip) WHEN 'brute_force' THEN concat('Brute-force burst from IP ', source_ip)
        WHEN 'multi_vector' THEN concat('Multi-vector attack from IP ', source_ip) ELSE concat(coalesce(first_type, 'Security anomaly'), ' activity from IP ', source_ip) END AS title,
      behavior_type, source_ip, coalesce(array_to_string(types, ','), '') AS attack_types, evidence_count, endpoint_count, max_risk_score,
      CASE WHEN max_risk_score >= 90 THEN 'critical' WHEN max_risk_score >= 70 THEN 'high' WHEN max_risk_score >= 40 THEN 'medium' ELSE 'low' END AS severity,
      window_start, window_start + INTERVAL 6 HOUR AS window_end FROM inc0)"""


def alerts(spark, sf):
    return requests(spark, sf).where("should_alert").withColumn(
        "source_ip", F.concat(F.lit("10.0.0."), (F.col("user_id") % 8).cast("string")))


def incidents(spark, sf):
    return I.correlate(alerts(spark, sf), HOURS * 60, recon=8, brute_force=6, multi_vector=3)


@register("T2_T3_T4_correlated_incidents", INCIDENT_SQL + " SELECT * FROM inc")
def t2(spark, sf):
    return incidents(spark, sf).withColumn("attack_types", joined("attack_types"))


@register("T2_incident_endpoints", INCIDENT_SQL + """ SELECT i.correlation_id, a.uri, a.grp AS endpoint_group, count(*) AS events
  FROM alerts a JOIN inc i USING (source_ip, window_start) GROUP BY 1, 2, 3""")
def t2_endpoints(spark, sf):
    return I.incident_endpoints(alerts(spark, sf), incidents(spark, sf), HOURS * 60)


@register("N9_incident_evidence", ALERTS_SQL + """, newest AS (SELECT *, row_number() OVER (PARTITION BY source_ip, window_start ORDER BY ts DESC, event_id DESC) AS n FROM alerts)
  SELECT source_ip, window_start, array_to_string(list(event_id ORDER BY ts, event_id), ',') AS event_ids FROM newest WHERE n <= 100 GROUP BY 1, 2""")
def n9(spark, sf):
    return I.incident_evidence(alerts(spark, sf), HOURS * 60).select(
        "source_ip", "window_start", joined(F.transform("evidence", lambda e: e["event_id"])).alias("event_ids"))


BASE_SQL = f""", wk AS (SELECT dayofweek(ts) * 24 + hour(ts) AS how, {GROUP_SQL} AS g, concat(isoyear(ts), '-', week(ts)) AS w, count(*) AS n
    FROM requests WHERE should_alert GROUP BY 1, 2, 3),
  bl AS (SELECT how, g, avg(n) AS mean, stddev_pop(n) AS sd FROM wk GROUP BY 1, 2),
  hh AS (SELECT {GROUP_SQL} AS g, date_trunc('hour', ts) AS hr, count(*) AS n FROM requests GROUP BY 1, 2),
  hl AS (SELECT g, list_sort(list(n)) AS c FROM hh GROUP BY 1),
  fl AS (SELECT g, greatest(2, floor(c[least(floor(len(c) * 0.9)::BIGINT, len(c) - 1) + 1] * 0.1))::BIGINT AS f FROM hl)"""


@register("J2_J3_baseline_lookup", REQ + BASE_SQL + f""", h AS (SELECT dayofweek(ts) * 24 + hour(ts) AS how, {GROUP_SQL} AS g, count(*) AS n FROM requests GROUP BY 1, 2)
  SELECT h.how::INT AS hour_of_week, h.g AS endpoint_group, n AS current_count,
    round(coalesce(mean, CASE h.g WHEN 'sensitive' THEN 0.5 ELSE 5.0 END), 6) AS mean,
    round(greatest(0.1, coalesce(sd, CASE h.g WHEN 'sensitive' THEN 0.2 ELSE 2.0 END)), 6) AS std_dev,
    coalesce(f, CASE h.g WHEN 'sensitive' THEN 2 WHEN 'api' THEN 20 WHEN 'root' THEN 100 ELSE 50 END)::BIGINT AS floor,
    (n > coalesce(mean, CASE h.g WHEN 'sensitive' THEN 0.5 ELSE 5.0 END) + 3 * greatest(0.1, coalesce(sd, CASE h.g WHEN 'sensitive' THEN 0.2 ELSE 2.0 END))
      AND n >= coalesce(f, CASE h.g WHEN 'sensitive' THEN 2 WHEN 'api' THEN 20 WHEN 'root' THEN 100 ELSE 50 END)) AS should_alert
  FROM h LEFT JOIN bl ON bl.how = h.how AND bl.g = h.g LEFT JOIN fl ON fl.g = h.g""")
def j2(spark, sf):
    r = requests(spark, sf)
    hourly = r.groupBy(hour_of_week(F.col("ts")).alias("hour_of_week"), endpoint_group(F.col("uri")).alias("endpoint_group")).agg(
        F.count(F.lit(1)).alias("current_count"))
    looked = above_baseline(with_baseline(hourly, attack_baselines(r), endpoint_min_floors(r)))
    return looked.select("hour_of_week", "endpoint_group", "current_count", F.round("mean", 6).alias("mean"),
                         F.round("std_dev", 6).alias("std_dev"), "floor", "should_alert")


GATE_SQL = INCIDENT_SQL + BASE_SQL + """, batch AS (SELECT grp, count(*) AS n FROM alerts GROUP BY 1),
  ig AS (SELECT DISTINCT i.correlation_id, i.window_start, a.grp FROM inc i JOIN alerts a USING (source_ip, window_start)),
  gate AS (SELECT ig.correlation_id, ig.grp, batch.n AS n, coalesce(mean, CASE ig.grp WHEN 'sensitive' THEN 0.5 ELSE 5.0 END) AS m,
      greatest(0.1, coalesce(sd, CASE ig.grp WHEN 'sensitive' THEN 0.2 ELSE 2.0 END)) AS s,
      coalesce(f, CASE ig.grp WHEN 'sensitive' THEN 2 WHEN 'api' THEN 20 WHEN 'root' THEN 100 ELSE 50 END) AS fl
    FROM ig JOIN batch ON batch.grp = ig.grp LEFT JOIN bl ON bl.how = dayofweek(ig.window_start) * 24 + hour(ig.window_start) AND bl.g = ig.grp LEFT JOIN fl ON fl.g = ig.grp),
  ok AS (SELECT correlation_id, bool_or(n > m + 600 * s AND n >= fl) AS above FROM gate GROUP BY 1),
  decided AS (SELECT i.*, CASE WHEN max_risk_score < 80 AND severity NOT IN ('high', 'critical') THEN 'below_severity'
      WHEN NOT above THEN 'below_baseline' ELSE 'pass' END AS decision FROM inc i JOIN ok USING (correlation_id))"""


def gated(spark, sf):
    """All alerts of the table are one batch here, so counts are high: a wide band keeps both outcomes."""
    r, a, i = requests(spark, sf), alerts(spark, sf), materialize(incidents(spark, sf), "incidents")
    gate = I.baseline_gate(a, i, None, None, attack_baselines(r), endpoint_min_floors(r), HOURS * 60, sigma=600.0)
    return I.gate_incidents(a, i, gate)


@register("T5_T6_J11_gate_decisions", GATE_SQL + " SELECT correlation_id, severity, max_risk_score, decision FROM decided")
def t6(spark, sf):
    return gated(spark, sf).select("correlation_id", "severity", "max_risk_score", "decision")


@register("T6_suppressed_incidents", GATE_SQL + """ SELECT correlation_id, 'resolved' AS status, decision AS resolution FROM decided
  WHERE decision IN ('below_baseline', 'false_positive')""")
def t6_suppressed(spark, sf):
    return I.suppressed_incidents(gated(spark, sf)).select("correlation_id", "status", "resolution")


# Lifecycle: hourly windows per address, two hours of cooldown.
CYCLE_SQL = REQ + f""", alerts AS (SELECT event_id, ts, source_ip, risk_score, time_bucket(INTERVAL 1 HOUR, ts) AS w, {GROUP_SQL} AS grp FROM requests WHERE should_alert),
  p AS (SELECT *, CASE WHEN grp = 'sensitive' THEN 0 WHEN grp LIKE 'api%' THEN 1 WHEN grp = 'root' THEN 3 ELSE 2 END AS pri FROM alerts),
  lead AS (SELECT source_ip, w, arg_min(grp, {{'p': pri, 't': ts, 'e': event_id}}) AS grp, count(*) AS evidence_count,
     list({{'p': pri, 'g': grp, 's': risk_score::DOUBLE}} ORDER BY ts, event_id) AS ev FROM p GROUP BY 1, 2),
  risk AS (SELECT p.source_ip, p.w, max(p.risk_score)::DOUBLE AS r FROM p JOIN lead USING (source_ip, w, grp) GROUP BY 1, 2),
  inc AS (SELECT source_ip, w, r, ev, CASE WHEN r >= 90 THEN 4 WHEN r >= 70 THEN 3 WHEN r >= 40 THEN 2 ELSE 1 END AS sev,
     row_number() OVER (PARTITION BY source_ip ORDER BY w) AS n FROM lead JOIN risk USING (source_ip, w))"""
CYCLE_FOLD = """, fold AS (
    SELECT source_ip, n, w, w AS opened, 'NEW_ALERT' AS action, sev AS cur, r AS score, ev AS evidence FROM inc WHERE n = 1
    UNION ALL
    SELECT source_ip, n, w, opened, action, CASE WHEN action = 'FRESH' THEN sev WHEN esc THEN greatest(merged, sev) ELSE merged END,
      CASE WHEN action = 'FRESH' THEN r ELSE score END, evidence
    FROM (SELECT *, CASE WHEN score >= 90 THEN 4 WHEN score >= 70 THEN 3 WHEN score >= 40 THEN 2 ELSE 1 END AS merged FROM (
      SELECT *, list_max([x.s FOR x IN evidence IF x.g = first_g]) AS score FROM (
        SELECT *, [x.g FOR x IN evidence IF x.p = list_min([y.p FOR y IN evidence])][1] AS first_g FROM (
          SELECT i.source_ip, i.n, i.w, i.r, i.sev, CASE WHEN f.w + INTERVAL 2 HOUR > i.w THEN f.opened ELSE i.w END AS opened,
            CASE WHEN f.w + INTERVAL 2 HOUR <= i.w THEN 'FRESH' WHEN i.sev > f.cur THEN 'NEW_ALERT' ELSE 'MERGED' END AS action,
            i.sev > f.cur AS esc,
            CASE WHEN f.w + INTERVAL 2 HOUR > i.w THEN list_concat(f.evidence, i.ev) ELSE i.ev END AS evidence
          FROM fold f JOIN inc i ON i.source_ip = f.source_ip AND i.n = f.n + 1)))))"""
CYCLE_OUT = """ SELECT source_ip, w AS window_start, CASE action WHEN 'FRESH' THEN 'NEW_ALERT' ELSE action END AS action,
  CASE cur WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, score AS max_risk_score,
  w + INTERVAL 2 HOUR AS cooldown_until, opened::DATE::VARCHAR AS opened_day FROM fold"""


def recursive(sql: str) -> str:
    return sql.replace("WITH b AS", "WITH RECURSIVE b AS", 1)


def lifecycle(spark, sf, **options):
    a = requests(spark, sf).where("should_alert")
    i = materialize(I.correlate(a, 60), "incidents")
    return i, L.process_incidents(i, I.incident_scores(a, 60), cooldown_minutes=120, **options)


@register("T7_incident_lifecycle", recursive(CYCLE_SQL + CYCLE_FOLD + CYCLE_OUT))
def t7(spark, sf):
    _, actions = lifecycle(spark, sf)
    day = F.concat_ws("-", F.substring("incident_id", 5, 4), F.substring("incident_id", 9, 2), F.substring("incident_id", 11, 2))
    return actions.select("source_ip", "window_start", "action", "severity", "max_risk_score", "cooldown_until", day.alias("opened_day"))


CROWDED_SQL = CYCLE_SQL.replace("SELECT event_id, ts, source_ip,", "SELECT event_id, ts, concat('10.9.0.', user_id % 3) AS source_ip,").replace(
    "INTERVAL 1 HOUR", "INTERVAL 6 HOUR")
CROWDED_FOLD = CYCLE_FOLD.replace("INTERVAL 2 HOUR", "INTERVAL 9 HOUR")


@register("T7_crowded_incidents", recursive(CROWDED_SQL + CROWDED_FOLD + """ SELECT source_ip, w AS window_start, CASE action WHEN 'FRESH' THEN 'NEW_ALERT' ELSE action END AS action,
  CASE cur WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, score AS max_risk_score, len(evidence)::BIGINT AS events_so_far FROM fold"""))
def t7_crowded(spark, sf):
    """Three addresses send all alerts, so incidents hold far more events than a stored list would."""
    a = requests(spark, sf).where("should_alert").withColumn("source_ip", F.concat(F.lit("10.9.0."), (F.col("user_id") % 3).cast("string")))
    i = materialize(I.correlate(a, 360), "incidents")
    actions = L.process_incidents(i, I.incident_scores(a, 360), cooldown_minutes=540)
    so_far = W.partitionBy("incident_id").orderBy("window_start")
    return actions.join(i.select("correlation_id", "evidence_count"), "correlation_id").select(
        "source_ip", "window_start", "action", "severity", "max_risk_score", F.sum("evidence_count").over(so_far).alias("events_so_far"))


# A batch of half the alerts of 20 days against all those of the last ten, known scanners, and nine hours of cooldown.
BATCH_SQL = GATE_SQL.replace("FROM requests WHERE should_alert)", "FROM requests WHERE should_alert AND event_id % 2 = 0 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY)", 1)
BATCH_SQL = BATCH_SQL.replace("batch AS (SELECT grp, count(*) AS n FROM alerts GROUP BY 1)", f"""stored AS (SELECT {GROUP_SQL} AS grp, count(*) AS n FROM requests
    WHERE should_alert AND ts >= (SELECT max(ts) FROM events) - INTERVAL 240 HOUR GROUP BY 1),
  batch AS (SELECT a.grp, greatest(any_value(coalesce(s.n, 0)), count(*)) AS n FROM alerts a LEFT JOIN stored s ON s.grp = a.grp GROUP BY 1),
  e2 AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
  ie AS (SELECT source_ip, window_start, arg_min(v, {{'t': ts, 'e': event_id}}) AS v FROM alerts JOIN e2 ON vec_id = event_id % 100 GROUP BY 1, 2),
  fp AS (SELECT correlation_id FROM inc JOIN ie USING (source_ip, window_start) JOIN e2 k ON k.label = 2 GROUP BY 1 HAVING max(list_cosine_similarity(ie.v, k.v)) >= 0.3)""")
BATCH_SQL = BATCH_SQL.replace("n > m + 600 * s", "n > m + 400 * s").replace(
    "WHEN NOT above THEN 'below_baseline' ELSE", "WHEN NOT above THEN 'below_baseline' WHEN correlation_id IN (SELECT correlation_id FROM fp) THEN 'false_positive' ELSE")
BATCH_SQL += """, ev AS (SELECT source_ip, window_start, list({'p': pri, 'g': grp, 's': risk_score::DOUBLE} ORDER BY ts, event_id) AS ev FROM p GROUP BY 1, 2),
  pinc AS (SELECT source_ip, window_start AS w, max_risk_score AS r, ev, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS sev,
     row_number() OVER (PARTITION BY source_ip ORDER BY window_start) AS n, correlation_id FROM decided JOIN ev USING (source_ip, window_start) WHERE decision = 'pass')"""
BATCH_SQL += CYCLE_FOLD.replace("FROM inc ", "FROM pinc ").replace("JOIN inc i", "JOIN pinc i").replace("INTERVAL 2 HOUR", "INTERVAL 9 HOUR")


@register("T6_alert_batch", recursive(BATCH_SQL + """ SELECT d.correlation_id, d.decision, CASE WHEN decision <> 'pass' THEN 'SUPPRESSED' WHEN f.action = 'MERGED' THEN 'MERGED' ELSE 'NEW_ALERT' END AS action
  FROM decided d LEFT JOIN pinc p USING (correlation_id) LEFT JOIN fold f ON f.source_ip = p.source_ip AND f.n = p.n"""))
def t6_batch(spark, sf):
    """All four gates, with stored counts of the last hours and false positives, then the lifecycle."""
    from logwarden.plans.alerting import process_alert_batch

    r, now = requests(spark, sf), latest(table(spark, sf, "events"))
    start = F.lit(now - timedelta(days=20)).cast("timestamp_ntz")
    e = table(spark, sf, "embeddings")
    batch = alerts(spark, sf).where((F.col("event_id") % 2 == 0) & (F.col("ts") >= start)).withColumn("vec_id", F.col("event_id") % 100).join(
        e.select("vec_id", "embedding"), "vec_id")
    known = e.where("label = 2").select(F.col("vec_id").cast("string").alias("incident_id"), "embedding", F.lit("scanner").alias("notes"))
    out = process_alert_batch(batch, r, now, attack_baselines(r), endpoint_min_floors(r), known, window_minutes=HOURS * 60, sigma=400.0,
                              similarity=0.3, cooldown_minutes=540, stored_hours=240, recon=8, brute_force=6, multi_vector=3)
    return out.actions.join(out.gated.select("correlation_id", "decision"), "correlation_id").select("correlation_id", "decision", "action")


@register("T7_managed_incidents", recursive(CYCLE_SQL + CYCLE_FOLD + """ SELECT source_ip, opened AS created_at, max(f.w) AS updated_at, count(*) AS windows,
   sum(len(i.ev))::BIGINT AS evidence_count, arg_max(score, f.w) AS max_risk_score,
   arg_max(CASE cur WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END, f.w) AS severity
   FROM fold f JOIN inc i USING (source_ip, n) GROUP BY 1, 2"""))
def t7_managed(spark, sf):
    i, actions = lifecycle(spark, sf)
    return L.managed_incidents(actions, i).select(
        F.col("source_ips")[0].alias("source_ip"), "created_at", "updated_at", "windows", "evidence_count", "max_risk_score", "severity")


@register("T8_action_counts", recursive(CYCLE_SQL + CYCLE_FOLD + """ SELECT count(*) AS correlated_count,
   count(*) FILTER (action IN ('FRESH', 'NEW_ALERT')) AS alert_sent_count, count(*) FILTER (action = 'MERGED') AS merged_count,
   0::BIGINT AS suppressed_count FROM fold"""))
def t8(spark, sf):
    return I.action_counts(lifecycle(spark, sf)[1])


@register("R5_managed_incident_list", recursive(CYCLE_SQL + CYCLE_FOLD + """ SELECT source_ip, opened AS created_at FROM fold GROUP BY 1, 2
   ORDER BY created_at DESC, source_ip LIMIT 20"""))
def r5(spark, sf):
    from logwarden.plans.reports import managed_incident_list
    i, actions = lifecycle(spark, sf)
    m = L.managed_incidents(actions, i).withColumn("incident_id", F.col("source_ips")[0])
    return managed_incident_list(m, 20).select(F.col("source_ips")[0].alias("source_ip"), "created_at")


@register("J4_active_overlap", INCIDENT_SQL + """, act AS (SELECT correlation_id AS incident_id, source_ip, window_start AS created, window_start + INTERVAL 12 HOUR AS until FROM inc WHERE severity = 'critical'),
  m AS (SELECT i.correlation_id, a.incident_id, a.created FROM inc i JOIN act a ON a.source_ip = i.source_ip AND a.created <= i.window_start AND a.until > i.window_start)
  SELECT correlation_id, first(incident_id ORDER BY created DESC, incident_id) AS incident_id FROM m GROUP BY 1""")
def j4(spark, sf):
    i = incidents(spark, sf).withColumn("source_ips", F.array("source_ip"))
    active = i.where("severity = 'critical'").select(
        F.col("correlation_id").alias("incident_id"), "source_ips", F.lit("cooldown").alias("status"), F.col("window_start").alias("created_at"),
        (F.col("window_start") + F.expr("INTERVAL 12 HOUR")).alias("cooldown_until"))
    return I.overlapping_active(i, active)


BUSY_SQL = REQ + """, act AS (SELECT event_id AS incident_id, CASE WHEN event_id % 3 = 0 THEN 'busy' ELSE source_ip END AS ip, ts AS created,
    ts + to_minutes(5 + event_id % 240) AS until FROM requests WHERE event_type_is_signup)
  SELECT a.event_id AS correlation_id, first(incident_id ORDER BY created DESC, incident_id) AS incident_id
  FROM (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'busy' ELSE source_ip END AS ip FROM requests WHERE should_alert) a
  JOIN act ON act.ip = a.ip AND created <= a.ts AND until > a.ts GROUP BY 1""".replace("event_type_is_signup", "attack_type = 'scanner'")


@register("J4_busy_address", BUSY_SQL)
def j4_busy(spark, sf):
    """One address holds a third of the alerts and of the stored incidents, whose cooldowns last from minutes to hours."""
    r = requests(spark, sf).withColumn("source_ips", F.array(F.when(F.col("event_id") % 3 == 0, "busy").otherwise(F.col("source_ip"))))
    active = r.where("attack_type = 'scanner'").select(
        F.col("event_id").alias("incident_id"), "source_ips", F.lit("cooldown").alias("status"), F.col("ts").alias("created_at"),
        (F.col("ts") + F.make_dt_interval(mins=(5 + F.col("event_id") % 240).cast("int"))).alias("cooldown_until"))
    return I.overlapping_active(r.where("should_alert").withColumnRenamed("event_id", "correlation_id"), active, now="ts")


# --- upserts and part merging ----------------------------------------------------------------

@register("S16_keyed_upsert", """WITH m AS (SELECT max(ts) AS now FROM events),
  x AS (SELECT user_id, arg_max(value, {'t': ts, 'e': event_id}) FILTER (ts < now - INTERVAL 7 DAY) AS v1,
     arg_max(value, {'t': ts, 'e': event_id}) FILTER (ts >= now - INTERVAL 7 DAY) AS v2, max(ts) AS last_seen FROM events, m GROUP BY 1)
  SELECT user_id, coalesce(v2, v1) AS value, last_seen FROM x""")
def s16(spark, sf):
    e = table(spark, sf, "events")
    day = F.lit(latest(e) - timedelta(days=7)).cast("timestamp_ntz")
    rows = e.select("user_id", "value", F.col("ts").alias("last_seen"), "event_id")
    order = F.struct("last_seen", "event_id")
    stored = sinks.latest_per_key(rows.where(F.col("last_seen") < day), "user_id", order)
    batch = rows.where(F.col("last_seen") >= day)
    once = sinks.upsert(stored, batch, "user_id", order)
    return sinks.upsert(once, batch, "user_id", order).drop("event_id")


@register("S17_merge_baselines", REQ + f""", m AS (SELECT max(ts) AS now FROM events), w AS (SELECT ts < now - INTERVAL 7 DAY AS old, dayofweek(ts) * 24 + hour(ts) AS how,
    {GROUP_SQL} AS g, concat(isoyear(ts), '-', week(ts)) AS wk, count(*) AS n FROM requests, m WHERE should_alert GROUP BY 1, 2, 3, 4),
  both_halves AS (SELECT how, g, avg(n) FILTER (old) AS m1, avg(n) FILTER (NOT old) AS m2 FROM w GROUP BY 1, 2)
  SELECT concat(how, ':', g) AS key, round(coalesce(m2, m1), 6) AS mean FROM both_halves""")
def s17(spark, sf):
    r = requests(spark, sf)
    day = F.lit(latest(table(spark, sf, "events")) - timedelta(days=7)).cast("timestamp_ntz")

    def keyed(df):
        return attack_baselines(df).select(F.concat_ws(":", "hour_of_week", "endpoint_group").alias("key"), F.round("mean", 6).alias("mean"))

    return sinks.upsert(keyed(r.where(F.col("ts") < day)), keyed(r.where(F.col("ts") >= day)), "key")


@register("S20_A21_merge_parts", """SELECT count(*) AS n_rows, sum(CAST(value * 100 AS BIGINT))::BIGINT AS cents, 'click,error,purchase,signup,view' AS kinds FROM events""")
def s20(spark, sf):
    e = table(spark, sf, "events")
    kinds = ["click", "error", "purchase", "signup", "view"]
    parts = sinks.merge_parts([e.where(F.col("event_type") == k).withColumn("part", F.lit(k)) for k in kinds])
    summaries = parts.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"), F.array(F.first("part")).alias("kinds"))
    return sinks.merge_summaries(summaries, ["n_rows", "cents"], ["kinds"]).withColumn("kinds", joined("kinds"))


@register("S21_schema_migration", REQ + "SELECT event_id, 2 AS schema_version, source_ip, uri, risk_score FROM requests WHERE event_id % 3 <> 0")
def s21(spark, sf):
    r = requests(spark, sf).withColumn("_schema_version", F.when(F.col("event_id") % 3 == 0, 2).when(F.col("event_id") % 3 == 1, 1))
    return sinks.migrate(r).select("event_id", F.col("_schema_version").alias("schema_version"), "request.source_ip", "request.uri", "scoring.risk_score")


@register("S21_migration_dry_run", "SELECT count(*) FILTER (event_id % 3 <> 0) AS rows_to_migrate FROM events")
def s21_dry(spark, sf):
    r = requests(spark, sf).withColumn("_schema_version", F.when(F.col("event_id") % 3 == 0, 2).when(F.col("event_id") % 3 == 1, 1))
    return sinks.migration_count(r)


@register("T9_mark_false_positive", """SELECT vec_id::VARCHAR AS incident_id, CASE WHEN vec_id = (SELECT min(vec_id) FROM embeddings) THEN 'resolved' ELSE 'cooldown' END AS status FROM embeddings""")
def t9(spark, sf):
    emb = table(spark, sf, "embeddings")
    rows = emb.select(F.col("vec_id").cast("string").alias("incident_id"), "embedding", F.lit("t").alias("title"),
                      F.lit("single").alias("behavior_type"), F.lit("cooldown").alias("status"))
    first = emb.agg(F.min("vec_id").alias("m")).first()["m"]
    updated, _ = L.mark_false_positive(rows, str(first), "known scanner", latest(table(spark, sf, "events")))
    return updated.select("incident_id", "status")


@register("T9_false_positive_row", """SELECT vec_id::VARCHAR AS incident_id, 'known scanner' AS notes, 't' AS title, 'single' AS attack_type, len(embedding)::INTEGER AS dimensions,
  round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, (SELECT max(ts) FROM events) AS created_at FROM embeddings WHERE vec_id = (SELECT max(vec_id) FROM embeddings)""")
def t9_row(spark, sf):
    """The row that is stored; the vector is that of the first evidence that has one."""
    emb = table(spark, sf, "embeddings")
    evidence = F.array(*[F.struct(F.lit(i).alias("event_id"), v.alias("embedding")) for i, v in enumerate((F.lit(None).cast("array<float>"), F.col("embedding").cast("array<float>")))])
    rows = emb.select(F.col("vec_id").cast("string").alias("incident_id"), evidence.alias("evidence"), F.lit("t").alias("title"),
                      F.lit("single").alias("behavior_type"), F.lit("cooldown").alias("status"))
    last = emb.agg(F.max("vec_id").alias("m")).first()["m"]
    _, row = L.mark_false_positive(rows, str(last), "known scanner", latest(table(spark, sf, "events")))
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda x, y: x + y)
    return row.select("incident_id", "notes", "title", "attack_type", F.size("embedding").alias("dimensions"), F.round(total, 6).alias("total"), "created_at")


# --- streams over the event table ------------------------------------------------------------

def event_stream(spark, sf):
    return SI.stream_table(spark, sf, table(spark, sf, "events").schema, "events.parquet")


@register("T11_stream_drop_repeats", "SELECT event_id, user_id, event_type FROM events")
def t11(spark, sf):
    stream = event_stream(spark, sf)
    doubled = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = new_work_path(spark, "dedup")
    q = (SI.drop_repeats(doubled, delay="400 days").writeStream.format("parquet").option("checkpointLocation", out + "-ckpt")
         .option("path", out).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id", "event_type")


@register("T1_S22_stream_scored_upsert", REQ + "SELECT event_id, source_ip, uri, risk_score, final_label FROM requests")
def t1(spark, sf):
    out = new_work_path(spark, "requests")
    SI.upsert_stream(event_stream(spark, sf), out, out + "-ckpt", request_rows, once=True).awaitTermination()
    return sinks.read_current(spark, out).select("event_id", "source_ip", "uri", "risk_score", "final_label")


@register("T2_stream_window_counts", REQ + f""", a AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, source_ip, {GROUP_SQL} AS endpoint_group,
    risk_score, ts FROM requests WHERE should_alert)
  SELECT window_start, source_ip, endpoint_group, count(*) AS events, max(risk_score)::DOUBLE AS top_score FROM a
  WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM a) GROUP BY 1, 2, 3""")
def t2_stream(spark, sf):
    out = new_work_path(spark, "windows")
    counts = SA.windowed_counts(request_rows(event_stream(spark, sf)).where("should_alert"), 60)
    q = (counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", out + "-ckpt")
         .option("path", out).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).select("window_start", "source_ip", "endpoint_group", "events", "top_score")


def shuffled_stream(spark, sf, batches=4, jitter=2):
    """The event table as a stream of files in rough order of time: each event up to ``jitter`` hours late."""
    folder = new_work_path(spark, "arrivals")
    e = table(spark, sf, "events")
    late = F.make_interval(secs=F.pmod(F.xxhash64("event_id"), F.lit(3600 * jitter)))
    span = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    share = F.timestamp_diff("SECOND", F.lit(span["a"]).cast("timestamp_ntz"), F.col("ts") + late) / (span["b"] - span["a"] + timedelta(hours=jitter, seconds=1)).total_seconds()
    parts = e.withColumn("part", F.floor(share * batches))
    for part in range(batches):
        parts.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(folder)
    return request_rows(SI.stream_table(spark, folder, e.schema, files_per_batch=1)).where("should_alert")


@register("T2_stream_correlated", INCIDENT_SQL + """ SELECT correlation_id, title, behavior_type, source_ip, attack_types, evidence_count, endpoint_count,
  max_risk_score, severity, window_start FROM inc""")
def t2_stream_correlated(spark, sf):
    """Correlation over several micro-batches of out-of-order events equals that over the table, to the last window."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", SA.ROCKSDB)
    stream = shuffled_stream(spark, sf).withColumn("source_ip", F.concat(F.lit("10.0.0."), (F.col("user_id") % 8).cast("string")))
    out = new_work_path(spark, "correlated")
    SA.correlate_stream(stream, out, out + "-ckpt", HOURS * 60, once=True, delay="3 hours", recon=8, brute_force=6, multi_vector=3).awaitTermination()
    return spark.read.parquet(out).withColumn("attack_types", joined("attack_types")).drop("evidence", "window_end")


@register("T7_stream_lifecycle", recursive(CYCLE_SQL + CYCLE_FOLD + CYCLE_OUT))
def t7_stream(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", SA.ROCKSDB)
    incidents_path, out = new_work_path(spark, "incidents"), new_work_path(spark, "actions")
    SA.correlate_stream(shuffled_stream(spark, sf), incidents_path, incidents_path + "-ckpt", 60, once=True, delay="3 hours").awaitTermination()
    feed = spark.readStream.schema(spark.read.parquet(incidents_path).schema).parquet(incidents_path)
    q = (SA.lifecycle_stream(feed, 120).writeStream.format("parquet").outputMode("append").option("checkpointLocation", out + "-ckpt")
         .option("path", out).trigger(availableNow=True).start())
    q.awaitTermination()
    day = F.concat_ws("-", F.substring("incident_id", 5, 4), F.substring("incident_id", 9, 2), F.substring("incident_id", 11, 2))
    return spark.read.parquet(out).select("source_ip", "window_start", "action", "severity", "max_risk_score", "cooldown_until", day.alias("opened_day"))

