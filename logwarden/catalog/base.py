"""Registry and the request views derived from the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from logwarden.functions.scales import label_of, risk_level
from logwarden.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Adds a query and, where SQL can say it on whole tables, its DuckDB twin."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose texts are costly to process, dealt out over all cores."""
    t = table(spark, sf, name)
    return spread(t, t.columns[0])


# The request log: events read as web requests. The same text runs in both engines.
REQUESTS_SQL = """
WITH b AS (SELECT event_id, ts, user_id, event_type, value,
                  regexp_extract(props, '([0-9]+)', 1) AS k FROM events),
r AS (SELECT event_id, ts, user_id,
        concat('10.0.', cast(user_id % 4 AS {string}), '.', cast(user_id % 250 AS {string})) AS source_ip,
        CASE event_type WHEN 'click' THEN concat('/api/items/', k)
                        WHEN 'view' THEN concat('/static/', k, '.png')
                        WHEN 'purchase' THEN '/api/orders'
                        WHEN 'signup' THEN '/admin/settings'
                        ELSE concat('/login?u=', k) END AS uri,
        CASE WHEN event_type = 'error' THEN 'sqli'
             WHEN event_type = 'signup' THEN 'scanner'
             WHEN event_type = 'purchase' AND value >= 100 THEN 'traversal'
             WHEN event_type = 'click' AND value >= 100 THEN 'xss' END AS attack_type,
        least(100, cast(floor(value) AS int)) AS risk_score
      FROM b),
requests AS (SELECT *, CASE WHEN risk_score >= 70 THEN 'malicious'
                            WHEN risk_score >= 25 THEN 'suspicious' ELSE 'benign' END AS final_label,
                    CASE WHEN risk_score >= 90 THEN 'critical' WHEN risk_score >= 70 THEN 'high'
                         WHEN risk_score >= 40 THEN 'medium' WHEN risk_score >= 25 THEN 'low' ELSE 'none' END AS risk_level,
                    risk_score >= 25 AS should_alert FROM r)
"""

# CTE list for DuckDB queries; continue with ", x AS (...)" or " SELECT ...".
REQ = REQUESTS_SQL.format(string="VARCHAR")
MALICIOUS = "(should_alert OR (attack_type IS NOT NULL AND attack_type NOT IN ('', 'Unknown', 'unknown', 'normal', 'benign')) OR risk_score >= 70)"
GROUP_SQL = """CASE WHEN regexp_matches(split_part(lower(uri), '?', 1), 'backup|db|admin|config|settings') THEN 'sensitive'
  WHEN split_part(lower(uri), '?', 1) = '/' THEN 'root'
  WHEN split_part(split_part(lower(uri), '?', 1), '/', 2) = 'api' AND split_part(split_part(lower(uri), '?', 1), '/', 3) <> ''
    THEN concat('api_', split_part(split_part(lower(uri), '?', 1), '/', 3))
  ELSE split_part(split_part(lower(uri), '?', 1), '/', 2) END"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Request rows of the event table."""
    return request_rows(table(spark, sf, "events"))


def request_rows(e: DataFrame) -> DataFrame:
    """Request rows of events; works on batches and streams."""
    k = F.regexp_extract("props", "([0-9]+)", 1)
    kind, value = F.col("event_type"), F.col("value")
    risk = F.least(F.lit(100), F.floor(value).cast("int"))
    text = "string"
    return e.select(
        "event_id", "ts", "user_id",
        F.concat(F.lit("10.0."), (F.col("user_id") % 4).cast(text), F.lit("."), (F.col("user_id") % 250).cast(text)).alias("source_ip"),
        F.when(kind == "click", F.concat(F.lit("/api/items/"), k)).when(kind == "view", F.concat(F.lit("/static/"), k, F.lit(".png")))
        .when(kind == "purchase", "/api/orders").when(kind == "signup", "/admin/settings")
        .otherwise(F.concat(F.lit("/login?u="), k)).alias("uri"),
        F.when(kind == "error", "sqli").when(kind == "signup", "scanner")
        .when((kind == "purchase") & (value >= 100), "traversal").when((kind == "click") & (value >= 100), "xss").alias("attack_type"),
        risk.alias("risk_score"), label_of(risk).alias("final_label"), risk_level(risk).alias("risk_level"),
        (risk >= 25).alias("should_alert"),
    )


def latest(df: DataFrame, ts: str = "ts") -> datetime:
    """Newest time of a table: the ``now`` of a report, never the wall clock."""
    return df.agg(F.max(ts).alias("t")).first()["t"]


def joined(c) -> F.col:
    """Array as text, so both engines hash the same value."""
    return F.array_join(c, ",")


def ntz(c):
    return F.col(c).cast("timestamp_ntz") if isinstance(c, str) else c.cast("timestamp_ntz")


# Web traffic with encoded payloads, written as access-log fields.
WEB_SQL = """
WITH b AS (SELECT event_id, ts, user_id, event_type, value,
                  cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k FROM events),
web AS (SELECT event_id, ts, k, value,
   concat('10.0.', cast(user_id % 4 AS VARCHAR), '.', cast(user_id % 250 AS VARCHAR)) AS source_ip,
   CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS http_method,
   CASE event_type
     WHEN 'error' THEN concat('/login?u=', cast(k AS VARCHAR), '%27%20or%201%3D1--%20%27')
     WHEN 'click' THEN CASE WHEN value >= 100 THEN concat('/api/items/', cast(k AS VARCHAR), '?q=%3Cscript%3Ealert(1)%3C/script%3E&p=', cast(k AS VARCHAR))
                            ELSE concat('/api/items/', cast(k AS VARCHAR), '?page=', cast(k AS VARCHAR), '&sort=a+b') END
     WHEN 'view' THEN CASE WHEN k % 10 = 0 THEN concat('/static/%252e%252e/%252e%252e/etc/passwd?v=', cast(k AS VARCHAR))
                           ELSE concat('/static/', cast(k AS VARCHAR), '.png') END
     WHEN 'purchase' THEN CASE WHEN k % 7 = 0 THEN concat('/api/orders?id=', cast(k AS VARCHAR), ';drop%20table%20x')
                               WHEN k % 7 = 1 THEN concat('/api/orders?id=', cast(k AS VARCHAR), '%20union%20select%201')
                               ELSE concat('/api/orders?id=', cast(k AS VARCHAR)) END
     ELSE '/admin/settings' END AS raw_uri,
   CASE WHEN k % 20 = 0 THEN 500 WHEN k % 20 = 1 THEN 404 WHEN k % 20 = 2 THEN 403 ELSE 200 END AS status_code,
   cast(floor(value * 10) AS BIGINT) AS response_size,
   CASE WHEN k % 3 = 0 THEN '-' ELSE 'https://example.org/start' END AS referrer,
   CASE k % 5 WHEN 0 THEN 'sqlmap/1.7 (https://sqlmap.org)' WHEN 1 THEN 'Mozilla/5.0 (X11; Linux x86_64)'
              WHEN 2 THEN 'Nikto/2.1.6' WHEN 3 THEN 'curl/8.0' ELSE 'Mozilla/5.0 (compatible; Nmap Scripting Engine)' END AS user_agent
   FROM b)
"""


def web_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Access-log fields of the event table, some with encoded attack payloads."""
    e = text_table(spark, sf, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    kind, value, s = F.col("event_type"), F.col("value"), k.cast("string")
    click = F.when(value >= 100, F.concat(F.lit("/api/items/"), s, F.lit("?q=%3Cscript%3Ealert(1)%3C/script%3E&p="), s)).otherwise(
        F.concat(F.lit("/api/items/"), s, F.lit("?page="), s, F.lit("&sort=a+b")))
    view = F.when(k % 10 == 0, F.concat(F.lit("/static/%252e%252e/%252e%252e/etc/passwd?v="), s)).otherwise(
        F.concat(F.lit("/static/"), s, F.lit(".png")))
    buy = (
        F.when(k % 7 == 0, F.concat(F.lit("/api/orders?id="), s, F.lit(";drop%20table%20x")))
        .when(k % 7 == 1, F.concat(F.lit("/api/orders?id="), s, F.lit("%20union%20select%201")))
        .otherwise(F.concat(F.lit("/api/orders?id="), s))
    )
    return e.select(
        "event_id", "ts",
        F.concat(F.lit("10.0."), (F.col("user_id") % 4).cast("string"), F.lit("."), (F.col("user_id") % 250).cast("string")).alias("source_ip"),
        F.when(kind == "purchase", "POST").otherwise("GET").alias("http_method"),
        F.when(kind == "error", F.concat(F.lit("/login?u="), s, F.lit("%27%20or%201%3D1--%20%27")))
        .when(kind == "click", click).when(kind == "view", view).when(kind == "purchase", buy)
        .otherwise("/admin/settings").alias("raw_uri"),
        F.when(k % 20 == 0, 500).when(k % 20 == 1, 404).when(k % 20 == 2, 403).otherwise(200).alias("status_code"),
        F.floor(value * 10).cast("bigint").alias("response_size"),
        F.when(k % 3 == 0, "-").otherwise("https://example.org/start").alias("referrer"),
        F.when(k % 5 == 0, "sqlmap/1.7 (https://sqlmap.org)").when(k % 5 == 1, "Mozilla/5.0 (X11; Linux x86_64)")
        .when(k % 5 == 2, "Nikto/2.1.6").when(k % 5 == 3, "curl/8.0")
        .otherwise("Mozilla/5.0 (compatible; Nmap Scripting Engine)").alias("user_agent"),
        F.lit("HTTP/1.1").alias("http_version"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
    )
