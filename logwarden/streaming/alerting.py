"""Streaming correlation and incident lifecycle.

Both keep state per key in the state store, end it by event-time timers, and give the rows that the
batch operators give over the same events, whatever the order and number of micro-batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from logwarden.operators.incidents import (
    BRUTE_FORCE_EVENTS, MULTI_VECTOR_TYPES, RECON_ENDPOINTS, alert_events, describe_incidents, group_priority,
)
from logwarden.operators.lifecycle import (
    COOLDOWN_MINUTES, OUTPUT, Lead, OpenIncident, advance, evidence_tuples, output_row,
)

_STATE = StructType([StructField("incident", StringType())])


def windowed_counts(alerts: DataFrame, window_minutes: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Events, best score and time span per address, window and endpoint group, on a stream.

    Late rows past the watermark are dropped. State holds one small row per key.
    """
    events = alert_events(alerts, window_minutes).drop("window_start").withColumn(
        "ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return events.groupBy(
        F.window("ts", f"{window_minutes} minutes").alias("w"), "source_ip", "endpoint_group").agg(
        F.count(F.lit(1)).alias("events"), F.max("score").alias("top_score"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    ).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "source_ip", "endpoint_group",
             group_priority(F.col("endpoint_group")).alias("priority"), "events", "top_score", "first_seen", "last_seen")


def _instant(ts: Column) -> Column:
    """A local time as an instant, as if it were UTC: watermarks need an instant, windows follow the local time."""
    return F.to_timestamp(F.concat(ts.cast("string"), F.lit("Z")))


def _local(micros: Column) -> Column:
    """The local time of such an instant, given in micros."""
    return F.expr("timestamp_ntz'1970-01-01'") + F.make_dt_interval(secs=micros.cast("decimal(20,0)") / F.lit(1_000_000))


def correlated_stream(alerts: DataFrame, window_minutes: int = 5, delay: str = "10 minutes", recon: int = RECON_ENDPOINTS,
                      brute_force: int = BRUTE_FORCE_EVENTS, multi_vector: int = MULTI_VECTOR_TYPES) -> DataFrame:
    """Correlated incidents of a stream of alerts, one per address and time window, as ``correlate`` gives them.

    A window is given out once the watermark, the newest event time less ``delay``, has passed its end; rows that
    come later are dropped. Rows with a true ``is_mark`` only move the watermark. Adds ``evidence``, the most
    sensitive groups as of ``incident_scores``. Two aggregations hold the state: of each window's URIs, types and groups, and
    of the windows.
    """
    events = alert_events(alerts, window_minutes)
    id_type = events.schema["event_id"].dataType.simpleString()
    named = (F.col("attack_type") != "") & ~F.lower("attack_type").isin("normal", "benign")
    rows = events.withColumn("ts", _instant(F.col("ts").cast("timestamp_ntz"))).withWatermark("ts", delay)
    # Marks leave behind the watermark, not before it: a condition that reads the time isn't pushed through.
    mark = F.col("is_mark") if "is_mark" in events.columns else F.lit(False)
    # An event counts for its URI, its type and its group, which are rows of the state: none of their sets is held in memory
    # but those that are given out.
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    entries = F.array(entry("uri", F.col("uri")), entry("type", F.when(named, F.col("attack_type"))), entry("group", F.col("endpoint_group")))
    counted = rows.where(F.when(F.col("ts").isNotNull(), ~mark)).select(
        "ts", "source_ip", "score", F.unix_micros("ts").alias("at"),
        F.coalesce("event_id", F.lit("" if id_type == "string" else -1).cast(id_type)).alias("event_id"), F.explode(entries).alias("e")
    ).where("e.value is not null and (e.kind <> 'uri' or e.value <> '')").groupBy(F.window("ts", f"{window_minutes} minutes").alias("w"), "source_ip", "e.kind", "e.value").agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("score"), F.min(F.struct("at", "event_id")).alias("first"))
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    group = F.struct(group_priority(F.col("value")).alias("priority"), "first", "score", "value")
    closed = counted.groupBy("w", "source_ip").agg(
        F.sum(of("group", F.col("n"))).alias("evidence_count"), F.count(of("uri", F.lit(1))).alias("endpoint_count"),
        F.array_sort(F.collect_list(of("type", F.struct("first", "value")))).alias("types"),
        F.array_sort(F.collect_list(of("group", group))).alias("groups"))
    leading = F.filter("groups", lambda g: g["priority"] == F.col("groups")[0]["priority"])
    facts = closed.select(
        "source_ip", _local(F.unix_micros("w.start")).alias("window_start"), "evidence_count", "endpoint_count",
        F.get("types", F.lit(0))["value"].alias("first_type"), F.array_sort(F.transform("types", lambda t: t["value"])).alias("attack_types"),
        F.col("groups")[0]["score"].alias("max_risk_score"), F.transform(leading, lambda g: F.struct(
            _local(g["first"]["at"]).alias("ts"), g["first"]["event_id"].alias("event_id"), g["value"].alias("grp"), g["score"].alias("score"))).alias("evidence"))
    return describe_incidents(facts, window_minutes, recon, brute_force, multi_vector, keep=["evidence"])


def correlate_stream(alerts: DataFrame, table: str, checkpoint: str, window_minutes: int = 5, once: bool = False,
                     delay: str = "10 minutes", **limits: int) -> StreamingQuery:
    """Appends the incidents of a stream of alerts to a table of files; see ``correlated_stream``.

    With ``once`` the input that is there is taken as all there is: when it has been read, a mark moves the watermark
    past the last window, so that no window is left behind. Marks are rows that only carry a time, in a stream of
    their own beside the table.
    """
    spark = alerts.sparkSession
    marks, kinds = f"{table}-marks", alerts.withColumn("is_mark", F.lit(False)).schema
    spark.createDataFrame([], kinds).write.mode("append").parquet(marks)
    both = alerts.withColumn("is_mark", F.lit(False)).unionByName(spark.readStream.schema(kinds).parquet(marks))

    def start() -> StreamingQuery:
        writer = correlated_stream(both, window_minutes, delay, **limits).writeStream.format("parquet").outputMode("append").option(
            "checkpointLocation", checkpoint).option("path", table)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()

    query = start()
    if not once:
        return query
    query.awaitTermination()
    newest = [p["eventTime"]["max"] for p in query.recentProgress if (p["eventTime"] or {}).get("max")]
    if newest:
        moment = next(c for c in ("timestamp", "ts", "event_time") if c in alerts.columns)
        last = F.to_timestamp_ntz(F.lit(max(newest).rstrip("Z"))) + F.expr(f"INTERVAL {delay}") + F.expr(f"INTERVAL {window_minutes} MINUTE")
        row = {moment: last, "is_mark": F.lit(True)}
        spark.range(1).select(*[row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds]).write.mode("append").parquet(marks)
        query = start()
    return query


class IncidentProcessor(StatefulProcessor):
    """Open incident of one address, carried from batch to batch and forgotten once its cooldown has passed."""

    def __init__(self, cooldown_minutes: int = COOLDOWN_MINUTES):
        self.cooldown = timedelta(minutes=cooldown_minutes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("window_start")
        state = self._load()
        out = []
        for row in batch.to_dict("records"):
            row["evidence"] = evidence_tuples(row["evidence"])
            state, result = advance(state, row, self.cooldown)
            out.append(output_row(row, state, result))
        self._store(state, int(batch["ends"].iloc[-1] // 1000 + self.cooldown.total_seconds() * 1000))
        yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not list(self.handle.listTimers()):  # a later window has set a later timer
            self.open.clear()
        yield from ()

    def _load(self) -> OpenIncident | None:
        if not self.open.exists():
            return None
        d = json.loads(self.open.get()[0])
        return OpenIncident(d["id"], d["severity"], datetime.fromisoformat(d["until"]), Lead(*d["lead"]) if d["lead"] else None)

    def _store(self, state: OpenIncident, expires: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(expires)
        lead = state.lead and [state.lead.rank, state.lead.group, state.lead.score]
        self.open.update((json.dumps({"id": state.incident_id, "severity": state.severity, "until": state.cooldown_until.isoformat(), "lead": lead}),))

    def close(self) -> None:
        pass


def lifecycle_stream(incidents: DataFrame, cooldown_minutes: int = COOLDOWN_MINUTES) -> DataFrame:
    """Actions for a stream of correlated incidents, keyed by address.

    Incidents of one address must arrive in window order across batches, as ``correlate_stream`` writes them.
    State ends when the watermark, the newest window less one cooldown, has passed the cooldown. Needs the
    RocksDB state store.
    """
    moment = F.col("window_start").cast("timestamp")
    slim = incidents.withColumn("moment", moment).withWatermark("moment", f"{cooldown_minutes} minutes").select(
        "correlation_id", "source_ip", "window_start", "severity", F.col("max_risk_score").cast("double").alias("max_risk_score"), "evidence",
        F.unix_micros("moment").alias("ends"))
    return slim.groupBy("source_ip").transformWithStateInPandas(
        statefulProcessor=IncidentProcessor(cooldown_minutes), outputStructType=OUTPUT,
        outputMode="Append", timeMode="EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
