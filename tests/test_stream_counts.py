"""A stream's windows are counted by Spark's own aggregations, and equal those of the batch."""

import pytest

from logwarden.operators.incidents import correlate, incident_scores
from logwarden.streaming import alerting as SA


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata"])
def test_windows_are_counted_without_a_call_for_each(spark, tmp_path, zone):
    rows = [(i, None if i % 11 == 0 else f"10.0.0.{i % 3}", f"2026-05-31 {10 + i // 30:02d}:{i * 7 % 60:02d}:00.{i:06d}", ["/admin/x", f"/api/u{i % 4}", "/", ""][i % 4],
             [None, "xss", "sqli", "Benign"][i // 2 % 4], float(i % 9 * 10)) for i in range(150)]
    df = spark.createDataFrame(rows, "event_id long, source_ip string, ts string, uri string, attack_type string, risk_score double").selectExpr(
        "event_id", "source_ip", "cast(ts as timestamp_ntz) as ts", "uri", "attack_type", "risk_score")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", SA.ROCKSDB)
    try:
        src, out = str(tmp_path / "src"), str(tmp_path / "out")
        for part in range(2):
            df.where(f"event_id div 75 = {part}").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        assert "InPandas" not in SA.correlated_stream(stream, 60)._jdf.queryExecution().analyzed().toString()
        SA.correlate_stream(stream, out, out + "-ckpt", 60, once=True, delay="3 hours").awaitTermination()
        got = spark.read.parquet(out)
        key = lambda d: sorted(map(str, d.collect()))
        want = correlate(df, 60)
        assert key(got.select(*want.columns)) == key(want) and got.count() > 10
        scores = incident_scores(df, 60)
        assert key(got.selectExpr("source_ip", "window_start", "transform(evidence, e -> struct(e.ts, cast(e.event_id as string), e.grp, e.score)) as e")) == key(
            scores.selectExpr("source_ip", "window_start", "transform(evidence, e -> struct(e.ts, cast(e.event_id as string), e.grp, e.score)) as e"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
