"""Streams end in the same tables as batches."""

from pyspark.sql import functions as F

from logwarden.operators.lifecycle import process_incidents
from logwarden.operators.incidents import correlate, incident_evidence
from logwarden.plans.flow import analyze_lines
from logwarden.plans.reports import report_tables
from logwarden.sources.lines import discover_files, read_log_records
from logwarden.sources.sinks import read_current
from logwarden.streaming import alerting as SA, ingest as SI

GOOD = '10.0.0.{} - - [31/May/2026:12:0{}:00 +0000] "GET {} HTTP/1.1" 200 5 "-" "{}"'
ATTACK = "/?q=%3Cscript%3Ealert(1)%3C/script%3E"


def write_logs(folder):
    (folder / "apache").mkdir(parents=True)
    (folder / "iis").mkdir()
    (folder / "apache" / "access.log").write_text("\n".join([GOOD.format(1, 1, "/", "x"), GOOD.format(1, 2, ATTACK, "sqlmap/1.7"), "garbage"]))
    (folder / "iis" / "u.log").write_text("#Fields: date time c-ip cs-method cs-uri-stem sc-status\n2026-05-31 12:00:00 10.0.0.9 GET /admin/ 200\n")


def test_files_to_report(spark, tmp_path):
    write_logs(tmp_path)
    found = {r.run_id: r.server_type for r in discover_files(spark, str(tmp_path)).collect()}
    assert found == {"apache__access": "apache", "iis__u": "iis"}
    scored = analyze_lines(read_log_records(spark, str(tmp_path)))
    got = {(r.server_type, r.line_number): (r.final_label, r.attack_type, r.parse_status) for r in scored.collect()}
    assert got[("apache", 1)] == ("benign", None, "success") and got[("apache", 3)][2] == "error"
    assert got[("apache", 2)][:2] == ("malicious", "xss") and got[("iis", 2)][1] == "sensitive_path"
    tables = {k: v.collect() for k, v in report_tables(scored).items()}
    assert tables["counts"][0].scored_records == 4 and tables["counts"][0].parse_errors == 1
    assert tables["top_attack_types"][0]["attack_type"] in ("xss", "sensitive_path")


def test_scored_upsert_stream_replays_cleanly(spark, tmp_path):
    write_logs(tmp_path / "in")
    table, ckpt = str(tmp_path / "table"), str(tmp_path / "ckpt")
    for checkpoint in (ckpt, ckpt, str(tmp_path / "other")):
        stream = SI.stream_log_lines(spark, str(tmp_path / "in" / "apache"))
        SI.upsert_stream(stream, table, checkpoint, SI.score_batch, once=True).awaitTermination()
    rows = read_current(spark, table)
    assert rows.count() == 3 and rows.where("final_label = 'malicious'").count() == 1


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    """Repeated lines, continuation lines, a W3C file with a header change and bad UTF-8, in several micro-batches."""
    root = tmp_path / "in"
    write_logs(root)
    same = GOOD.format(7, 3, ATTACK, "sqlmap/1.7")
    (root / "apache" / "more.log").write_bytes("\n".join([same] * 20).encode() + b"\n\tcarried on\n" + GOOD.format(8, 4, "/caf", "x").encode() + b" \xe9\n\n")
    (root / "iis" / "v.log").write_text("#Fields: date time c-ip cs-method cs-uri-stem sc-status\n2026-05-31 12:00:00 10.0.0.9 GET /admin/ 200\n"
                                        "#Fields: date time cs-method cs-uri-stem c-ip sc-status\n2026-05-31 12:00:01 GET /a 10.0.0.9 200\n" * 2)
    kept = ["server_type", "line_number", "source_ip", "uri", "raw_log", "final_label", "risk_score", "parse_status"]
    batch = analyze_lines(read_log_records(spark, str(root))).select(*kept)
    table = str(tmp_path / "table")
    for checkpoint in ("a", "a", "b"):
        stream = SI.stream_log_lines(spark, str(root), files_per_batch=1)
        SI.upsert_stream(stream, table, str(tmp_path / checkpoint), SI.score_batch, once=True).awaitTermination()
    got = read_current(spark, table).select(*kept)
    want = sorted(map(str, batch.collect()))
    assert sorted(map(str, got.collect())) == want and len(want) == 29


def test_lifecycle_state_carries_over_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", SA.ROCKSDB)
    rows = [(str(i), f"10.0.0.{i % 2}", f"2026-05-31T12:{i * 4:02d}:00Z", "/api/db" if i % 3 else "/x", "xss", 45.0 + 7 * (i % 8)) for i in range(14)]
    df = spark.createDataFrame(rows, "event_id string, source_ip string, timestamp string, uri string, attack_type string, risk_score double")
    inc, ev = correlate(df), incident_evidence(df)
    batch = process_incidents(inc, ev)
    both = inc.join(ev, ["source_ip", "window_start"])
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for lo, hi in ((0, 20), (20, 40), (40, 60)):
        both.where((F.minute("window_start") >= lo) & (F.minute("window_start") < hi)).coalesce(1).write.mode("append").parquet(src)
        feed = spark.readStream.schema(both.schema).parquet(src)
        q = (SA.lifecycle_stream(feed).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c"))
             .option("path", out).trigger(availableNow=True).start())
        q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted(map(tuple, batch.collect())) and len(got) == inc.count()
