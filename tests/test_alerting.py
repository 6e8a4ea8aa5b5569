"""Correlation, baselines, lifecycle, false positives, streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logwarden.operators import aggregates as A, baselines as B, incidents as I, lifecycle as L, vectors as V
from logwarden.operators.evaluate import query_metrics
from logwarden.operators.ranks import hash_rank, seeded_hash, stratified_sample, top_k_per_group
from logwarden.sources.sinks import csv_ready, read_current, upsert, write_version
from logwarden.operators.ordered import fill_forward, number_rows, running_count

ALERT = "event_id string, source_ip string, timestamp string, uri string, attack_type string, risk_score double"
T0 = "2026-05-31T12:0"


def alerts(spark, rows):
    return spark.createDataFrame(rows, ALERT)


def test_four_alerts_make_three_incidents(spark):
    df = alerts(spark, [("1", "a", T0 + "1:00Z", "/x", "sqli", 80.0), ("2", "a", T0 + "2:00Z", "/y", "xss", 60.0), ("3", "a", T0 + "7:00Z", "/x", "normal", 20.0), ("4", "b", T0 + "1:00Z", "", "", 95.0)])
    got = {(r.source_ip, r.window_start.minute): r for r in I.correlate(df).collect()}
    assert len(got) == 3
    first = got[("a", 0)]
    assert (first.behavior_type, first.attack_types, first.evidence_count, first.severity) == ("multi_vector", ["sqli", "xss"], 2, "high")
    assert got[("a", 5)].behavior_type == "single" and got[("a", 5)].attack_types == [] and got[("b", 0)].severity == "critical"
    assert first.correlation_id.startswith("corr-") and len(first.correlation_id) == 17


def test_most_sensitive_group_decides(spark):
    rows = [(str(i), "a", T0 + "1:00Z", f"/p{i}", "xss", 95.0) for i in range(10)] + [("s", "a", T0 + "2:00Z", "/api/db-backup", "sqli", 75.0)]
    r = I.correlate(alerts(spark, rows)).first()
    assert (r.max_risk_score, r.severity, r.behavior_type) == (75.0, "high", "reconnaissance")


def test_baseline_defaults(spark):
    df = spark.createDataFrame([(0, "default", 10), (0, "default", 15), (0, "sensitive", 2), (0, "root", 99), (0, "api", 20)], "hour_of_week int, endpoint_group string, n bigint")
    got = {(r.endpoint_group, r.n): r for r in B.above_baseline(B.with_baseline(df, min_floor=2), "n").collect()}
    assert not got[("default", 10)].should_alert and got[("default", 15)].should_alert and got[("default", 15)].deviation_ratio == 5.0
    assert (got[("sensitive", 2)].floor, got[("sensitive", 2)].should_alert) == (2, True)
    assert not got[("root", 99)].should_alert and got[("api", 20)].floor == 20


def test_baseline_hour_fallback(spark):
    stored = spark.createDataFrame([(5, "g", 1.0, 0.0), (5, None, 9.0, 1.0)], "hour_of_week int, endpoint_group string, mean double, std_dev double")
    df = spark.createDataFrame([(5, "g"), (5, "h"), (6, "h")], "hour_of_week int, endpoint_group string")
    got = {(r.hour_of_week, r.endpoint_group): (r["mean"], r.std_dev) for r in B.with_baseline(df, stored).collect()}
    assert got == {(5, "g"): (1.0, 0.1), (5, "h"): (9.0, 1.0), (6, "h"): (5.0, 2.0)}


def test_nearest_rank(spark):
    import random
    random.seed(3)
    data = {k: [random.randint(0, 9) for _ in range(n)] for k, n in (("a", 1), ("b", 10), ("c", 37))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v bigint")
    for p in (0.0, 0.5, 0.9, 1.0):
        got = {r.k: r.x for r in B.nearest_rank(df, ["k"], "v", p, "x").collect()}
        assert got == {k: sorted(vs)[min(int(len(vs) * p), len(vs) - 1)] for k, vs in data.items()}


def lifecycle(spark, rows, **kw):
    df = alerts(spark, rows)
    i = I.correlate(df)
    return L.process_incidents(i, I.incident_evidence(df), **kw).orderBy("source_ip", "window_start").collect()


def test_severity_can_fall_on_merge(spark):
    a, b = lifecycle(spark, [("1", "a", T0 + "0:00Z", "/index.html", "xss", 85.0), ("2", "a", T0 + "6:00Z", "/api/db-backup", "xss", 65.0)])
    assert (a.action, a.severity) == ("NEW_ALERT", "high") and (b.action, b.severity, b.max_risk_score) == ("MERGED", "medium", 65.0)
    assert a.incident_id == b.incident_id


def test_escalation_and_cooldown(spark):
    rows = [("1", "a", "2026-05-31T12:00:00Z", "/x", "xss", 50.0), ("2", "a", "2026-05-31T12:10:00Z", "/x", "xss", 95.0), ("3", "a", "2026-05-31T12:20:00Z", "/x", "xss", 95.0),
            ("4", "a", "2026-05-31T12:50:00Z", "/x", "xss", 95.0)]
    got = lifecycle(spark, rows)
    assert [r.action for r in got] == ["NEW_ALERT", "NEW_ALERT", "MERGED", "NEW_ALERT"]
    assert got[0].incident_id == got[1].incident_id == got[2].incident_id != got[3].incident_id
    assert got[1].severity == "critical" and "escalation" in got[1].reason.lower()


def test_stored_state_continues(spark):
    rows = [(str(i), "a", f"2026-05-31T12:{i * 5:02d}:00Z", "/x", "xss", 50.0 + i) for i in range(8)]
    df = alerts(spark, rows)
    inc, ev = I.correlate(df), I.incident_evidence(df)
    whole = L.process_incidents(inc, ev).orderBy("window_start").collect()
    cut = F.lit("2026-05-31 12:20:00").cast("timestamp_ntz")
    first = L.process_incidents(inc.where(F.col("window_start") < cut), ev, keep_evidence=True)
    state = first.groupBy("source_ip").agg(F.max_by(F.struct("incident_id", "severity", "cooldown_until", "evidence"), "window_start").alias("s")).select("source_ip", "s.*")
    second = L.process_incidents(inc.where(F.col("window_start") >= cut), ev, active=state).orderBy("window_start").collect()
    assert [tuple(r) for r in whole[4:]] == [tuple(r) for r in second]


def test_evidence_is_capped_at_the_newest(spark):
    rows = [(f"{i:03d}", "a", f"2026-05-31T12:00:{i % 60:02d}Z", "/x", "xss", float(i)) for i in range(150)]
    got = I.incident_evidence(alerts(spark, rows)).first().evidence
    want = sorted(rows, key=lambda r: (r[2], r[0]))[-100:]
    assert [e.event_id for e in got] == [r[0] for r in want]


def test_gates_in_order(spark):
    rows = [(f"l{i}", "low", T0 + "1:00Z", "/a", "xss", 30.0) for i in range(20)] + [(f"h{i}", "hot", T0 + "1:00Z", "/b", "xss", 90.0) for i in range(60)] + [
        ("q", "quiet", T0 + "1:00Z", "/c", "xss", 90.0), ("f", "fp", T0 + "1:00Z", "/b", "xss", 90.0)]
    df = alerts(spark, rows)
    inc = I.correlate(df)
    known = inc.where("source_ip = 'fp'").select("correlation_id", F.lit(0.95).alias("similarity"), F.lit("scanner").alias("notes"))
    gated = I.gate_incidents(df, inc, I.baseline_gate(df, inc), known)
    got = {r.source_ip: (r.decision, r.reason) for r in gated.collect()}
    assert {k: v[0] for k, v in got.items()} == {"low": "below_severity", "hot": "pass", "quiet": "below_baseline", "fp": "false_positive"}
    assert "0.950" in got["fp"][1] and I.suppressed_incidents(gated).count() == 2
    actions = L.batch_actions(gated, L.process_incidents(gated.where("decision = 'pass'"), I.incident_evidence(df)))
    assert tuple(I.action_counts(actions).first()) == (4, 1, 0, 3)


def test_false_positive_marking(spark):
    inc = spark.createDataFrame([("i1", "t", "single", "cooldown", [("e", None), ("e2", [1.0, 0.0])]), ("i2", "t", "single", "cooldown", [])],
                                "incident_id string, title string, behavior_type string, status string, evidence array<struct<id:string,embedding:array<double>>>")
    updated, row = L.mark_false_positive(inc, "i1", "ok", datetime(2026, 1, 1))
    assert {r.incident_id: (r.status, r.resolution) for r in updated.collect()} == {"i1": ("resolved", "false_positive"), "i2": ("cooldown", None)}
    assert row.first().embedding == [1.0, 0.0]
    assert L.mark_false_positive(inc, "i2", "ok", datetime(2026, 1, 1))[1].count() == 0


def test_knn_blocks_and_ties(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    vecs = rng.integers(-2, 3, (60, 4)).astype(float)
    vecs[0] = [1, 0, 0, 0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs) if np.any(v)], "id bigint, embedding array<double>")
    rows = {r.id: np.array(r.embedding) for r in df.collect()}

    def cos(a, b):
        return round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)

    want = {(q, i) for q in rows for i in sorted((i for i in rows if i != q), key=lambda i: (-cos(rows[q], rows[i]), i))[:4]}
    for block in (4096, 7):
        got = V.knn(df, df.repartition(5), 4, skip_self=True, query_block=block)
        assert {(r.query_id, r.id) for r in got.collect()} == want
    lsh = V.knn_approximate(df, df, 5)
    assert V.search_recall(lsh, V.knn(df, df, 5)).first()["recall"] > 0.3
    inc = df.select(F.col("id").cast("string").alias("correlation_id"), "embedding")
    known = df.where("id < 9").select(F.col("id").cast("string").alias("incident_id"), "embedding", F.lit("n").alias("notes"))
    for block in (4096, 2):
        best = {r.correlation_id: round(r.similarity, 6) for r in V.false_positive_matches(inc, known, 0.5, block).collect()}
        mine = {str(q): max(cos(rows[q], rows[i]) for i in rows if i < 9) for q in rows}
        assert best == {q: pytest.approx(s, abs=1e-6) for q, s in mine.items() if s >= 0.5}


def test_text_search_against_brute_force(spark):
    docs = {1: "select union from", 2: "union select all", 3: "plain text here", 4: "plain plain union"}
    df = spark.createDataFrame(list(docs.items()), "id bigint, t string")
    for method in ("char_tfidf", "word_tfidf"):
        model = V.text_model(df, "id", F.col("t"), method)
        w = {}
        for r in model.collect():
            w.setdefault(r.doc, {})[r.term] = r.weight
        assert all(abs(sum(x * x for x in v.values()) - 1) < 1e-9 for v in w.values())
        got = {(r.query_id, r.id): r.score for r in V.sparse_scores(model, model, 3).collect()}
        for (q, i), s in got.items():
            assert abs(s - sum(w[q][t] * w[i].get(t, 0) for t in w[q])) < 1e-9


def test_metrics_by_hand(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, "c")], "id bigint, label string")
    matches = spark.createDataFrame([(1, 3, 1), (1, 2, 2), (1, 4, 3), (5, 1, 1)], "query_id bigint, id bigint, rank int")
    rows = query_metrics(matches, labels, labels.where("id in (1, 5)"), [1, 3]).collect()
    assert len(rows) == 1 and rows[0].precision_at_1 == 0 and rows[0].precision_at_3 == pytest.approx(2 / 3) and rows[0].mrr_at_3 == 0.5 and rows[0].recall_at_3 == 1.0
    assert rows[0].ndcg_at_3 == pytest.approx((1 / 1.584962500721156 + 0.5) / (1 + 1 / 1.584962500721156))


def test_ranks_match_plain_windows(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 11).alias("v"))
    got = {(r.g, r["rank"]): r.id for r in top_k_per_group(df, ["g"], [F.desc("v"), F.col("id")], 4, salts=5).collect()}
    rows = df.collect()
    for g in range(3):
        order = sorted((r for r in rows if r.g == g), key=lambda r: (-r.v, r.id))[:4]
        assert [got[(g, i + 1)] for i in range(4)] == [r.id for r in order]
    ranked = hash_rank(df.withColumn("h", seeded_hash("id", 1)), ["g"], "h", "id", "r", prefix=1).collect()
    for g in range(3):
        part = sorted((r for r in ranked if r.g == g), key=lambda r: (r.h, r.id))
        assert [r.r for r in part] == list(range(1, len(part) + 1))
    assert stratified_sample(df, "g", "id", 31).count() == 31


def test_ordered_operators_across_blocks(spark):
    df = spark.range(1, 101).select(F.lit("f").alias("file"), F.col("id").alias("pos"), (F.col("id") % 17 == 0).alias("flag"))
    filled = fill_forward(df, ["file"], "pos", F.when(F.col("flag"), F.col("pos")), "v", block_rows=10)
    counted = running_count(filled, ["file"], "pos", F.col("flag"), "n", block_rows=7)
    numbered = number_rows(counted.withColumn("blk", F.floor(F.col("pos") / 9)), ["file"], "blk", "pos", "no")
    for r in numbered.collect():
        assert (r.v, r.n, r.no) == (r.pos // 17 * 17 or None, r.pos // 17, r.pos)


def test_upsert_is_idempotent(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "event_id string, v int, kept string")
    batch = spark.createDataFrame([("b", 3), ("c", 4), (None, 5), ("", 6)], "event_id string, v int")
    once = upsert(old, batch)
    twice = upsert(once, batch)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 1, "x"), ("b", 3, "y"), ("c", 4, None)]
    path = str(tmp_path / "t")
    for batch_id, df in ((0, old.drop("kept")), (1, batch), (1, batch)):
        write_version(df, path, batch_id)
    assert sorted(map(tuple, read_current(spark, path).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_csv_layout(spark):
    df = spark.createDataFrame([(1, ["x"], {"k": 1})], "z int, a array<string>, m map<string,int>")
    out = csv_ready(df, ["z", "missing"])
    assert out.columns == ["z", "missing", "a", "m"] and tuple(out.first()) == (1, None, '["x"]', '{"k":1}')


def test_campaign_levels_and_trend(spark):
    df = spark.createDataFrame([(30, 1), (15, 1), (1, 2), (1, 1)], "n int, t int")
    assert [r[0] for r in df.select(A.campaign_risk_level(F.col("n"), F.col("t"))).collect()] == ["critical", "high", "medium", "low"]
    t = A.trend(F.lit(5), F.lit(0))
    assert tuple(spark.range(1).select(t["direction"], t["percent"], t["delta"]).first()) == ("up", None, 5)


def test_soc_summary_uses_incidents_first(spark):
    now = datetime(2026, 1, 2)
    req = spark.createDataFrame([(now - timedelta(hours=h), "1.1.1.1", "/x", "xss", 90) for h in (1, 2, 30)], "ts timestamp_ntz, source_ip string, uri string, attack_type string, risk_score int")
    inc = spark.createDataFrame([(now - timedelta(hours=1), "low", 10)], "ts timestamp_ntz, severity string, risk_score int")
    a, b = A.soc_summary(req, inc, None, "24h", now).first(), A.soc_summary(req, None, None, "24h", now).first()
    assert (a.total_requests, a.total_incidents, a.high_severity_incidents, a.total_requests_trend_delta) == (2, 1, 2, 1)
    assert b.total_incidents == 2
