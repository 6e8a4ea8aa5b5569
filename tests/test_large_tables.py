"""Operators whose disk, memory or tasks grew faster than their tables."""

import numpy as np
from pyspark.sql import functions as F

from logwarden.operators import vectors as V
from logwarden.operators.incidents import overlapping_active
from logwarden.session import spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_approximate_search_moves_no_pairs(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(700, 16)).astype("float32")
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)] + [(700, None), (701, [1.0])], "vec_id bigint, embedding array<float>")
    queries = df.where("vec_id % 20 = 0")
    planes = np.array(V.sign_projections(16, 4, 5), float)
    sign = (np.einsum("bjd,nd->nbj", planes, rows.astype(float)) > 0)
    unit = rows / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    near = {i: [j for j in range(700) if j != i and ((sign[i] != sign[j]).sum(axis=1) <= 1).any()] for i in range(0, 700, 20)}
    found = V.knn_approximate(queries, df, 3, "vec_id", bands=4, bits=5, skip_self=True)
    assert "Join" not in plan(found)
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {i: sorted(js, key=lambda j: (-round(float(unit[i] @ unit[j]), 9), j))[:3] for i, js in near.items() if js}
    counts = {r["query_id"]: r["candidates"] for r in V.candidate_counts(queries, df, "vec_id", bands=4, bits=5, skip_self=True).collect()}
    assert counts == {i: len(js) for i, js in near.items() if js}
    pairs = V.approximate_candidates(queries, df, "vec_id", bands=4, bits=5, skip_self=True)
    assert sorted(map(tuple, pairs.collect())) == sorted((i, j) for i, js in near.items() for j in js)


def test_tfidf_keeps_rows_of_common_terms_in_place(spark):
    texts = [(i, " ".join(f"w{(i * k) % 7} only{i}" for k in range(1, 6))) for i in range(60)]
    df = spark.createDataFrame([*texts, (60, None), (61, "")], "id bigint, t string")
    for method in ("char_tfidf", "word_tfidf"):
        models = [V.text_model(df, "id", F.col("t"), method, frequent=n) for n in (10 ** 6, 150, 20, 0)]
        rows = [{(r.doc, r.term): round(r.weight, 9) for r in m.collect()} for m in models]
        assert rows[0] and all(r == rows[0] for r in rows[1:])
        # The texts are moved once; no exchange holds one row per document and term but those of rare terms.
        assert plan(models[0]).count("Exchange hashpartitioning") == 1
    numbers = V.numeric_vectors(df.select(F.col("id").alias("doc"), F.length("t").alias("a")), "doc", ["a"])
    hybrid = V.hybrid_vectors(V.text_model(df, "id", F.col("t"), parts=9), numbers, parts=9)
    assert plan(hybrid).count("Exchange hashpartitioning") == 2


def test_sparse_scores_by_either_join(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 9))) for i in range(40)], "id bigint, t string")
    model = V.text_model(df, "id", F.col("t"), "word_tfidf")
    sent, sliced = (V.sparse_scores(model.where("doc < 5"), model, 3, sent=n) for n in (10 ** 6, 0))
    keys = [sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in d.collect()) for d in (sent, sliced)]
    assert keys[0] == keys[1] and len(keys[0]) == 15


def test_crowded_bucket_forms_no_pairs(spark):
    rng = np.random.default_rng(3)
    kept = [(int(i), ["busy"], "open", int(b), int(b + rng.integers(1, 4000))) for i, b in enumerate(rng.integers(0, 40, 400) * 100)]
    asked = [(int(i), ["busy", "calm"], int(t)) for i, t in enumerate(rng.integers(0, 80, 300) * 100)]
    time = lambda name: F.timestamp_seconds(F.col(name)).alias(name)
    active = spark.createDataFrame(kept, "incident_id int, source_ips array<string>, status string, created_at int, cooldown_until int").select(
        "incident_id", "source_ips", "status", time("created_at"), time("cooldown_until"))
    incidents = spark.createDataFrame(asked, "correlation_id int, source_ips array<string>, window_start int").select(
        "correlation_id", "source_ips", time("window_start"))
    found = overlapping_active(incidents, active)
    assert "Join" not in plan(found)
    want = {}
    for i, _, t in asked:
        best = min(((-b, k) for k, _, _, b, e in kept if b <= t < e), default=None)
        if best:
            want[i] = best[1]
    assert {r["correlation_id"]: r["incident_id"] for r in found.collect()} == want


def test_large_tables_are_dealt_over_more_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(1000, numPartitions=3 * cores)
    assert spread(rows, "id", rows=10).rdd.getNumPartitions() == 100
    assert spread(rows, "id").rdd.getNumPartitions() == cores
