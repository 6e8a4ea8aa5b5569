"""Micro-batches of few large files use all cores."""

from pyspark.sql import functions as F

from logwarden.streaming.ingest import score_batch


def test_one_file_is_scored_by_all_cores(spark):
    line = F.concat(F.lit("10.0.0."), (F.col("id") % 250).cast("string"), F.lit(' - - [31/May/2026:12:00:00 +0000] "GET /?q='), F.col("id").cast("string"),
                    F.lit(' HTTP/1.1" 200 5 "-" "x"'))
    one = spark.range(0, 400, 1, 1).select(F.lit("file:/in/apache/a.log").alias("file"), F.lit(0).cast("long").alias("_start"), line.alias("value"))
    scored = score_batch(one).select("event_id", "line_number", "final_label")
    rows = scored.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.line_number for r in rows) == list(range(1, 401)) and len({r.event_id for r in rows}) == 400
    assert len({r.task for r in rows}) == spark.sparkContext.defaultParallelism


def test_only_what_is_asked_for_is_computed(spark):
    agent = F.when(F.col("id") % 3 == 0, "sqlmap").otherwise("x")
    uri = F.when(F.col("id") % 2 == 0, "/?q=1%27%20or%201%3D1--").otherwise("/static/a.png")
    line = F.concat(F.lit('10.0.0.1 - - [31/May/2026:12:00:00 +0000] "GET '), uri, F.lit(' HTTP/1.1" 200 5 "-" "'), agent, F.lit('"'))
    one = spark.range(0, 60, 1, 1).select(F.lit("file:/in/apache/a.log").alias("file"), F.lit(0).cast("long").alias("_start"), line.alias("value"))
    columns = ["event_id", "risk_score", "risk_bonus", "attack_types", "final_label"]
    scored = score_batch(one, columns)
    # Entropies are the costliest features and no part of a verdict.
    assert scored.columns == columns and "LOG2" not in scored._jdf.queryExecution().optimizedPlan().toString().upper()
    rows = sorted(map(tuple, scored.collect()))
    assert rows == sorted(map(tuple, score_batch(one).select(*columns).collect())) and len({r[1] for r in rows}) > 1
