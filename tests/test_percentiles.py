"""Exact percentiles by counting passes against sorted lists."""

import random

import numpy as np

from logwarden.operators import aggregates as A


def test_values_at_any_place(spark):
    random.seed(4)
    data = [random.choice([random.random(), random.lognormvariate(0, 6), -random.lognormvariate(0, 9), 5.0, 5.0, 0.0]) for _ in range(500)] + [1e300, -1e300, 1e-300]
    df = spark.createDataFrame([(v,) for v in data], "v double").repartition(4)
    places = [0, 1, 100, 250, 251, 400, 501, 502]
    got = A.values_at(df, "v", places, buckets=7)
    assert got == {p: sorted(data)[p] for p in places}


def test_percentiles(spark):
    data = [3.0, None, 1.0, float("nan"), 10.0, 2.0]
    df = spark.createDataFrame([(v,) for v in data], "v double")
    want = np.quantile([1.0, 2.0, 3.0, 10.0], [0.0, 0.5, 0.95, 1.0])
    assert np.allclose(A.percentiles(df, "v", [0.0, 0.5, 0.95, 1.0]), want)
    assert A.percentiles(df.where("v > 1000 and not isnan(v)"), "v", [0.5]) == [None]
    assert A.latency_summary(df, "v").first().asDict() == {"mean": 4.0, "p50": 2.5, "p95": 8.95, "max": 10.0}
