"""Retrieval quality of a similarity ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Cut-offs and the metrics of the report.
K_VALUES = [1, 5, 10]
METRICS = ["precision", "recall", "hit", "mrr", "ndcg"]


def _ideal(total: Column, k: int) -> Column:
    """Discounted gain of a perfect ranking with ``min(total, k)`` hits."""
    best = F.lit(0.0)
    for i in range(1, k + 1):
        best = best + F.when(total >= i, 1.0 / F.log2(F.lit(i + 1.0))).otherwise(0.0)
    return best


def query_metrics(matches: DataFrame, labels: DataFrame, queries: DataFrame, k_values: list[int] | None = None,
                  id_col: str = "id", label: str = "label") -> DataFrame:
    """Metrics per query; queries whose label no other row has are left out.

    ``matches``: query_id, id, rank (the query itself excluded). ``labels``: all rows of the corpus.
    """
    k_values = sorted(set(k for k in (k_values or K_VALUES) if k > 0))
    sizes = labels.groupBy(F.col(label).alias("ql")).agg((F.count(F.lit(1)) - 1).alias("total_relevant"))
    q = queries.select(F.col(id_col).alias("query_id"), F.col(label).alias("ql")).join(sizes, "ql").where("total_relevant > 0")
    ranked = matches.join(labels.select(F.col(id_col).alias("id"), F.col(label).alias("ml")), "id")
    rel = q.join(ranked, "query_id", "left").withColumn("rel", F.coalesce((F.col("ml") == F.col("ql")).cast("int"), F.lit(0)))
    aggs = []
    for k in k_values:
        hit = (F.col("rank") <= k) & (F.col("rel") == 1)
        aggs += [
            F.count_if(hit).alias(f"_h{k}"),
            F.min(F.when(hit, F.col("rank"))).alias(f"_f{k}"),
            F.sum(F.when(hit, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"_d{k}"),
        ]
    per = rel.groupBy("query_id", F.col("ql").alias("label"), "total_relevant").agg(*aggs)
    out = ["query_id", "label", "total_relevant"]
    for k in k_values:
        out += [
            (F.col(f"_h{k}") / k).alias(f"precision_at_{k}"),
            (F.col(f"_h{k}") / F.col("total_relevant")).alias(f"recall_at_{k}"),
            F.when(F.col(f"_h{k}") > 0, 1.0).otherwise(0.0).alias(f"hit_at_{k}"),
            F.coalesce(1.0 / F.col(f"_f{k}"), F.lit(0.0)).alias(f"mrr_at_{k}"),
            (F.col(f"_d{k}") / _ideal(F.col("total_relevant"), k)).alias(f"ndcg_at_{k}"),
        ]
    return per.select(*out)


def summarize(metrics: DataFrame) -> DataFrame:
    """Mean of every metric, overall (``label`` = ``*``) and per label, rounded to 6 digits."""
    names = [c for c in metrics.columns if "_at_" in c]
    means = [F.round(F.avg(n), 6).alias(n) for n in names]
    # One pass: sums per label, of which the overall row is a roll-up.
    return metrics.rollup("label").agg(
        F.grouping("label").alias("_all"), F.count(F.lit(1)).alias("queries"), *means
    ).select(F.when(F.col("_all") == 1, "*").otherwise(F.col("label").cast("string")).alias("label"), "queries", *names)


def best_method(scores: DataFrame, metric: str, order: str = "position") -> DataFrame:
    """Method with the highest ``metric``; of equal ones the first in ``order``."""
    return scores.agg(F.max_by(F.struct("method", F.col(metric).alias("score")),
                               F.struct(F.col(metric), -F.col(order))).alias("b")).select(
        F.col("b.method").alias("method"), F.lit(metric).alias("metric"), F.round("b.score", 6).alias("score"))
