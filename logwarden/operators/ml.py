"""Two-stage attack classifier: is it an attack, and of which type."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logwarden.operators.features import numeric_matrix
from logwarden.schema import FEATURE_VERSION

MAX_ITERATIONS = 1000
THRESHOLD = 0.5


def balanced_weights(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Row weight ``n / (classes * class size)``."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    stats = sizes.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return df.join(sizes, label).withColumn(weight, F.lit(float(stats["n"] or 0) / max(1, stats["k"])) / F.col("_n")).drop("_n")


def _stages(columns: list[str], label: str, rows: int, family: str) -> list:
    return [
        VectorAssembler(inputCols=columns, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_features", labelCol=label, weightCol="weight", family=family,
                           maxIter=MAX_ITERATIONS, regParam=1.0 / max(1, rows), standardization=False,
                           probabilityCol="_probability", rawPredictionCol="_margin", predictionCol="_prediction"),
    ]


def fit_binary(df: DataFrame, columns: list[str], label: str = "binary_target") -> PipelineModel:
    """L2 logistic model with balanced class weights on standardised features."""
    rows = balanced_weights(numeric_matrix(df, columns).withColumn("_y", F.col(label).cast("double")), "_y")
    return Pipeline(stages=_stages(columns, "_y", df.count(), "binomial")).fit(rows)


def fit_attack_type(df: DataFrame, columns: list[str], label: str = "attack_type_target",
                    binary: str = "binary_target") -> PipelineModel | str:
    """Multinomial model on attack rows; with fewer than two types the most frequent type."""
    attacks = df.where(F.col(binary) > 0)
    kinds = attacks.groupBy(label).count().orderBy(F.desc("count"), label).limit(2).collect()
    if len(kinds) < 2:
        source = kinds or df.groupBy(label).count().orderBy(F.desc("count"), label).limit(1).collect()
        return source[0][label] if source else "unknown"
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(attacks)
    rows = balanced_weights(indexer.transform(numeric_matrix(attacks, columns)), "_y")
    stages = _stages(columns, "_y", attacks.count(), "multinomial")
    back = IndexToString(inputCol="_prediction", outputCol="_type", labels=indexer.labels)
    return Pipeline(stages=[*stages, back]).fit(rows)


def predict(df: DataFrame, binary: PipelineModel, attack_type: PipelineModel | str, columns: list[str],
            threshold: float = THRESHOLD) -> DataFrame:
    """Adds the seven ``ml_*`` columns; the type counts only for rows called an attack."""
    base = numeric_matrix(df, columns)
    inner = ["_raw", "_features", "_probability", "_margin", "_prediction"]
    scored = binary.transform(base).withColumn("_attack", vector_to_array("_probability")[1]).drop(*inner)
    is_attack = F.col("_attack") >= threshold
    if isinstance(attack_type, str):
        typed = scored.withColumns({"_type": F.lit(attack_type), "_confidence": F.lit(1.0)})
    else:
        typed = attack_type.transform(scored).withColumn(
            "_confidence", F.array_max(vector_to_array("_probability"))).drop(*inner)
    out = {
        "ml_label": F.when(is_attack, "attack").otherwise("benign"),
        "ml_confidence": F.round(F.when(is_attack, F.col("_attack")).otherwise(1 - F.col("_attack")), 6),
        "ml_attack_type": F.when(is_attack, F.col("_type")).otherwise("unknown"),
        "ml_attack_type_confidence": F.round(F.when(is_attack, F.col("_confidence")).otherwise(0.0), 6),
        "ml_normal_probability": F.round(1 - F.col("_attack"), 6),
        "ml_attack_probability": F.round(F.col("_attack"), 6),
        "ml_should_alert": is_attack,
    }
    return typed.select(*[c for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def binary_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of 0/1 columns; a zero denominator gives 0."""
    t, p = F.col(truth) > 0, F.col(predicted) > 0
    c = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
               F.count_if(t & ~p).alias("fn"), F.count_if(t).alias("pos"))
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(
        F.round(_ratio(F.col("n") - F.col("fp") - F.col("fn"), F.col("n")), 6).alias("accuracy"),
        F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"),
        F.round(_ratio(2 * precision * recall, precision + recall), 6).alias("f1"),
        F.col("n").alias("test_samples"), F.col("pos").alias("positive_samples"))


def weighted_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 over classes."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("t").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("right")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called"),
                 F.lit(0).cast("bigint").alias("right")))).alias("x")).select("x.*")
    per = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "called", "right")])
    precision, recall = _ratio(F.col("right"), F.col("called")), _ratio(F.col("right"), F.col("support"))
    per = per.withColumns({"pr": precision, "re": recall}).withColumn(
        "f1", _ratio(2 * F.col("pr") * F.col("re"), F.col("pr") + F.col("re")))
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return F.round(F.coalesce(F.sum(F.col(c) * F.col("support")) / total, F.lit(0.0)), 6)

    return per.agg(
        F.round(F.coalesce(F.sum("right") / total, F.lit(0.0)), 6).alias("accuracy"),
        weighted("pr").alias("precision_weighted"), weighted("re").alias("recall_weighted"),
        weighted("f1").alias("f1_weighted"), total.alias("test_samples"))


def save_models(spark: SparkSession, folder: str, binary: PipelineModel, attack_type: PipelineModel | str,
                columns: list[str], metrics: dict) -> None:
    """Both models and their metadata below ``folder``."""
    binary.write().overwrite().save(f"{folder}/binary_model")
    constant = attack_type if isinstance(attack_type, str) else None
    if constant is None:
        attack_type.write().overwrite().save(f"{folder}/attack_type_model")
    meta = json.dumps({"feature_extractor_version": FEATURE_VERSION, "feature_columns": columns,
                       "constant_attack_type": constant, "metrics": metrics})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")


def load_models(spark: SparkSession, folder: str) -> tuple[PipelineModel, PipelineModel | str, dict]:
    meta = json.loads(spark.read.text(f"{folder}/metadata").first()["value"])
    binary = PipelineModel.load(f"{folder}/binary_model")
    kind = meta["constant_attack_type"]
    return binary, kind if kind is not None else PipelineModel.load(f"{folder}/attack_type_model"), meta
