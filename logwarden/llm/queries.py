"""One query per operator, with production parameters over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logwarden.llm import (bitpack, decontaminate, divergence, duck_bpe, jaccard_join, language, mixing, permutation_index, quality, resampling,
                           toxicity, unigram_count, url_trust)
from logwarden.llm.tables import BYTE_BPE, BYTE_RANKS, ORACLES, PIECES, QUERIES, cut_pattern, register, table, vocabulary_path
from logwarden.session import new_work_path

__all__ = ["QUERIES", "ORACLES"]

VOCABULARY = 50_257


@register("op1_token_counts")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return unigram_count.count_tokens(table(spark, sf, "documents"), vocabulary_path(PIECES))


@register("op2_token_id_output")
def token_id_output(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_work_path(spark, "tokens")
    bitpack.write_shards(table(spark, sf, "documents"), folder, vocabulary_path(BYTE_BPE), VOCABULARY, end_id=0)
    return bitpack.read_digest(spark, folder)


@register("op9_toxicity")
def toxic_documents(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.digest(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op6_quality")
def document_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.digest(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op3_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf, "documents"))


@register("op7_decontamination")
def contaminated_documents(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op5_language_id")
def language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language.digest(table(spark, sf, "documents"))


@register("op10_permutation_index")
def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return permutation_index.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@register("op8_url_trust", url_trust.judge_sql())
def judged_pages(spark: SparkSession, sf: str) -> DataFrame:
    return url_trust.judge(table(spark, sf, "pages"))


@register("op4_mixing", mixing.mix_sql())
def mixed_documents(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "embeddings"))


@register("op11_duck_bpe")
def byte_level_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return duck_bpe.digest(table(spark, sf, "documents"), vocabulary_path(BYTE_RANKS), cut_pattern())


@register("op12_source_divergence", divergence.audit_sql())
def source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(table(spark, sf, "documents"))


@register("op13_importance_resampling", resampling.resample_sql())
def importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
