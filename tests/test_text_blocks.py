"""Entropies and tf-idf weights counted in arrays equal their SQL twins on awkward rows too, and move no terms."""

import random

import pytest
from pyspark.sql import functions as F

from logwarden.catalog import ORACLES, QUERIES
from logwarden.operators import text_blocks as T
from tests.oracle import difference, duck
from tests.test_large_tables import plan

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TEXT_QUERIES = ["V4_char_tfidf", "V7_hybrid_vectors", "V5_word_tfidf", "V2_text_to_similar_documents"]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Empty, missing and repeated texts and ids, one character only, odd white space and characters of one to four bytes."""
    rng = random.Random(4)
    words = ["a", "aa", "the", "naïve", "Straße", "слово", "語", "😀😀", "x|y", "||", "é", "long" * 30]
    texts = [(i, "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t ", "\x0b", " ", "\r\n", "\f"]) for _ in range(rng.randint(1, 60)))) for i in range(3, 80)]
    texts += [(3, "the same id again the"), (3, "a"), (None, "the lost one"), (None, "x|y"), (90, None), (91, ""), (92, "   \n"), (93, "zzzz"), (94, "."), (95, None), (95, "a a"),
              (96, "a b" * 32), (None, None)]
    folder = tmp_path_factory.mktemp("awkward")
    rows = [(i, t, "en", rng.choice(["web", "books"]), len(t or "")) for i, t in texts]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/out")
    next((folder / "out").glob("*.parquet")).rename(folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["F4_document_entropy", *TEXT_QUERIES])
def test_equals_sql_on_awkward_rows(spark, awkward, name):
    want = duck(awkward).execute(ORACLES[name]).fetchdf()
    assert len(want) >= 10 and difference(QUERIES[name](spark, awkward).toPandas(), want) is None


@pytest.mark.parametrize("name", TEXT_QUERIES)
def test_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", TEXT_QUERIES[:3])
def test_terms_are_not_rows(spark, awkward, name):
    planned = plan(QUERIES[name](spark, awkward))
    # The texts go to their parts, frequencies to their buckets and to the parts; no rows of terms are made, joined or ranked.
    assert not any(step in planned for step in ("Generate", "Join", "Window"))


@pytest.mark.parametrize("parts", [1, 8, 211])
def test_parts_have_partitions_of_their_own(spark, parts):
    numbers = T._part_numbers(parts)
    rows = spark.createDataFrame([(n,) for n in numbers], "part int").repartition(parts, "part").select("part", F.spark_partition_id().alias("at"))
    assert [r.part for r in rows.orderBy("at").collect()] == numbers and rows.select("at").distinct().count() == parts


def test_texts_are_shuffled_once(spark, awkward):
    df = QUERIES["V4_char_tfidf"](spark, awkward)
    df.collect()
    assert str(df._jdf.queryExecution().executedPlan()).split("Initial Plan")[0].count("ReusedExchange") == 1


def test_blocks_of_few_terms(spark, awkward, monkeypatch):
    d = spark.read.parquet(f"{awkward}/documents.parquet").where("doc_id is not null").toArrow().combine_chunks()
    columns = d["doc_id"].combine_chunks(), d["text"].combine_chunks()
    whole = [tuple(x) for b in T._Part(*columns, "char_tfidf").blocks() for x in zip(*b)]
    monkeypatch.setattr(T, "BLOCK_TERMS", 100)
    blocks = list(T._Part(*columns, "char_tfidf").blocks())
    assert len(blocks) > 20 and [tuple(x) for b in blocks for x in zip(*b)] == whole


def test_several_queries(spark):
    df = spark.createDataFrame([(str(i), " ".join(f"w{(i * k) % 7}" for k in range(1, 9))) for i in range(40)], "id string, t string")
    found = T.similar_documents(df, "id", F.col("t"), ["3", "17", "absent"], 4)
    from logwarden.operators import vectors as V
    model = V.text_model(df, "id", F.col("t"), "word_tfidf")
    want = V.sparse_scores(model.where("doc in ('3', '17')"), model, 4)
    rows = [sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in x.collect()) for x in (found, want)]
    assert rows[0] == rows[1] and len(rows[0]) == 8
