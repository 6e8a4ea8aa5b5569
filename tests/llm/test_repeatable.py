"""Models don't depend on the order of rows; short cuts equal what they stand for."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from logwarden.llm import bitpack, labelled, language, quality, toxicity
from logwarden.llm.tables import BYTE_BPE, table, vocabulary_path
from tests.llm.cases import documents

SF = "/root/testdata/sf0.001"


def test_models_in_any_order_of_rows(spark):
    docs = table(spark, SF, "documents").toPandas()
    rows = pa.table({"doc_id": docs.doc_id, "text": docs.text, "label": (docs.doc_id % 3 == 0).astype("int32")})
    rows = pa.concat_tables([rows, rows.slice(5, 3)])
    for fit in (quality.fit, toxicity.fit):
        models = {labelled._fitted(fit, rows.take(np.random.default_rng(i).permutation(len(rows)))).column("model")[0].as_py() for i in range(3)}
        assert len(models) == 1


def test_sample_with_repeated_ids(spark):
    rows = [(7, f"text {i}", "en", "a") for i in range(20)] + [(8, "other", "en", "a")]
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int")
    taken = [sorted(map(tuple, labelled.labelled_sample(documents(spark, rows).repartition(n), labels, "toxic", 2).collect())) for n in (1, 4, 7)]
    assert taken[0] == taken[1] == taken[2]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10_000))
def test_one_span_is_what_viterbi_says(seed):
    """Random score matrices with planted spans of close languages."""
    draw = np.random.default_rng(seed)
    lengths, scores = draw.integers(1, 14, 8), []
    for n in lengths:
        own = draw.normal(-20, 3, (n, 3))
        cut = draw.integers(0, n + 1)
        own[:cut, draw.integers(3)] += draw.uniform(0, 6)
        own[cut:, draw.integers(3)] += draw.uniform(0, 6)
        scores.append(own)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    best = np.array([s.sum(0).argmax() for s in scores])
    single = language._one_span(np.concatenate(scores), bounds, best, 12.0)
    for d in np.flatnonzero(single):
        assert set(language.viterbi(scores[d], 12.0)) == {best[d]}


def test_two_spans_of_close_languages():
    scores = np.array([[-20.0, -35, -22]] * 5 + [[-35.0, -20, -22]] * 5)
    assert not language._one_span(scores, np.array([0, 10]), np.array([2]), 12.0)[0]
    assert language.viterbi(scores, 12.0) == [0] * 5 + [1] * 5


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab 't\n\t .é日1\x1c　", max_size=40), min_size=1, max_size=6), st.lists(st.text(alphabet="ab  \n", max_size=9), min_size=1, max_size=3))
def test_pieces_coded_by_arrow(texts, more):
    coder = bitpack.encoder(vocabulary_path(BYTE_BPE), 0)
    for own in (texts, more, [*more, *texts]):
        ids, sizes = coder.encode(own)
        want = [e.ids + [0] for e in coder.tokenizer.encode_batch(own, add_special_tokens=False)]
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]


def test_shards_as_asked(spark):
    from logwarden.session import new_work_path

    folder = new_work_path(spark, "shards")
    docs = table(spark, SF, "documents")
    assert bitpack.write_shards(docs, folder, vocabulary_path(BYTE_BPE), 50_257, shards=13).count() == 13
    whole = Tokenizer.from_file(vocabulary_path(BYTE_BPE))
    first = docs.orderBy("doc_id").first()
    assert bitpack.read_digest(spark, folder).orderBy("doc_id").first().n_tokens == len(whole.encode(first.text, add_special_tokens=False).ids) + 1
