"""Held-out accuracy of the trained models, and their defined results on awkward input."""

import zlib

import numpy as np
import pytest

from logwarden.llm import language, quality, toxicity
from logwarden.llm.tables import table
from tests.llm.cases import awkward, documents, empty

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int, score double"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def joined(spark, rows, label):
    labels = {r.doc_id: r[label] for r in table(spark, SF, "labels").collect() if r[label] is not None}
    rows = rows.collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    return [(r, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]


def test_toxicity_held_out(spark):
    rows = joined(spark, toxicity.digest(table(spark, SF, "documents"), table(spark, SF, "labels")), "toxic")
    bad, good = [r for r, y in rows if y], [r for r, y in rows if not y]
    assert np.mean([r.predicted for r in bad]) >= 0.75 and np.mean([r.predicted for r in good]) <= 0.02
    assert all((r.n_offending > 0) == (r.predicted == 1) for r, _ in rows)


def test_toxic_sentences_are_located(spark):
    bad = "The weather is fine today. You are a perfect vexwort and all know it. Tomorrow it may rain."
    rows = [(i, bad if i % 3 == 0 else f"The weather of day {i} is fine today. Nobody minds. Tomorrow it may rain {i}.", "en", "a") for i in range(1, 200)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0), 0.1) for i, *_ in rows], LABELS)
    docs = documents(spark, rows)
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, text, *_ in rows:
        assert (got[i].score >= 0.5) == (i % 3 == 0)
        for s in got[i].sentences:
            assert "vexwort" in text.encode()[s.start:s.start + s.bytes].decode()
    assert {r.doc_id for r in toxicity.reject(docs, model).collect()} == {i for i, *_ in rows if i % 3}
    assert toxicity.reject(docs, model).schema == docs.schema
    odd = {(r.doc_id, r.score, r.n_sentences) for r in toxicity.score(awkward(spark), model).collect() if r.doc_id in (1, 2, 3, 11)}
    assert odd == {(1, 0.0, 0), (2, 0.0, 0), (3, 0.0, 0), (11, 0.0, 0)}
    assert toxicity.score(empty(spark), model).count() == 0 and toxicity.score(awkward(spark), model).count() == 13


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([(1, None, None, 0.0), (None, 1, 1, 0.0)], LABELS)
    rows = toxicity.digest(awkward(spark), none).collect()
    assert len(rows) == 13 and all(r.score == 0 and r.predicted == 0 for r in rows)
    assert toxicity.reject(awkward(spark), toxicity.learn(awkward(spark), none)).count() == 13


def test_quality_held_out(spark):
    rows = joined(spark, quality.digest(table(spark, SF, "documents"), table(spark, SF, "labels")), "quality")
    bad, good = [r for r, y in rows if not y], [r for r, y in rows if y]
    assert np.mean([r.predicted for r in good]) >= 0.99 and np.mean([r.predicted for r in bad]) <= 0.15


def test_quality_on_awkward_input(spark):
    labels = spark.createDataFrame([(i, i % 2, 0, 0.0) for i in (4, 5, 6, 7, 8, 9, 10, 11)] + [(4, 1, 1, 0.0), (None, 1, 1, 0.0), (99, 1, 0, 0.0)], LABELS)
    rows = quality.digest(awkward(spark), labels).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    same = {r.doc_id: r.score for r in rows}
    assert same[1] == same[2] and same[7] == same[8]
    assert {r.score for r in quality.digest(awkward(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.digest(empty(spark), labels).count() == 0
    good = quality.digest(awkward(spark), labels.where("quality = 1")).collect()
    assert all(r.score > 0.99 for r in good)


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.choice(20, 6)) for _ in range(80)]
    sign = np.array([1.0 if 3 in r else -1.0 for r in rows])
    scale = np.ones(20)
    weight = quality.descend(rows, scale, sign, 10.0, 200)
    margin = [weight[r].sum() / np.sqrt(len(r)) + weight[-1] for r in rows]
    assert (np.sign(margin) == sign).all() and np.argmax(weight[:-1]) == 3


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in language.digest(docs).collect() if r.held_out]
    assert np.mean([r.lang_pred == want[r.doc_id] for r in rows]) >= 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def brute_path(scores, switch):
    """The best labels by trying all paths."""
    from itertools import product

    worth = lambda p: sum(scores[i][k] for i, k in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:]))
    return max(map(worth, product(range(len(scores[0])), repeat=len(scores))))


@pytest.mark.parametrize("seed", range(8))
def test_viterbi_and_its_shortcut(seed):
    rng = np.random.default_rng(seed)
    scores = rng.normal(0, 3, (6, 3))
    path = language.viterbi(scores, 4.0)
    worth = sum(scores[i, k] for i, k in enumerate(path)) - 4.0 * sum(a != b for a, b in zip(path, path[1:]))
    assert abs(worth - brute_path(scores.tolist(), 4.0)) < 1e-9
    best = scores.sum(0).argmax()
    if language._one_span(scores, np.array([0, 6]), np.array([best]), 4.0)[0]:
        assert abs(worth - scores[:, best].sum()) < 1e-9


def test_mixed_text_has_spans(spark):
    english, german = "the house of the people and the children in that town ", "das haus der leute und die kinder in dieser stadt "
    rows = [(i, (english if i % 2 else german) * 3, "en" if i % 2 else "de", "a") for i in range(1, 60)]
    model = language.learn(documents(spark, rows))
    mixed = (english * 4 + german * 2).strip()
    got = language.label(documents(spark, [(1, mixed, None, None), (2, "42 !?", "en", "a"), (3, None, "en", "a")]), model).collect()
    assert [s.lang for s in got[0].spans] == ["en", "de"] and got[0].lang_pred == "en" and 0.5 < got[0].score < 0.8
    assert mixed[got[0].spans[1].start:].startswith(("das haus", "in that", "town", "haus"))
    assert [(r.lang_pred, r.score, len(r.spans)) for r in got[1:]] == [("und", 0.0, 0), ("und", 0.0, 0)]


def test_language_scripts_and_awkward_input(spark):
    rows = [(i, "това е изречение на български език", "bg", "a") if i % 2 else (i, "this is a sentence in english", "en", "a") for i in range(1, 40)]
    model = language.learn(documents(spark, rows))
    got = language.label(documents(spark, [(1, "изречение", None, None), (2, "sentence", None, None)]), model).collect()
    assert [r.lang_pred for r in got] == ["bg", "en"]
    rows = {r.doc_id: r for r in language.digest(awkward(spark)).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == rows[11].lang_pred == "und"
    assert language.digest(empty(spark)).count() == 0
    unlearned = language.digest(documents(spark, [(1, "some text", None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in unlearned] == [("und", 0.0)]
