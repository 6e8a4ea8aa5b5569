"""Decontamination against aligning every item with every document."""

import numpy as np
import pyarrow as pa
import pytest

from logwarden.llm import decontaminate as D
from logwarden.llm.hashing import IS_SIGN, WORD_VALUE, buffers, words
from logwarden.llm.tables import table
from tests.llm.cases import documents

SF = "/root/testdata/sf0.001"


def cut(texts):
    hashes, _, bounds = words(*buffers(pa.array(texts, pa.string())), IS_SIGN, WORD_VALUE)
    return [hashes[a:b] for a, b in zip(bounds, bounds[1:])]


def three_alike(item, text):
    """Whether three words in a row of the item stand in the text."""
    grams = {tuple(item[k:k + 3]) for k in range(len(item) - 2)}
    return any(tuple(text[k:k + 3]) in grams for k in range(len(text) - 2))


def brute(items, texts):
    """(doc, item) -> score of every pair that an alignment accepts and that has a seed in common."""
    out = {}
    for i, item in items:
        for d, text in texts:
            score = D.align(item, text)[0]
            if score >= 0.5 * len(item) and three_alike(item.tolist(), text.tolist()):
                out[d, i] = round(score / len(item), 6)
    return out


def numbered(rows):
    return list(zip([r[0] for r in rows], cut([r[1] for r in rows])))


def test_every_pair_is_what_alignment_says(spark):
    """All items against all documents, and against copies of them with up to four words in ten changed."""
    bench = table(spark, SF, "benchmark")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    draw = np.random.default_rng(4)
    for k in range(60):
        own = items[k % len(items)][1].split()
        rows.append((100_000 + k, " ".join(w if draw.random() > 0.1 * (k % 5) else "anders" for w in own) + " and more"))
    got = {(r.doc_id, r.item_id): r.score for r in D.contaminated(documents(spark, [(i, t, "en", "a") for i, t in rows]), bench).collect()}
    assert got == brute(numbered(items), numbered(rows)) and len(got) > 40


@pytest.mark.parametrize("copies", [5, 5000])
def test_edited_copies_are_found_however_often_they_leak(spark, copies):
    draw = np.random.default_rng(6)
    vocabulary = [f"wort{k}" for k in range(4000)]
    item = [vocabulary[k] for k in draw.integers(0, 4000, 15)]
    rows = []
    for d in range(copies):
        edited = [w if draw.random() > 0.25 else "other" for w in item]
        rows.append((d, " ".join([vocabulary[k] for k in draw.integers(0, 4000, 20)] + edited + ["end"])))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in D.contaminated(documents(spark, [(i, t, "en", "a") for i, t in rows]), bench).collect()}
    assert got == brute([(1, cut([" ".join(item)])[0])], numbered(rows)) and len(got) > 0.5 * copies


def test_short_and_repetitive_items(spark):
    bench = spark.createDataFrame([(1, "purple walrus"), (2, "ha ha ha ha ha ha"), (3, "zebra"), (4, "of the"), (5, " ?! ")], "item_id long, text string")
    docs = documents(spark, [(1, "the Purple, walrus sat", "en", "a"), (2, "so ha ha ha ha ha ha it went", "en", "a"), (3, "a zebra", "en", "a"),
                             (4, "purple is no walrus", "en", "a"), (5, "ha ha", "en", "a"), (6, "the of", "en", "a")])
    got = {(r.doc_id, r.item_id, r.score, r.start_word) for r in D.contaminated(docs, bench).collect()}
    assert got == {(1, 1, 1.0, 1), (2, 2, 1.0, 1), (3, 3, 1.0, 1)}
    assert sorted(r.doc_id for r in D.decontaminate(docs, bench).collect()) == [4, 5, 6]
