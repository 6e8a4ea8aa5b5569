"""Operator 3 moves a like number of bytes for each token, into however many buckets, and counts copies in several lots once."""

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from logwarden.llm import jaccard_join as J
from tests.llm.test_similarity import shingles

NONE = np.array([], np.uint64)


def texts(seed=4):
    """Texts with near copies, and a copy of every fifth in another batch; none shares a set otherwise."""
    rng, rows = random.Random(seed), []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 40, 400]))]
        rows += [" ".join(words), " ".join(words[:-1] + ["end"])] if i % 2 else [" ".join(words)]
    return [rows, rows[::5]]


def dealt(lots, n_buckets, bits):
    batches = [pa.RecordBatch.from_arrays([pa.array(lot)], ["text"]) for lot in lots]
    out = [b for batch in batches for b in J._deal(5, n_buckets, SimpleNamespace(value=NONE), SimpleNamespace(value=bits), iter([batch]))]
    return pa.Table.from_batches(out)


def gathered(rows, n_buckets):
    by = lambda t, key: [t.filter(pa.compute.equal(t.column(key), k)) for k in t.column(key).unique()]
    answers = pa.concat_tables([J._count(n_buckets, group) for group in by(rows, "bucket")])
    return {r["node"]: (r["n"], r["need"], r["n_rare"], sorted(r["tokens"])) for group in by(answers, "part") for r in J._gather(80, group).to_pylist()}


def filtered(lots):
    """A filter of the sets that several texts have, and those sets."""
    seen = Counter(int(node) for lot in lots for *_, rows in J._taken(iter([pa.RecordBatch.from_arrays([pa.array(lot)], ["text"])]), 5)
                   for _, _, names, _ in rows for node in names)
    bits = np.zeros(64, np.uint64)
    for node in (k for k, count in seen.items() if count > 1):
        for at in (node & 4095, node >> 30 & 4095):
            bits[at >> 6] |= np.uint64(1 << (at & 63))
    return bits


def test_bytes_of_a_token_do_not_follow_the_number_of_buckets():
    lots = texts()
    tokens = sum(len(shingles(t)) for lot in lots for t in lot)
    each = [sum(dealt(lots[:1], n, np.zeros(1, np.uint64)).column(c).nbytes for c in ("owners", "nodes", "tokens")) / tokens for n in (1, 64)]
    assert each[1] < each[0] + 1 < 8


@pytest.mark.parametrize("n_buckets", [1, 7, 300])
def test_copies_in_several_lots_count_once(n_buckets):
    lots = texts()
    sharp, all_named = filtered(lots), np.full(1, 2**64 - 1, np.uint64)
    got = gathered(dealt(lots, n_buckets, sharp), n_buckets)
    assert got == gathered(dealt(lots, n_buckets, all_named), n_buckets)
    sets = {frozenset(shingles(t)) for lot in lots for t in lot}
    of_token = Counter(t for s in sets for t in s)
    want = sorted((len(s), sum(of_token[t] > 1 for t in s)) for s in sets if len(s) > 1)
    alive = [(n, k) for n, k in want if n - -(-n * 80 // 100) + 1 - (n - k) > 0]
    assert sorted((n, n_rare) for n, _, n_rare, _ in got.values()) == alive and len(alive) > 20


def test_answers_of_an_unknown_lot_are_an_error():
    rows = dealt([["a b c d e f g h", "b c d e f g h i"]], 1, np.zeros(1, np.uint64))
    answers = J._count(1, rows)
    with pytest.raises(ValueError):
        J._gather(80, answers.filter(pa.compute.is_null(answers.column("sizes"))))


def test_steps_of_any_length():
    places, cuts = np.array([0, 0, 254, 255, 256, 1000, 3, 3, 70_000]), np.array([0, 2, 6, 9])
    got, row = J._places(pa.chunked_array([J._steps(places, cuts)]))
    assert got.tolist() == places.tolist() and row.tolist() == [0, 0, 1, 1, 1, 1, 2, 2, 2]


def test_filter_holds_every_repeated_set(spark):
    nodes = [(int(x), 1) for x in np.random.default_rng(2).integers(-2**63, 2**63, 300)]
    rows = spark.createDataFrame(nodes + nodes[:100] + [(0, 0), (0, 0)], "node long, n int")
    bits = J._filter(rows, 402)
    hit = J._maybe(bits, np.array([n for n, _ in nodes], np.int64).view(np.uint64))
    assert hit[:100].all() and hit[100:].mean() < 0.2
