"""Jaccard join, components, decontamination and the permutation index against brute force."""

import random
import re

import numpy as np
import pytest

from logwarden.llm import components, decontaminate, jaccard_join, permutation_index
from logwarden.llm.tables import table
from tests.llm.cases import DOCUMENTS, awkward, documents, empty

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n=5):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[k:k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def brute_components(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for k, (i, _) in enumerate(sets):
        groups.setdefault(root(k), []).append(i)
    least = {r: min((i for i in own if i is not None), default=None) for r, own in groups.items()}
    return sorted(((i, len(s), least[root(k)]) for k, (i, s) in enumerate(sets)), key=str)


def joined(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.components(docs).collect()), key=str)


def edited(seed, groups=12, each=14):
    """Groups of edited copies, from nearly equal to just too different, over few words that repeat."""
    rng, rows = random.Random(seed), []
    passage = [f"shared{k}" for k in range(60)]
    for g in range(groups):
        size = rng.choice([3, 5, 8, 20, 60, 150])
        base = [f"w{rng.randrange(40 if g % 3 == 0 else 5000)}" for _ in range(size)]
        if g % 2:
            at = rng.randrange(len(base))
            base[at:at] = passage
        for _ in range(each):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(copy) // 30 + 2))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10)}"
            rows.append((len(rows) + 1, " ".join(copy)))
    return rows


@pytest.mark.parametrize("often", [jaccard_join.OFTEN, 4])
def test_components_of_edited_copies(spark, monkeypatch, often):
    # With a bound that low most shared tokens are frequent: pair keys decide.
    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 10**6)
    rows = edited(3)
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    assert joined(docs) == brute_components(rows)


def test_components_of_awkward_texts(spark):
    docs = awkward(spark)
    assert joined(docs) == brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert joined(empty(spark)) == []


def test_components_of_the_table(spark):
    docs = table(spark, SF, "documents")
    assert joined(docs) == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_links_are_found_once_a_round(spark, monkeypatch):
    """The stars read their edges several times; each time the pairs of a round were formed and compared anew."""
    seen, stars = [], jaccard_join.stars
    monkeypatch.setattr(jaccard_join, "stars", lambda edges: seen.append(edges._jdf.queryExecution().optimizedPlan().toString()) or stars(edges))
    rows = edited(5, groups=4)
    assert joined(documents(spark, [(i, t, "en", "a") for i, t in rows])) == brute_components(rows)
    assert seen and not any("Join" in plan for plan in seen)


@pytest.mark.parametrize("rounds", [(2, 8), (1, 1)])
def test_groups_of_unlike_sets_with_a_common_passage(spark, monkeypatch, rounds):
    """Groups that the first links don't make one part of go through all rounds, however slowly pivots grow."""
    monkeypatch.setattr(jaccard_join, "PIVOTS", rounds[0])
    monkeypatch.setattr(jaccard_join, "GROWTH", rounds[1])
    rng, passage = random.Random(8), " ".join(f"p{k}" for k in range(12))
    rows = [(i + 1, passage + " " + " ".join(f"a{i // 2 if i % 3 else i}b{k}" for k in range(20)) + f" z{rng.randrange(3)}") for i in range(12)]
    assert joined(documents(spark, [(i, t, "en", "a") for i, t in rows])) == brute_components(rows)


def test_bound_of_full_bins(spark):
    full = jaccard_join.FULL
    rows = [([1, 2, 3], [2, 2, 0]), ([full, 2, 3], [5, 1, full]), ([full, 1, 4], [full, 9, 4])]
    got = spark.createDataFrame(rows, "a array<tinyint>, b array<tinyint>").select(jaccard_join._bound("a", "b").alias("x")).collect()
    assert [r.x for r in got] == [3, 5 + 1 + 3, (1 << 40) + 5]


def test_pair_keys_cover_the_differences():
    """Sets that differ in few enough frequent tokens always share a key, whichever differ."""
    rng = np.random.default_rng(1)
    for n in (4, 5, 9, 20, 47, 64, 130):
        for _ in range(30):
            x = np.sort(rng.choice(10 * n, n, replace=False))
            lost = rng.integers(0, n // 5 + 1)
            y = np.delete(x, rng.choice(n, lost, replace=False))
            if 100 * len(y) < 80 * n:
                continue
            one = jaccard_join.pair_keys(x, n - -(-n * 80 // 100) + 1, n, 80)
            two = jaccard_join.pair_keys(y, len(y) - -(-len(y) * 80 // 100) + 1, len(y), 80)
            assert set(one.tolist()) & set(two.tolist()), (n, lost)


def test_deduplicate_keeps_one_of_each(spark):
    docs = awkward(spark)
    kept = jaccard_join.deduplicate(docs)
    assert kept.schema == docs.schema
    assert sorted(((r.doc_id, r.score, r.tie) for r in kept.collect()), key=str) == sorted(
        [(i, 9.5, 7) for i in (1, 2, 3, 4, 5, 6, 7, None, 10, 11)], key=str)
    assert jaccard_join.deduplicate(empty(spark)).count() == 0


def test_stars_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.u: r.v for r in components.stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}, 201: 200}
    assert components.stars(spark.createDataFrame([], "u long, v long")).count() == 0


BENCH = "item_id long, text string, doc_id int, score string"


def test_leaks_are_found_with_edits(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(30)] for _ in range(6)]
    rows = []
    for k, item in enumerate(items):
        copy = list(item)
        for at in range(2, 30, 7):
            copy[at] = word()
        del copy[11]
        copy.insert(20, word())
        rows += [(10 * k, " ".join(word() for _ in range(50)), "en", "a"),
                 (10 * k + 1, " ".join([*(word() for _ in range(20)), *item, word()]).upper() + "!", "en", "a"),
                 (10 * k + 2, " ".join([word(), *copy, word()]), "en", "a")]
    docs = documents(spark, rows)
    bench = spark.createDataFrame([(k, " ".join(i), 1, "x") for k, i in enumerate(items)] + [(8, "", 1, "x"), (9, None, 1, "x"), (None, "a b c", 1, "x")], BENCH)
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(10 * k + j, k) for k in range(6) for j in (1, 2)}
    texts = {i: t for i, t, _, _ in rows}
    for r in got:
        if r.doc_id % 10 == 1:
            assert r.score == 1 and texts[r.doc_id].encode()[r.start_byte:r.start_byte + r.n_bytes].decode().lower() == " ".join(items[r.item_id])
    left = decontaminate.decontaminate(docs, bench)
    assert left.schema == docs.schema and sorted(r.doc_id for r in left.collect()) == [10 * k for k in range(6)]


def test_leaks_of_the_table_equal_substring_search(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    whole = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if b.text in d.text}
    assert whole <= got and len(got - whole) <= max(2, len(whole) // 10)


def test_leaks_of_awkward_tables(spark):
    bench = spark.createDataFrame([(1, "the same text here as there", 1, "x"), (2, "the same text here as there", 1, "x"), (3, "twice the", 1, "x")], BENCH)
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.contaminated(awkward(spark), bench).collect()))
    assert got == [(7, 1), (7, 2), (8, 1), (8, 2), (9, 1), (9, 2)] or {(10, 3)} <= set(got)
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(awkward(spark), bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(awkward(spark), bench.limit(0)).count() == 13


def test_alignment():
    a = np.array([1, 2, 3, 4, 5])
    assert decontaminate.align(a, np.array([9, 1, 2, 3, 4, 5, 9])) == (5.0, 6)
    assert decontaminate.align(a, np.array([1, 2, 9, 4, 5]))[0] == 3.5
    assert decontaminate.align(a, np.array([7, 8]))[0] == 0.0


def cosine(x, y):
    return float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)))


def test_recall_on_the_table(spark):
    vectors = table(spark, SF, "embeddings")
    rows = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    got = permutation_index.nearest(vectors, vectors.where("vec_id % 50 = 0")).collect()
    hit = n = 0
    for q in sorted(i for i in rows if i % 50 == 0):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - cosine(rows[q], rows[r.vec_id])) < 1e-12 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        best = sorted((-cosine(rows[q], v), i) for i, v in rows.items() if i != q)[:5]
        hit, n = hit + len({i for _, i in best} & {r.vec_id for r in own}), n + 5
    assert hit / n >= 0.9


def test_awkward_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int, seen string, file int"
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [None, 1.0]),
            (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (50, [-1.0, 0.0]), (100, None)]
    vectors = spark.createDataFrame([(i, v, 0, "s", 1) for i, v in rows], kind)
    got = permutation_index.nearest(vectors, vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0), (0, 4, 50, -1.0),
        (50, 1, 3, 0.0), (50, 2, 0, -1.0), (50, 3, 1, -1.0), (50, 4, 2, -1.0)]
    assert permutation_index.nearest(vectors.limit(0), vectors).count() == 0


def test_copies_are_ranked_by_id(spark):
    rng = np.random.default_rng(2)
    copy = [float(x) for x in rng.normal(size=16)]
    rows = [(i, copy if i % 3 == 0 else [float(x) for x in rng.normal(size=16)]) for i in range(3_000)]
    vectors = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "vec_id long, embedding array<double>")
    got = permutation_index.nearest(vectors, vectors.where("vec_id in (0, 1500, 2997)")).collect()
    same = [i for i, v in rows if v == copy]
    for q in (0, 1500, 2997):
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [i for i in same if i != q][:5]


def test_split_files_find_the_same(spark, monkeypatch):
    vectors = table(spark, SF, "embeddings")
    ask = vectors.where("vec_id % 50 = 0")
    # The files of this table hold fewer vectors than are compared exactly at least, so parts find the same.
    want = sorted(map(tuple, permutation_index.nearest(vectors, ask).collect()))
    monkeypatch.setattr(permutation_index, "HOLD", 7)
    assert sorted(map(tuple, permutation_index.nearest(vectors, ask).collect())) == want


def test_documents_schema_is_what_it_says():
    assert "tie" in DOCUMENTS and "node" in DOCUMENTS
