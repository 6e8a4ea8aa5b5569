"""Source divergence and importance resampling against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from logwarden.llm import divergence, ordering, resampling, terms
from logwarden.llm.hashing import buffers
from logwarden.llm.tables import table
from tests.llm.cases import awkward, documents, empty

import pyarrow as pa

SF = "/root/testdata/sf0.001"
LETTERS, WORDS = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZé日0 9.\n-Ä", max_size=30)), max_size=6))
def test_words_and_runs(texts):
    data, offsets = buffers(pa.array(texts, pa.string()))
    for gap, pattern in ((terms.LETTERS, LETTERS), (terms.LETTERS_DIGITS, WORDS)):
        words, bounds = terms.cut_words(data, offsets, gap)
        want = [pattern.findall((t or "").translate(LOWER)) for t in texts]
        assert words.to_pylist() == [w for own in want for w in own] and np.diff(bounds).tolist() == [len(own) for own in want]
        got, docs = terms.runs(words, bounds, 3)
        grams = [(i, " ".join(own[k:k + n])) for i, own in enumerate(want) for n in (1, 2, 3) for k in range(len(own) - n + 1)]
        assert sorted(zip(docs.tolist(), got.to_pylist())) == sorted(grams)


def test_numbers(spark):
    rows = spark.createDataFrame([(g, v) for g in "abc" for v in range(0, 700, 1 + ord(g) % 3)], "g string, v int").repartition(5)
    got = ordering.numbered(rows, ["v"], ["g"], "place").collect()
    by_group = collections.defaultdict(list)
    for r in got:
        by_group[r.g].append((r.v, r.place))
    for pairs in by_group.values():
        assert [p for _, p in sorted(pairs)] == list(range(len(pairs)))
    assert sorted(r.place for r in ordering.numbered(rows, ["v", "g"], [], "place").collect()) == list(range(rows.count()))


def audit(rows, least, top=50):
    counts, docs, groups, total = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set(), collections.defaultdict(collections.Counter)
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        groups.add((lang, source))
        found = LETTERS.findall((r.text or "").translate(LOWER))
        counts[lang, source].update(found)
        total[lang].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]

        def share(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept))

        own = {t: share(counts[lang, source], t) for t in kept}
        pairs = [(s, sum(abs(own[t] - share(counts[lang, s], t)) for t in kept)) for la, s in groups if la == lang and s != source]
        marks = [(t, own[t] - share(total[lang], t)) for t in kept if counts[lang, source][t]]
        for part, found in (("pair", pairs), ("term", [m for m in marks if m[1] > 0])):
            ranked = sorted(found, key=lambda m: (-m[1], m[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("block", [7, divergence.BLOCK])
def test_audit_equals_plain(spark, block, monkeypatch):
    draw = np.random.default_rng(1)
    texts = [" ".join(f"t{chr(97 + int(v) % 26)}{'x' * (int(v) // 26)}" for v in draw.zipf(1.5, 40) if v < 900) for _ in range(120)]
    rows = [(i, t, "en" if i % 3 else None, "hot" if i % 2 else f"s{i % 7}") for i, t in enumerate(texts)] + [(500, None, "en", "silent"), (501, "", "fr", None)]
    docs = documents(spark, rows + rows[:5])
    assert rows_of(divergence.audit(docs, least=3, block=block)) == audit(docs.collect(), 3)


def test_audit_in_tiles(spark, monkeypatch):
    """Many sources: columns of different tiles meet too. In one process, as workers don't see the smaller tile."""
    monkeypatch.setattr(divergence, "TILE", 3)
    draw = np.random.default_rng(2)
    size, n = 23, 8
    counts = draw.integers(0, 3, (n, size))
    shares = 1 + 1000 * (counts + 5)
    sums = {}
    for left in range(3):
        for right in range(left, 3):
            rows = []
            for no in range(n):
                if no // 3 not in (left, right):
                    continue
                rows.append((no, 5, -1, size, 1 + 1000 * 5))
                rows += [(no, 0, 5 + k, 1, int(shares[no, k])) for k in range(size) if counts[no, k]]
            if not rows:
                continue
            parts = pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(("no", "first", "start", "length", "p"))})
            for r in divergence._compare((pa.scalar("en"), pa.scalar(0), pa.scalar(left), pa.scalar(right)), parts).to_pylist():
                assert (r["a"], r["b"]) not in sums
                sums[r["a"], r["b"]] = r["value"]
    assert sums == {(a, b): int(abs(shares[a] - shares[b]).sum()) for a in range(n) for b in range(a + 1, n)}


def test_audit_of_awkward_and_empty(spark):
    assert rows_of(divergence.audit(awkward(spark), least=1)) == audit(awkward(spark).collect(), 1)
    assert rows_of(divergence.audit(awkward(spark))) == audit(awkward(spark).collect(), 30)  # no term is kept
    assert divergence.audit(empty(spark)).count() == 0


def test_runs_of_equal_counts(spark):
    """Clustered counts make few runs: 300 terms, half of them once and half twice in each source."""
    text = " ".join("w" + chr(97 + i // 26) + chr(97 + i % 26) + (" w" + chr(97 + i // 26) + chr(97 + i % 26) if i % 2 else "") for i in range(300))
    docs = documents(spark, [(i, text, "en", f"s{i}") for i in range(4)])
    cells = divergence.term_counts(docs)
    groups = docs.groupBy("lang", "source").count().withColumnRenamed("count", "documents")
    words = divergence.vocabulary(cells, groups, 1)
    runs = divergence.column_runs(cells.drop("docs").join(words, ["lang", "term"]))
    assert sorted((r.source, r.length, r.n) for r in runs.collect()) == sorted((f"s{i}", 150, n) for i in range(4) for n in (1, 2))


def resample(rows, target, percent, least, longest=1):
    def features(text):
        words = WORDS.findall((text or "").translate(LOWER))
        return [" ".join(words[k:k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)], len(words)

    def counted(texts):
        return collections.Counter(zlib.crc32(f.encode()) % 10_000 for t in texts for f in features(t)[0])

    s, t = counted(r.text for r in rows), counted(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10_000) / ((s[b] + 1) * (sum(t.values()) + 10_000)))) for b in range(10_000)]
    out = []
    for r in rows:
        own, n = features(r.text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        out.append([r.doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(fit[:percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def drawn(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("percent, least, longest", [(10, 20, 1), (55, 1, 2), (100, 0, 1), (0, 0, 1)])
def test_resampling_equals_plain(spark, percent, least, longest):
    target = spark.createDataFrame([("the same words as here",), (None,), ("two three",)], "text string")
    texts = [r.text for r in target.collect()]
    docs = awkward(spark)
    got = resampling.resample(docs, target, percent=percent, least_words=least, longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert drawn(got) == resample(docs.collect(), texts, percent, least, longest)


def test_resampling_with_ties(spark):
    """A third of all rows has one id and one text, and the last place falls into it."""
    rows = [(7, "one two three", "en", "a")] * 100 + [(None, "one two three four", "en", "a")] * 60 + [(i, f"one two {i}", "en", "b") for i in range(150)]
    docs, target = documents(spark, rows), spark.createDataFrame([("three",)], "text string")
    for percent in (1, 20, 50, 75, 99):
        assert drawn(resampling.resample(docs, target, percent=percent, least_words=1)) == resample(docs.collect(), ["three"], percent, 1)


def test_quickselect_finds_every_place(spark):
    keys = [(int(v) % 40, 0, int(v) % 7, 1, 1) for v in np.random.default_rng(3).integers(0, 10_000, 300)]
    rows = spark.createDataFrame(keys, "worse long, without_id int, doc_key long, n_features long, weight long").repartition(3)
    ordered = sorted(keys)
    for k in (1, 2, 77, 150, 299, 300):
        key, before, same = resampling.kth_key(rows, k, 300, pivots=3)
        assert key == ordered[k - 1] and before == sum(x < key for x in keys) and same == keys.count(key)


def test_resampling_of_empty_tables(spark):
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(empty(spark), target).count() == 0
    assert drawn(resampling.resample(awkward(spark), target, percent=50)) == resample(awkward(spark).collect(), [], 50, 20)


def test_query_equals_plain(spark):
    docs, target = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    assert drawn(resampling.resample(docs, target)) == resample(docs.collect(), [r.text for r in target.collect()], 10, 20)
