"""Byte-level BPE against the tiktoken library."""

import hashlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from logwarden.llm import duck_bpe
from logwarden.llm.tables import BYTE_RANKS, cut_pattern, table, vocabulary_path
from tests.llm.cases import awkward, empty

SF = "/root/testdata/sf0.001"
PATH, PATTERN = vocabulary_path(BYTE_RANKS), cut_pattern()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=duck_bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return duck_bpe.coder(PATH, PATTERN)


def equal(coder, library, texts):
    ids, sizes = coder.encode(texts)
    want = [library.encode_ordinary(t or "") for t in texts]
    assert ids.tolist() == [i for own in want for i in own] and sizes.tolist() == [len(own) for own in want]
    assert coder.decode(ids, sizes) == [(t or "").encode() for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abeinrstóñ 't\n\t .é日本1\x1c　𝔘<|endoftext|>", max_size=80), max_size=4))
def test_ids_equal_the_library(coder, library, texts):
    equal(coder, library, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "aa", "the", "in", "ción", "e", "th", "日"]), min_size=30, max_size=300).map("".join))
def test_long_pieces_equal_the_library(coder, library, text):
    equal(coder, library, [text])


def test_runs_and_pieces_without_spaces(coder, library):
    draw = np.random.default_rng(5)
    han = "".join(map(chr, draw.integers(0x4E00, 0x9000, 4000)))
    letters = "".join(map(chr, draw.integers(97, 123, 6000)))
    equal(coder, library, [None, "", "a" * 9000, "the" * 3000, han, letters, "=" * 5000, " " * 700, "ción" * 2000])


def test_lower_rank_beside_a_contracted_pair():
    """In ``xyxyz`` the second ``xy`` must wait: after the first one ``xyx`` ranks lower."""
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"xy": 500, b"xyx": 400, b"yz": 600}
    own = duck_bpe.Coder(ranks, r"(?s).+")
    library = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    for text in ("xyxyz", "xyxyz" * 30, "xyxyxy" * 20, "x" + "xyy" * 40, "zyxyxzxy" * 25):
        assert own.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_what_is_remembered_is_bounded(library, monkeypatch):
    monkeypatch.setattr(duck_bpe, "REMEMBER", 10)
    own = duck_bpe.Coder(duck_bpe.read_ranks(PATH), PATTERN)
    for i in range(5):
        equal(own, library, [f"wort{i} andereswort{i} nocheines{i}"])
    assert len(own.known) <= 10


def test_errors():
    with pytest.raises(ValueError):
        duck_bpe.Coder({b"a": 0}, PATTERN)
    with pytest.raises(ValueError):
        duck_bpe.coder(PATH, PATTERN).decode(np.array([60_000], np.uint32), np.array([1]))


def brute(rows, library):
    out = []
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        out.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_awkward_texts(spark, library):
    assert sorted(map(tuple, duck_bpe.digest(awkward(spark), PATH, PATTERN).collect()), key=str) == brute(awkward(spark).collect(), library)
    assert duck_bpe.digest(empty(spark), PATH, PATTERN).count() == 0


def test_query_equals_brute_force(spark, library):
    docs = table(spark, SF, "documents")
    assert sorted(map(tuple, duck_bpe.digest(docs, PATH, PATTERN).collect()), key=str) == brute(docs.collect(), library)
