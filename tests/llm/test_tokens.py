"""Token counts and token shards against the tokenizers library."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer, models, normalizers

from logwarden.llm import bitpack, unigram_count
from logwarden.llm.tables import BYTE_BPE, PIECES, table, vocabulary_path
from logwarden.session import new_work_path
from tests.llm.cases import awkward, empty

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def counter():
    return unigram_count.Counter.of_file(vocabulary_path(PIECES))


@pytest.fixture(scope="module")
def unigram():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(PIECES))
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    tokenizer = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    tokenizer.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return tokenizer


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abeinrst hé▁日\n.,1<|>", max_size=60))
def test_counts_equal_the_library(counter, unigram, text):
    if "<" not in text:  # the library also matches the names of control and byte pieces
        assert counter.count(text) == len(unigram.encode(text, add_special_tokens=False).ids)


def test_ties_go_to_the_earliest_start():
    # ab + c and a + bc score the same; both have two pieces, a + b + c has three and scores as much.
    tied = unigram_count.Counter({"▁": -1.0, "a": -1.0, "b": -1.0, "c": -1.0, "ab": -2.0, "bc": -2.0, "abc": -3.0})
    assert tied.count("abc") == 2  # the mark, and the longest piece, which starts first
    fused = unigram_count.Counter({"▁": -1.0, "a": -1.0}, byte_fallback=False)
    assert fused.count("axya") == 4 and fused.count("xya") == 3


def test_counts_of_awkward_texts(spark, counter):
    got = {r.doc_id: r.n_tokens for r in unigram_count.count_tokens(awkward(spark), vocabulary_path(PIECES)).collect() if r.doc_id}
    assert got[1] == got[2] == 0 and got[3] > 0 and got[7] == got[8]
    assert got[5] == counter.count(next(r.text for r in awkward(spark).collect() if r.doc_id == 5))
    assert unigram_count.count_tokens(awkward(spark), vocabulary_path(PIECES)).count() == 13
    assert unigram_count.count_tokens(empty(spark), vocabulary_path(PIECES)).count() == 0


def test_count_query_equals_the_library(spark, unigram):
    docs = table(spark, SF, "documents")
    want = {r.doc_id: len(unigram.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in unigram_count.count_tokens(docs, vocabulary_path(PIECES)).collect()} == want


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 300), st.data())
def test_packing_round_trip(bits, n, data):
    ids = np.random.default_rng(bits * 1000 + n).integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
    packed = bitpack.pack(ids, bits)
    assert len(packed) == 8 * -(-n * bits // 64)
    first = data.draw(st.integers(0, n))
    size = data.draw(st.integers(0, n - first))
    assert (bitpack.unpack(packed, bits, first, size) == ids[first:first + size]).all()


def test_bits():
    assert [bitpack.bits_for(n) for n in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab 't\n\t .é日1\x1c\u3000<|endoftext|>", max_size=40), max_size=5))
def test_pieces_encode_like_the_whole(texts):
    coder = bitpack.encoder(vocabulary_path(BYTE_BPE), 0)
    ids, sizes = coder.encode(texts)
    want = [e.ids + [0] for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for own in want for i in own] and sizes.tolist() == [len(own) for own in want]


def shards(spark, docs, block=bitpack.BLOCK):
    folder = new_work_path(spark, "shards")
    bitpack.write_shards(docs, folder, vocabulary_path(BYTE_BPE), 50_257, 0, block=block)
    return folder


def brute(docs):
    tokenizer = Tokenizer.from_file(vocabulary_path(BYTE_BPE))
    rows, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        rows.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return rows


@pytest.mark.parametrize("block", [64, 1000, bitpack.BLOCK])
def test_shards_read_back(spark, block):
    got = bitpack.read_digest(spark, shards(spark, awkward(spark), block)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(awkward(spark))


def test_query_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    assert sorted(map(tuple, bitpack.read_digest(spark, shards(spark, docs)).collect())) == brute(docs)


def test_random_access(spark):
    folder = shards(spark, table(spark, SF, "documents"), 640)
    system, path = bitpack.open_folder(folder)
    name = bitpack.read_manifest(spark, folder).first().file
    with system.open_input_file(f"{path}/{name}") as source:
        shard = bitpack.Shard(source)
        whole = np.concatenate([ids for _, ids in shard.documents(most=1)])
        assert len(whole) == shard.n_tokens
        for first, n in ((0, 1), (639, 2), (1000, 1500), (shard.n_tokens - 5, 5)):
            assert (shard.ids(first, n) == whole[first:first + n]).all()


def test_empty_table_has_no_shard(spark):
    folder = shards(spark, empty(spark))
    assert bitpack.read_manifest(spark, folder).count() == 0 and bitpack.read_digest(spark, folder).count() == 0
