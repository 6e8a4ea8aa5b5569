"""Token ids as binary shards: fixed-width bit packing with block offsets.

A shard file is little-endian::

    header   8 s magic, u32 version, u32 bits per id, u64 ids per block
    blocks   ids packed in ``bits`` bits each, lowest bit first; every block starts on 8 bytes
    index    u64 offset of each block and of their end, i64 document ids, u8 1 where that id is
             null, u64 ids per document
    trailer  u64 number of blocks, documents, ids, u64 offset of the index, 8 s magic

All ids of a block have the same width, so a range of ids lies at a known bit of a known block.
"""

from __future__ import annotations

import gc
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from logwarden.llm.tables import partitions, small_batches, whole_text

MAGIC = b"LWTOKENS"
HEADER = struct.Struct("<8sIIQ")
TRAILER = struct.Struct("<QQQQ8s")
BLOCK = 65_536
MANIFEST = "shard int, file string, bits int, n_docs long, n_tokens long, first_doc long"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def bits_for(vocabulary_size: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Packs ids of at most ``bits`` bits. 64 ids fill ``bits`` words, so each of the 64 places
    in such a row has one word and shift for all rows."""
    n = len(ids)
    rows = -(-n // 64) or 1
    grid = np.zeros((rows, 64), np.uint64)
    grid.reshape(-1)[:n] = ids
    words = np.zeros((rows, bits), np.uint64)
    for place in range(64):
        word, shift = divmod(place * bits, 64)
        words[:, word] |= grid[:, place] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= grid[:, place] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()[: 8 * -(-n * bits // 64)]


def unpack(data: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """``n`` ids from place ``first`` of a packed block."""
    words = np.zeros(len(data) // 8 + 1, np.uint64)
    words[:-1] = np.frombuffer(data, "<u8", len(data) // 8)
    bit = np.arange(first, first + n, dtype=np.uint64) * np.uint64(bits)
    word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    low = words[word] >> shift
    high = np.where(shift + np.uint64(bits) > 64, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), 0)
    return ((low | high) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def open_folder(folder: str):
    """File system and path for a folder that every executor reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", folder) if ":" in folder else f"file://{folder}")


class _Pieces(dict):
    """Place of a piece in the pool of ids; unseen pieces queue up to be encoded together."""

    def __init__(self, pool: "ChunkEncoder", lead: str):
        self.pool, self.lead = pool, lead

    def __missing__(self, piece: str) -> int:
        if self.lead and (not piece or piece[0].isspace() or piece[-1].isspace()):
            self[piece] = -1
        else:
            self[piece] = self.pool.queue(self.lead + piece)
        return self[piece]


class ChunkEncoder:
    """Encodes whole texts with a byte-level BPE, each different piece once.

    The tokenizer splits a text before its merges, and always in front of a single space
    between two characters that aren't spaces. So the ids of a text are those of its pieces
    between such spaces, one after another. A piece is split by the tokenizer's own pattern,
    and the model's merges run once for each different part. What is known is kept up to a
    bound and then forgotten. Pieces that hold an added token go through the whole tokenizer.
    """

    def __init__(self, tokenizer_path: str, end_id: int | None, most: int = 1_000_000):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts = regex.compile(public_tokenizers.PATTERN).findall
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = self._byte_letters(level)
        self.end_id, self.most = end_id, most
        self.forget()

    @staticmethod
    def _byte_letters(level) -> dict[int, str]:
        """How the byte level writes each byte, read off characters that hold it."""
        found: dict[int, str] = {}
        for code in (*range(0x800), *range(0x800, 0xD800, 61), *range(0xE000, 0x10000, 61), *range(0x10000, 0x110000, 4001)):
            data = chr(code).encode()
            if not all(b in found for b in data):
                found.update(zip(data, level.pre_tokenize_str(chr(code))[0][0]))
        return found

    def forget(self) -> None:
        self.first, self.later = _Pieces(self, ""), _Pieces(self, " ")
        self.merged: dict[str, bytes] = {}
        self.waiting: list[str] = []
        self.flat = np.zeros(1 << 20, np.uint32)
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.known = 1  # place 0 is the end id
        self.used = 0
        if self.end_id is not None:
            self.flat[0], self.sizes[0], self.used = self.end_id, 1, 1

    def queue(self, piece: str) -> int:
        self.waiting.append(piece)
        return self.known + len(self.waiting) - 1

    def ids_of(self, piece: str) -> list[int]:
        for token in self.added:
            if token in piece:
                return self.tokenizer.encode(piece, add_special_tokens=False).ids
        out: list[int] = []
        for part in [piece] if piece[1:].isalpha() and (piece[0] == " " or piece.isalpha()) else self.parts(piece):
            ids = self.merged.get(part)
            if ids is None:
                text = part.encode().decode("latin-1").translate(self.letters)
                ids = self.merged[part] = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
            out += memoryview(ids).cast("I")
        return out

    def settle(self) -> None:
        for at in range(0, len(self.waiting), 20_000):
            got = list(map(self.ids_of, self.waiting[at:at + 20_000]))
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            total, n = int(sizes.sum()), len(got)
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while self.known + n > len(self.sizes):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
                self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.flat[self.used:self.used + total] = np.fromiter((i for ids in got for i in ids), np.uint32, total)
            self.sizes[self.known:self.known + n] = sizes
            self.starts[self.known:self.known + n] = self.used + np.cumsum(sizes) - sizes
            self.used, self.known = self.used + total, self.known + n
        self.waiting = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        if self.known > self.most or self.used > 16 * self.most:
            self.forget()
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        # Cut at spaces and coded by Arrow, so that Python sees each different piece once.
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded, bounds = cut.flatten().dictionary_encode(), cut.offsets.to_numpy()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        first, later = self.first, self.later
        places = np.array([later[name] for name in names], np.int64)[codes]
        places[bounds[:-1]] = 0
        odd = np.minimum.reduceat(places, bounds[:-1]) < 0
        parts: list[np.ndarray] = []
        end = np.zeros(1, np.int64)
        for text, begin, stop, head, apart in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), codes[bounds[:-1]].tolist(), odd.tolist()):
            if apart or names[head][-1:].isspace():
                head, *rest = re.split(r"(?<=\S) (?=\S)", text)
                parts.append(np.array([first[head], *[self.queue(" " + p) if later[p] < 0 else later[p] for p in rest]], np.int64))
            else:
                places[begin] = first[names[head]]
                parts.append(places[begin:stop])
            parts.append(end)
        begins = np.cumsum([0, *[len(part) + 1 for part in parts[::2]]])[:-1]
        self.settle()
        at = np.concatenate(parts)
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)]
        return ids, np.add.reduceat(sizes, begins)


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, end_id: int | None) -> ChunkEncoder:
    """One per worker, so that what it knows lasts from task to task."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = ChunkEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def forget_encoders() -> None:
    """Gives the memory of this worker's encoders back, so that idle workers don't hold it beside later steps."""
    _ENCODERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def by_bytes(lengths, most: int) -> Iterator[slice]:
    """Slices of texts of about ``most`` bytes together; one longer text is a slice of its own."""
    begin = size = 0
    for i, length in enumerate(lengths.tolist()):
        if size and size + length > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += length + 1
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def _write(folder: str, tokenizer_path: str, end_id: int | None, bits: int, block: int,
           batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    system, path = open_folder(folder)
    coder = encoder(tokenizer_path, end_id)
    name = f"shard-{shard:06d}-{uuid.uuid4().hex}.bin"
    out, offset = None, HEADER.size
    offsets, doc_ids, nulls, sizes = [], [], [], []
    rest = np.zeros(0, np.uint32)
    for batch in batches:
        texts, keys = batch.column(1), batch.column(0)
        if not len(texts):
            continue
        if out is None:
            out = system.open_output_stream(f"{path}/{name}")
            out.write(HEADER.pack(MAGIC, 1, bits, block))
        # Copies: a column of a batch holds the memory of the whole batch, texts included.
        doc_ids.append(np.array(keys.fill_null(0)))
        nulls.append(np.array(keys.is_null()))
        for part in by_bytes(pc.binary_length(texts).to_numpy(), 1_000_000):
            ids, n = coder.encode(texts[part].to_pylist())
            sizes.append(n)
            rest = np.concatenate([rest, ids])
            while len(rest) >= block:
                offsets.append(offset)
                offset += out.write(pack(rest[:block], bits))
                rest = rest[block:]
    if out is None:
        return
    if len(rest):
        offsets.append(offset)
        offset += out.write(pack(rest, bits))
    keys, empty, n = np.concatenate(doc_ids), np.concatenate(nulls), np.concatenate(sizes)
    out.write(np.array([*offsets, offset], "<u8").tobytes())
    out.write(keys.astype("<i8").tobytes())
    out.write(empty.astype("u1").tobytes())
    out.write(n.astype("<u8").tobytes())
    out.write(TRAILER.pack(len(offsets), len(n), int(n.sum()), offset, MAGIC))
    out.close()
    yield pa.RecordBatch.from_pydict({
        "shard": pa.array([shard], pa.int32()), "file": [name], "bits": pa.array([bits], pa.int32()), "n_docs": [len(n)],
        "n_tokens": [int(n.sum())], "first_doc": pa.array([None if empty[0] else int(keys[0])], pa.int64())})


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, vocabulary_size: int, end_id: int | None = 0,
                 id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK,
                 shards: int | None = None) -> DataFrame:
    """Writes the ids of all texts in ascending document id; returns one manifest row per shard.

    Texts are dealt out by range of the id to ``shards`` tasks (default: the session's shuffle partitions),
    sorted there and written as one stream, so memory holds a slice of texts, one block, and id and length
    of each document of the shard. Equal ids are ordered by a hash of the text. A null
    text is empty, a null id comes first, repeated rows are all written, an empty table gives no
    shard. Each attempt of a task writes a file of its own name, and only the manifest row of the
    attempt that counted names its file: lost executors leave at most unnamed files.
    """
    bits = bits_for(vocabulary_size)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    small_batches(docs.sparkSession)
    ordered = rows.repartitionByRange(shards or partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    path = f"{folder.rstrip('/')}/_manifest"
    system, local = open_folder(folder)
    system.create_dir(local, recursive=True)
    ordered.mapInArrow(partial(_write, folder, tokenizer_path, end_id, bits, block), MANIFEST).write.parquet(path)
    return read_manifest(docs.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The shards with the number of ids before each; one row per shard, so one window task will do."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/_manifest")
    return rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


class Shard:
    """Random access to one shard file."""

    def __init__(self, source):
        self.source, size = source, source.size()
        self.blocks, self.n_docs, self.n_tokens, at, magic = TRAILER.unpack(source.read_at(TRAILER.size, size - TRAILER.size))
        _, _, self.bits, self.block = HEADER.unpack(source.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        index = source.read_at(size - TRAILER.size - at, at)
        self.offsets = np.frombuffer(index, "<u8", self.blocks + 1).astype(np.int64)
        at = 8 * (self.blocks + 1)
        self.doc_ids = np.frombuffer(index, "<i8", self.n_docs, at)
        self.null = np.frombuffer(index, "u1", self.n_docs, at + 8 * self.n_docs).astype(bool)
        self.sizes = np.frombuffer(index, "<u8", self.n_docs, at + 9 * self.n_docs).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def ids(self, first: int, n: int) -> np.ndarray:
        """Ids from place ``first`` of the shard; reads only the blocks they lie in."""
        out = []
        for k in range(first // self.block, -(-(first + n) // self.block)):
            begin, end = max(first, k * self.block), min(first + n, (k + 1) * self.block)
            data = self.source.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
            out.append(unpack(data, self.bits, begin - k * self.block, end - begin))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """Each document's place and ids, with a few blocks in memory at a time."""
        begin = 0
        while begin < self.n_docs:
            end = max(begin + 1, int(np.searchsorted(self.starts, self.starts[begin] + most)))
            base = int(self.starts[begin])
            ids = self.ids(base, int(self.sizes[begin:end].sum()))
            for k in range(begin, end):
                yield k, ids[self.starts[k] - base:self.starts[k] - base + self.sizes[k]]
            begin = end


def _read(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if _ENCODERS:  # all shards are written by now
        forget_encoders()
    system, path = open_folder(folder)
    for batch in batches:
        for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
            with system.open_input_file(f"{path}/{name}") as source:
                shard = Shard(source)
                sums = np.zeros(shard.n_docs, np.int64)
                for k, ids in shard.documents():
                    sums[k] = zlib.crc32(ids.astype("<u4").tobytes())
            for at in range(0, shard.n_docs, 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard.doc_ids[part], mask=shard.null[part]), pa.array(start + shard.starts[part]),
                    pa.array(shard.sizes[part]), pa.array(sums[part])], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32 (checksum of its ids as 32-bit integers)."""

    shards = read_manifest(spark, folder).select("shard", "file", "start")
    return shards.repartition(partitions(spark), "shard").mapInArrow(partial(_read, folder), DIGEST)
