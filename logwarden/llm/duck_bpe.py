"""Byte-level BPE by DuckDB: recursive queries over token-position rows, per partition.

Texts are cut by the tokenizer's pattern; each different piece is solved once in a slice of texts and
remembered by the worker. A piece that is a token is that token. The bytes of all others become rows
(word, pos, id). In each round of a recursive query neighbours are joined with the merge table and each
word's leftmost pair of least rank is contracted, until no pair of any word can merge. Decoding joins the
ids with the vocabulary and aggregates their bytes in order.

Exact short cuts, for long pieces only: (1) further occurrences of the least pair in a word are contracted
in the same round, from the left up to the first one that brings a pair of lower rank beside it; until
then they are what the following rounds would do. (2) Pieces are cut between bytes that no occurrence of
any token spans, as no merge ever crosses them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logwarden.llm.hashing import buffers, slices
from logwarden.llm.tables import small_batches

#: Bytes of text, and bytes of ids, that are worked on at a time.
SLICE = 2_000_000
#: Pieces that a worker remembers before it starts anew, and pieces that one query solves.
REMEMBER, AT_ONCE = 600_000, 20_000
#: Longer pieces, in bytes, take the short cuts (at most 63, see ``_SOLVE``).
LONG = 48
#: Rounds of one recursive query; long words that aren't done by then go on in another one.
ROUNDS = 64

#: Contracts the leftmost pair of least rank of each word; positions close up behind it. A row's place is word * 64 + position.
_SOLVE = """
WITH RECURSIVE state(place, id, round) AS (
  SELECT word::BIGINT * 64 + pos, id, 0 FROM start
  UNION ALL (
    WITH least AS MATERIALIZED (
      SELECT a.place >> 6 AS word, min(m.new::BIGINT * 64 + (a.place & 63)) AS pair
      FROM state a JOIN state b ON b.place = a.place + 1 AND b.place & 63 > 0
      JOIN merges m ON m.l = a.id AND m.r = b.id GROUP BY ALL)
    SELECT s.place - ((s.place & 63) > (pair & 63))::BIGINT, CASE WHEN s.place & 63 = pair & 63 THEN (pair >> 6)::INTEGER ELSE s.id END, s.round + 1
    FROM state s JOIN least ON word = s.place >> 6 WHERE s.place & 63 <> (pair & 63) + 1)),
last AS (SELECT place >> 6 AS word, max(round) AS round FROM state GROUP BY ALL)
SELECT place >> 6 AS word, id FROM state JOIN last ON last.word = place >> 6 AND last.round = state.round ORDER BY place
"""

#: The same with the first short cut: several pairs of a word in one round.
_SOLVE_LONG = f"""
WITH RECURSIVE state(word, pos, id, round) AS (
  SELECT word, pos, id, 0 FROM start
  UNION ALL (
    WITH pairs AS MATERIALIZED (
      SELECT s.*, m.new FROM (
        SELECT *, row_number() OVER w AS place, lag(id) OVER w AS before, lead(id) OVER w AS next, lead(id, 2) OVER w AS after
        FROM state WINDOW w AS (PARTITION BY word ORDER BY pos)) s
      LEFT JOIN merges m ON m.l = s.id AND m.r = s.next),
    least AS (SELECT word, min(new) AS least FROM pairs GROUP BY word HAVING min(new) IS NOT NULL),
    hits AS MATERIALIZED (  -- of overlapping pairs every second one, from the left
      SELECT * FROM (
        SELECT *, place - row_number() OVER (PARTITION BY word ORDER BY place) AS run FROM pairs JOIN least USING (word) WHERE new = least)
      QUALIFY row_number() OVER (PARTITION BY word, run ORDER BY place) % 2 = 1),
    first AS MATERIALIZED (  -- up to the first that brings a lower rank beside it
      SELECT h.word, h.place, h.new FROM (
        SELECT *, CASE WHEN lag(place) OVER w = place - 2 THEN new ELSE before END AS beside FROM hits WINDOW w AS (PARTITION BY word ORDER BY place)) h
      LEFT JOIN merges a ON a.l = h.beside AND a.r = h.new
      LEFT JOIN merges b ON b.l = h.new AND b.r = h.after
      QUALIFY coalesce(count(*) FILTER (least(a.new, b.new) < h.new)
        OVER (PARTITION BY h.word ORDER BY h.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0)
    SELECT p.word, p.pos, coalesce(c.new, p.id), p.round + 1
    FROM pairs p JOIN least USING (word) LEFT JOIN first c ON c.word = p.word AND c.place = p.place
    LEFT JOIN first d ON d.word = p.word AND d.place = p.place - 1
    WHERE d.place IS NULL AND p.round < {ROUNDS}))
SELECT word, pos, id, round FROM state QUALIFY round = max(round) OVER (PARTITION BY word) ORDER BY word, pos
"""

_DECODE = """
SELECT doc, from_hex(string_agg(hex, '' ORDER BY pos)) AS bytes
FROM tokens JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one line per token, its bytes in base64 and its rank, which is its id."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Coder:
    """The merge table and the vocabulary in DuckDB, and what has been solved so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"a byte-level vocabulary needs all bytes as tokens, {len(missing)} are missing")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self.automaton = None
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        self.con.execute("CREATE TABLE vocabulary(id INTEGER, hex VARCHAR)")
        self._fill("vocabulary", {"id": pa.array(list(ranks.values()), pa.int32()), "hex": [token.hex() for token in ranks]})
        pairs = [(ranks.get(token[:i], -1), ranks.get(token[i:], -1), rank) for token, rank in ranks.items() for i in range(1, len(token))]
        merges = np.array(pairs, np.int32).reshape(-1, 3)
        merges = merges[(merges[:, :2] >= 0).all(axis=1)]
        self.con.execute("CREATE TABLE merges(l INTEGER, r INTEGER, new INTEGER)")
        self._fill("merges", {"l": merges[:, 0], "r": merges[:, 1], "new": merges[:, 2]})

    def _fill(self, name: str, columns: dict) -> None:
        self._ask(f"INSERT INTO {name} SELECT * FROM given", given=pa.table(columns))

    def _ask(self, sql: str, **tables: pa.Table) -> dict[str, np.ndarray]:
        for name, rows in tables.items():
            self.con.register(name, rows)
        self.con.execute(sql)
        out = self.con.fetchnumpy()
        for name in tables:
            self.con.unregister(name)
        return out

    def _parts(self, piece: bytes) -> list[bytes]:
        """A long piece cut between bytes that no occurrence of a token spans."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for token in self.ranks:
                if len(token) > 1:
                    self.automaton.add_word(token.decode("latin-1"), len(token))
            self.automaton.make_automaton()
        spans = np.zeros(len(piece) + 1, np.int32)  # spans that cover the boundary before each byte
        for end, size in self.automaton.iter(piece.decode("latin-1")):
            spans[end - size + 2] += 1
            spans[end + 1] -= 1
        cuts = [0, *(1 + np.flatnonzero(np.cumsum(spans)[1:-1] == 0)).tolist(), len(piece)]
        return [piece[a:b] for a, b in zip(cuts, cuts[1:])]

    def _rows(self, words: list[bytes]) -> pa.Table:
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "pos": place.astype(np.int32), "id": self.byte_ids[data]})

    def _contract(self, words: list[bytes], long: bool) -> list[bytes]:
        """The ids of each word as little-endian 32-bit numbers, by the recursive query."""
        out = []
        for begin in range(0, len(words), AT_ONCE):
            some = words[begin:begin + AT_ONCE]
            start = self._rows(some)
            if not long:
                got = self._ask(_SOLVE, start=start)
            else:
                while True:
                    got = self._ask(_SOLVE_LONG, start=start)
                    if not len(got["round"]) or got["round"].max() < ROUNDS:
                        break
                    start = pa.table({c: got[c].astype(np.int32) for c in ("word", "pos", "id")})
            ids = got["id"].astype("<u4")
            bounds = np.searchsorted(got["word"], np.arange(len(some) + 1))
            out += [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        return out

    def _solve(self, pieces: list[str]) -> None:
        """Remembers the ids of pieces that are not known yet."""
        words: list[bytes] = []
        long: dict[str, list[bytes]] = {}
        names = []
        for piece in pieces:
            word = piece.encode()
            rank = self.ranks.get(word)
            if rank is not None:
                self.known[piece] = rank.to_bytes(4, "little")
            elif len(word) > LONG:
                long[piece] = self._parts(word)
            else:
                names.append(piece)
                words.append(word)
        self.known.update(zip(names, self._contract(words, False)))
        parts = sorted({part for cut in long.values() for part in cut})
        small = [p for p in parts if len(p) <= LONG]
        large = [p for p in parts if len(p) > LONG]
        solved = dict(zip(small, self._contract(small, False))) | dict(zip(large, self._contract(large, True)))
        for piece, cut in long.items():
            self.known[piece] = b"".join(solved[part] for part in cut)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has."""
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        pieces = pa.array([p for own in cut for p in own], pa.large_string()).dictionary_encode()
        names = pieces.dictionary.to_pylist()
        if len(self.known) + len(names) > REMEMBER:
            self.known.clear()
        self._solve([p for p in names if p not in self.known])
        ids = [self.known[p] for p in names]
        n_ids = np.array([len(i) // 4 for i in ids], np.int64)
        first = np.cumsum(n_ids) - n_ids
        flat = np.frombuffer(b"".join(ids), "<u4")
        codes = pieces.indices.to_numpy(zero_copy_only=False)
        sizes = n_ids[codes]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[codes] - (ends - sizes), sizes)
        bounds = np.concatenate([[0], np.cumsum([len(own) for own in cut])]).astype(np.int64)
        before = np.concatenate([[0], ends])[bounds]
        return flat[at], np.diff(before)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes that the ids of each text stand for."""
        unknown = ids[~np.isin(ids, np.fromiter(self.ranks.values(), np.uint32))] if len(ids) else ids
        if len(unknown):
            raise ValueError(f"id {unknown[0]} is not in the vocabulary")
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        got = self._ask(_DECODE, tokens=pa.table({"doc": doc, "pos": np.arange(len(ids), dtype=np.int32), "id": ids.astype(np.int32)}))
        out = [b""] * len(sizes)
        for d, text in zip(got["doc"].tolist(), got["bytes"]):
            out[d] = bytes(text)
        return out


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """One per worker, so that what it knows lasts from task to task."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(read_ranks(path), pattern)
    return _CODERS[path, pattern]


def _encode(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, offsets = buffers(batch.column(1))
        for begin, end in slices(offsets, SLICE):
            ids, sizes = coder(path, pattern).encode(batch.column(1).slice(begin, end - begin).to_pylist())
            ends = np.concatenate([[0], np.cumsum(sizes) * 4]).astype(np.int64)
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), packed.cast(pa.binary())], ["doc_id", "ids"])


def _decode(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = batch.column(1).cast(pa.large_binary()).fill_null(b"")
        sizes = pa.compute.binary_length(packed).to_numpy(zero_copy_only=False)
        for begin, end in slices(np.concatenate([[0], np.cumsum(sizes)]), SLICE):
            own = packed.slice(begin, end - begin)
            ids = np.frombuffer(b"".join(own.to_pylist()), "<u4")
            texts = coder(path, pattern).decode(ids, sizes[begin:end] // 4)
            rows = batch.slice(begin, end - begin)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: ids as little-endian unsigned 32-bit numbers, as the rank tokenizers give them.

    ``path`` is a rank file that every worker has, ``pattern`` cuts texts into pieces that are merged
    separately. Null and empty texts have no id. Rows are kept one for one, nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(partial(_encode, path, pattern), "doc_id long, ids binary")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``, the bytes that ``ids`` stand for, to (doc_id, ids). Null ids count as none; an id outside the vocabulary is an error."""
    small_batches(tokens.sparkSession)
    return tokens.select("doc_id", "ids").mapInArrow(partial(_decode, path, pattern), "doc_id long, ids binary, decoded binary")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, by encoding and decoding it."""
    coded = decode(encode(docs, path, pattern), path, pattern)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
