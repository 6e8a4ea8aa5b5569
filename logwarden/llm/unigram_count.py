"""Token counts of a unigram vocabulary without making the tokens.

An Aho-Corasick automaton lists all vocabulary pieces that end at each character; dynamic programming
carries the best score up to there and the number of pieces on that path. Ties follow the unigram
tokenizers: a later candidate must be strictly better, and candidates come by ascending start.

White space becomes the mark U+2581 and one is put in front. No piece of such a vocabulary goes on
past a mark after other characters, so best paths end there, and each different word is solved
once in a task. The score of the whole is the sum of its words' in exact arithmetic (scores of whole
numbers, as in rank-scored vocabularies, add up exactly).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
#: How far below the least score an unknown character lies.
UNKNOWN = 10.0
#: Words that a worker remembers before it starts anew, and the longest of them.
REMEMBER, LONGEST = 1_000_000, 64


class Counter(dict):
    """Pieces of each word; a word that isn't known yet is solved when asked for."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool = True):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(pieces.values()) - UNKNOWN
        self.bytes = byte_fallback
        self.apart = not any(MARK in piece.lstrip(MARK) for piece in pieces)

    @classmethod
    def of_file(cls, path: str) -> "Counter":
        """From a sentencepiece model file: its pieces with their scores, without control and byte pieces."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        pieces = {model.id_to_piece(i): model.get_score(i) for i in every
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        return cls(pieces, any(model.is_byte(i) for i in every))

    def __missing__(self, word: str) -> int:
        n = self.solve(MARK + word)
        if len(word) <= LONGEST:
            self[word] = n
        return n

    def solve(self, text: str) -> int:
        """Pieces of the best path through a text that is marked already."""
        n = len(text)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(text)
        match = next(matches, None)
        for end in range(1, n + 1):
            top, pieces, single = None, 0, False
            while match is not None and match[0] == end - 1:  # longest first: by ascending start
                size, score = match[1]
                single |= size == 1
                score += best[end - size]
                if top is None or score > top:
                    top, pieces = score, count[end - size] + 1
                match = next(matches, None)
            if not single:
                score = best[end - 1] + self.unknown
                if top is None or score > top:
                    top, unknown[end] = score, True
                    # Bytes stand for an unknown character; without them neighbours make up one piece.
                    pieces = count[end - 1] + (len(text[end - 1].encode()) if self.bytes else not unknown[end - 1])
            best[end], count[end] = top, pieces
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self) > REMEMBER:
            self.clear()
        text = text.replace(MARK, " ")
        if not self.apart:
            return self.solve(MARK + text.replace(" ", MARK))
        words = text.split(" ")
        if "" in words:  # marks in a row belong to the word behind them
            return sum(self[w[1:]] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK)))
        return sum(map(self.__getitem__, words))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker, so that what it knows lasts from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter.of_file(path)
    return _COUNTERS[path]


def _count(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    solve = counter(path)
    for batch in batches:
        counts = [solve.count(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row; ``path`` is a sentencepiece model file that every worker has.

    A text that is null or empty has no token; one of spaces has those of its marks. Characters
    that no piece covers count one token per UTF-8 byte if the vocabulary has byte pieces. Rows
    are kept one for one, nothing is shuffled.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(partial(_count, path), "doc_id long, n_tokens long")
