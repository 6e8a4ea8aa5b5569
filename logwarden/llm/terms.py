"""Words as exact strings, cut from Arrow text columns without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z to a-z, all other bytes as they are.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def gap_bytes(*ranges: tuple[int, int]) -> np.ndarray:
    """The bytes between words, by first and last of each range. Only ASCII bytes may be given."""
    gap = np.zeros(256, bool)
    for first, last in ranges:
        gap[first:last + 1] = True
    return gap


#: Words of letters: all ASCII but letters stands between them. Words of letters and digits likewise.
LETTERS = gap_bytes((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LETTERS_DIGITS = gap_bytes((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def cut_words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words, A-Z lower-cased, and the number of words before each document and at the end.

    ``data`` and ``offsets`` are the bytes of a text column (``hashing.buffers``). Characters beyond
    ASCII are part of words.
    """
    word = ~gap[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[heads] = word[heads]
    starts = np.flatnonzero(start)
    letters = _LOWER[data[word]]
    ends = np.concatenate([np.cumsum(word, dtype=np.int64)[starts] - 1, [len(letters)]]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(letters))
    return words, np.searchsorted(starts, offsets).astype(np.int64)


def runs(words: pa.Array, bounds: np.ndarray, longest: int) -> tuple[pa.Array, np.ndarray]:
    """All runs of 1 to ``longest`` words of each document, joined by one space, and their documents."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    texts, docs, run = [words], [doc], words
    for n in range(2, longest + 1):
        run = pc.binary_join_element_wise(run[:-1], words[n - 1:], pa.scalar(" ", pa.large_string())) if len(run) > 1 else run[:0]
        inside = doc[:len(run)] == doc[n - 1:n - 1 + len(run)]
        texts.append(run.filter(pa.array(inside)))
        docs.append(doc[:len(run)][inside])
    return pa.concat_arrays(texts), np.concatenate(docs)
