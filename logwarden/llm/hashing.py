"""Words and word sequences of many texts at once, as 64-bit hashes in numpy.

Works on the UTF-8 bytes of an Arrow string column, so no Python object is made per word. A word
is a run of bytes other than space and 0x09-0x0D, hashed with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
_ROOT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_tables(space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word bytes and lower-casing values for words between the given bytes."""
    lower = np.arange(256)
    lower[65:91] += 32
    values = mix((lower.astype(np.uint64) + np.uint64(1)) * _ROOT)
    values[space] = 0
    return space, values


IS_SPACE, BYTE_VALUE = byte_tables(np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)]))
#: Words of letters and digits: ASCII signs and controls stand between them.
_SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
IS_SIGN, WORD_VALUE = byte_tables(_SIGNS)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        base = 0xD1342543DE82EF95
        for i, b in enumerate((base, pow(base, -1, 1 << 64))):
            _POWERS[i] = np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes; one longer text is a range of its own."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        yield begin, end
        begin = end


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE,
          values: np.ndarray = BYTE_VALUE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, its first byte, and the number of words before each document and at the end.

    ``space`` marks the bytes between words; ``values`` has a number for each byte, 0 for those.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~space[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[heads] = word[heads]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, np.zeros(len(offsets), np.int64)
    up, down = _powers(len(data))
    sums = np.add.reduceat(values[data] * up, starts)
    return mix(sums * down[starts]), starts, np.searchsorted(starts, offsets).astype(np.int64)


def sequences(hashes: np.ndarray, bounds: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words that lie within one document, with the document and the
    first word of each. With ``short``, a document of fewer words counts as one run of them all."""
    size = np.diff(bounds)
    doc = np.repeat(np.arange(len(size)), size)
    total = len(hashes)
    out = np.full(total, n, np.uint64)
    factors = _ROOT * (2 * np.arange(n, dtype=np.uint64) + np.uint64(3)) | np.uint64(1)
    for k in range(min(n, total)):
        out[:total - k] += (hashes[k:] + np.uint64(k)) * factors[k]
    place = np.arange(total) - np.repeat(bounds[:-1], size)
    whole = place + n <= np.repeat(size, size)
    at = np.flatnonzero(whole)
    runs, docs = mix(out[at]), doc[at]
    small = np.flatnonzero((size > 0) & (size < n)) if short else []
    if len(small):
        extra = np.zeros(len(small), np.uint64)
        for i, d in enumerate(small):
            h = hashes[bounds[d]:bounds[d + 1]]
            k = np.arange(len(h), dtype=np.uint64)
            extra[i] = ((h + k) * factors[:len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))
        runs, docs = np.concatenate([runs, mix(extra)]), np.concatenate([docs, small])
        at = np.concatenate([at, bounds[small]])
        order = np.argsort(docs, kind="stable")
        runs, docs, at = runs[order], docs[order], at[order]
    return runs, docs, at


def distinct(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each different value of each document once, in ascending order within the document.

    ``docs`` ascends. One stable sort of the values and one of the documents.
    """
    order = np.argsort(values)
    order = order[np.argsort(docs[order], kind="stable")]
    values, docs = values[order], docs[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    return values[keep], docs[keep]
