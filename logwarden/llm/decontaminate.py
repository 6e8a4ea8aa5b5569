"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every word n-gram of a test item is a seed. Where a document holds one, or several at about the right
distance, that stretch is aligned with the item word by word, so copies with words changed, added or left
out are found. Seeds are ranked by how many documents hold them: stretches with the rarest go first, and
those that can't beat what was found already, nor reach the least score, by the words they share with the
item, aren't aligned. An item of fewer words than a seed has is one seed itself.

Test items are taken in blocks of bounded size, each sent to every task; the documents are never
shuffled, and a passage that a third of them share costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logwarden.llm.hashing import IS_SIGN, WORD_VALUE, buffers, sequences, slices, words
from logwarden.llm.tables import small_batches

GRAM = 3
#: Test items that one pass holds at most, about.
ITEMS = 20_000
#: What a differing, an additional or a missing word costs, in words that agree.
COST = 0.5
FOUND = "item_id long, score double, start_word int, n_words int, start_byte int, n_bytes int"


@dataclass
class Items:
    """A block of test items as their word hashes, and their n-grams."""

    ids: np.ndarray
    words: np.ndarray
    bounds: np.ndarray
    size: int  # words of an n-gram
    grams: np.ndarray  # sorted different n-gram hashes
    gram: np.ndarray  # by occurrence: which of them,
    item: np.ndarray  # in which item
    offset: np.ndarray  # and at which word
    held: np.ndarray | None = None  # documents that hold each n-gram

    @classmethod
    def of(cls, rows: list[tuple[int, str]], size: int = GRAM) -> "Items":
        data, offsets = buffers(pa.array([text or "" for _, text in rows], pa.string()))
        hashes, _, bounds = words(data, offsets, IS_SIGN, WORD_VALUE)
        runs, item, at = sequences(hashes, bounds, size, short=False)
        grams, gram = np.unique(runs, return_inverse=True)
        return cls(np.array([i for i, _ in rows], np.int64), hashes, bounds, size, grams, gram, item, at - bounds[item])

    @classmethod
    def by_size(cls, rows: list[tuple[int, str]]) -> list["Items"]:
        """Items with the longest n-grams that they have, at most GRAM words; those without words have none."""
        n = np.diff(words(*buffers(pa.array([text or "" for _, text in rows], pa.string())), IS_SIGN, WORD_VALUE)[2])
        parts = [[row for row, k in zip(rows, n) if min(k, GRAM) == size] for size in range(1, GRAM + 1)]
        return [cls.of(part, size) for size, part in zip(range(1, GRAM + 1), parts) if part]


class _Finder:
    """Which of a sorted list of hashes occur, with a bit table in front of the search."""

    def __init__(self, grams: np.ndarray):
        self.grams, self.table = grams, np.zeros(1 << 22, bool)
        self.table[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def __call__(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``runs`` that hold a listed hash, and which."""
        at = np.flatnonzero(self.table[(runs & np.uint64((1 << 22) - 1)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.grams, runs[at]), len(self.grams) - 1)
        hit = self.grams[which] == runs[at] if len(self.grams) else np.zeros(len(at), bool)
        return at[hit], which[hit]


def _runs(column: pa.Array, size: int) -> Iterator[tuple]:
    data, offsets = buffers(column)
    for begin, end in slices(offsets):
        part = data[offsets[begin]:offsets[end]]
        hashes, starts, bounds = words(part, offsets[begin:end + 1] - offsets[begin], IS_SIGN, WORD_VALUE)
        yield begin, end, part, offsets[begin:end + 1] - offsets[begin], hashes, starts, bounds, *sequences(hashes, bounds, size, short=False)


def _count(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, size = shared.value.grams, shared.value.size
    find, total = _Finder(grams), np.zeros(len(grams), np.int64)
    for batch in batches:
        for *_, runs, docs, _ in _runs(batch.column(0), size):
            at, which = find(runs)
            pairs = np.unique(docs[at] * len(grams) + which)
            total += np.bincount(pairs % len(grams), minlength=len(grams)) if len(pairs) else 0
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["gram", "documents"])


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """Best local alignment: agreeing words less the cost of others, and where it ends in ``text``."""
    slope = np.arange(len(text) + 1) * COST
    row = np.zeros(len(text) + 1)
    best, end = 0.0, 0
    for word in item:
        step = np.zeros(len(text) + 1)
        step[1:] = np.maximum(row[:-1] + np.where(text == word, 1.0, -COST), row[1:] - COST)
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top
    return best, end


def _stretches(doc: np.ndarray, item: np.ndarray, place: np.ndarray, held: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, first and last word where the item might begin) for hits that lie together, those with the rarest seed first."""
    order = np.lexsort((place, item, doc))
    doc, item, place, held = doc[order], item[order], place[order], held[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > np.maximum(4, size[item[1:]] // 4))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    for k in np.lexsort((first, np.minimum.reduceat(held, first))) if len(first) else []:
        yield int(doc[first[k]]), int(item[first[k]]), int(place[first[k]]), int(place[last[k]])


def _search(shared, least_score: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    items: Items = shared.value
    find = _Finder(items.grams)
    order = np.argsort(items.gram, kind="stable")
    own = np.searchsorted(items.gram[order], np.arange(len(items.grams) + 1))
    size = np.diff(items.bounds)
    for batch in batches:
        keep = batch.select(list(range(batch.num_columns - 1)))
        rows, found = [], []
        for begin, _, data, offsets, hashes, starts, bounds, runs, docs, firsts in _runs(batch.column(batch.num_columns - 1), items.size):
            at, which = find(runs)
            if not len(at):
                continue
            times = own[which + 1] - own[which]
            hit = np.repeat(np.arange(len(at)), times)
            entry = order[np.repeat(own[which], times) + np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times)]
            doc = docs[at][hit]
            place = firsts[at][hit] - bounds[doc] - items.offset[entry]
            best: dict[tuple[int, int], tuple] = {}
            for d, i, low, high in _stretches(doc, items.item[entry], place, items.held[which[hit]], size):
                item, slack = items.words[items.bounds[i]:items.bounds[i + 1]], 4 + size[i] // 4
                left = max(0, low - slack) + bounds[d]
                right = min(bounds[d + 1], bounds[d] + high + size[i] + slack)
                text = hashes[left:right]
                # No alignment scores more than the words of the stretch that are the item's, nor more than the item has.
                most = min(int(np.isin(text, item).sum()), len(item))
                enough = max(least_score * len(item), best.get((d, i), (0,))[0])
                if most < enough:
                    continue
                score, end = align(item, text)
                if score < enough:
                    continue
                back = align(item[::-1], text[:end][::-1])[1]
                first = int(left + end - back)
                if (d, i) not in best or (score, -first) > (best[d, i][0], -best[d, i][1]):
                    best[d, i] = (score, first, int(left + end))
            for (d, i), (score, first, last) in sorted(best.items()):
                tail = starts[last] if last < bounds[d + 1] else offsets[d + 1]
                stop = int(tail)
                while stop > starts[last - 1] and IS_SIGN[data[stop - 1]]:
                    stop -= 1
                rows.append(begin + d)
                found.append((int(items.ids[i]), round(score / size[i], 6), first - int(bounds[d]), last - first,
                              int(starts[first] - offsets[d]), stop - int(starts[first])))
        columns = list(zip(*found)) or [[]] * 6
        kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*keep.take(pa.array(rows, pa.int64())).columns, *[pa.array(c, k) for c, k in zip(columns, kinds)]],
            [*keep.schema.names, "item_id", "score", "start_word", "n_words", "start_byte", "n_bytes"])


def _drop(shared, least_score: float, text: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in whose text no item of the block is found."""
    for batch in batches:
        place = pa.array(range(len(batch)), pa.int64())
        searched = pa.RecordBatch.from_arrays([place, batch.column(text)], ["place", "text"])
        bad = {p for found in _search(shared, least_score, iter([searched])) for p in found.column(0).to_pylist()}
        yield batch.filter(pa.array([p not in bad for p in range(len(batch))], pa.bool_()))


def _blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """Each block of items with its seeds, as a broadcast; needs one pass over the documents for each.

    Items of fewer words than a seed are a block of their own.
    """
    small_batches(docs.sparkSession)
    items = benchmark.where(F.length("text") > 0).select(F.col("item_id").cast("long"), "text").distinct()
    n_blocks = -(-items.count() // ITEMS)
    texts = docs.select(F.col("text"))
    context = docs.sparkSession.sparkContext
    for block in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).where("item_id is not null").collect()
        for known in Items.by_size(sorted((r[0], r[1]) for r in rows)):
            counted = texts.mapInArrow(partial(_count, context.broadcast(known)), "gram long, documents long")
            held = np.zeros(len(known.grams), np.int64)
            for gram, n in counted.groupBy("gram").agg(F.sum("documents")).collect():
                held[gram] = n
            yield context.broadcast(replace(known, held=held))


def contaminated(docs: DataFrame, benchmark: DataFrame, least_score: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, start_word, n_words, start_byte, n_bytes) of each test item found in a document.

    ``score`` is the best alignment over the item's words: 1 for a whole copy, 0.55 if three
    words in ten differ; copies that share no three words in a row with the item aren't looked at. Bytes are of the UTF-8
    text. One row per document row and item, with the best stretch, the earliest of equal ones. Words are runs of
    letters and digits, lower-cased in A-Z. Items or texts that are null, empty or without words are found
    nowhere, nor is an item without id; items of one or two words are found wherever those stand. Equal
    items of different ids are each found.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text"))
    out = docs.sparkSession.createDataFrame([], f"doc_id long, {FOUND}")
    for seeds in _blocks(docs, benchmark):
        out = out.union(rows.mapInArrow(partial(_search, seeds, least_score), f"doc_id long, {FOUND}"))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The documents in which no test item is found, with all their columns; see ``contaminated``."""
    out = docs
    schema = docs.schema
    for seeds in _blocks(docs, benchmark):
        out = out.mapInArrow(partial(_drop, seeds, least_score, docs.columns.index("text")), schema)
    return out
