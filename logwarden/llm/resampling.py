"""Resampling documents to look like a target: array-scored weights, then a distributed quickselect.

Hashed word features of the documents and of the target texts are counted in one array each; the log
ratio of a bucket's shares is its gain, and a document's weight is the mean gain of its features. With
Gumbel noise on the weights the highest scores are a draw without replacement. The k-th score is found
without sorting: random pivot keys cut the rows that are left into parts, exact counts tell which part
holds the k-th key, until a pivot is that key. Only the winners are sorted and ranked.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logwarden.llm.hashing import buffers, slices
from logwarden.llm.ordering import numbered
from logwarden.llm.tables import small_batches, whole_text
from logwarden.llm.terms import LETTERS_DIGITS, cut_words, runs
from logwarden.session import materialize

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bytes of text that are cut at once, and pivots of one round.
SLICE, PIVOTS = 1_000_000, 15
#: The composite key, best first: the negative score, null ids last, then the columns that rows of one id may differ in.
KEY = ("worse", "without_id", "doc_key", "n_features", "weight")


def _features(texts: pa.Array, buckets: int, longest: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts: first and last document, words of each, and bucket and document of each feature."""
    data, offsets = buffers(texts)
    for begin, end in slices(offsets, SLICE):
        words, bounds = cut_words(data[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin], LETTERS_DIGITS)
        features, docs = runs(words, bounds, longest)
        coded = features.dictionary_encode()
        place = np.array([zlib.crc32(f.encode()) % buckets for f in coded.dictionary.to_pylist()], np.int64)
        yield begin, end, np.diff(bounds), place[coded.indices.to_numpy(zero_copy_only=False)], docs


def _count(buckets: int, longest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for _, _, _, place, _ in _features(batch.column(0), buckets, longest):
            total += np.bincount(place, minlength=buckets)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, text_column: str = "text") -> list[int]:
    """Features in each bucket over all texts; ``buckets`` numbers come to the driver."""
    rows = texts.select(F.col(text_column).alias("text")).mapInArrow(partial(_count, buckets, longest), "bucket long, n long")
    out = [0] * buckets
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 * ln) of the ratio of smoothed shares in the target and in the source, per bucket."""
    s_all, t_all = sum(source) + len(source), sum(target) + len(target)
    return np.array([math.floor(1000 * math.log(float((t + 1) * s_all) / float((s + 1) * t_all))) for s, t in zip(source, target)], np.int64)


def _weigh(gain: np.ndarray, longest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, n_words, place, docs in _features(batch.column(1), len(gain), longest):
            n = np.bincount(docs, minlength=end - begin)
            sums = np.zeros(end - begin, np.int64)
            np.add.at(sums, docs, gain[place])
            weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(begin, end - begin), *map(pa.array, (n_words.astype(np.int64), n.astype(np.int64), weight))],
                ["doc_id", "n_words", "n_features", "weight"])


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; a text without words has weight 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(partial(_weigh, gain, longest), "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """floor(1000 * Gumbel noise) of the row's id; a null id is noise of its own, as of an empty id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _before(pivot: tuple, inclusive: bool = False) -> Column:
    """Whether a row's key comes before the pivot, field by field."""
    out = F.lit(inclusive)
    for name, value in reversed(list(zip(KEY, pivot))):
        out = (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def _equal(pivot: tuple) -> Column:
    out = F.lit(True)
    for name, value in zip(KEY, pivot):
        out &= F.col(name) == value
    return out


def kth_key(rows: DataFrame, k: int, n: int, pivots: int = PIVOTS) -> tuple[tuple, int, int]:
    """The key that is k-th (from 1) among the ``n`` rows, how many rows come before it and how many have it.

    Each round draws ``pivots`` random keys of the rows left (by a hash, so that a lost task draws the same),
    counts the rows between, at and beside them, and goes on with the part that holds the k-th. Once
    no more rows are left than pivots, every key is a pivot and one of them is it.
    """
    low = high = None
    before, turn = 0, 0
    while True:
        left = rows
        if low is not None:
            left = left.where((F.col("worse") >= low[0]) & ~_before(low, inclusive=True))
        if high is not None:
            left = left.where((F.col("worse") <= high[0]) & _before(high))
        drawn = left.orderBy(F.xxhash64(*KEY, F.lit(turn)), *KEY).limit(pivots).select(*KEY).collect()
        cuts = sorted({tuple(r) for r in drawn})
        part = None
        for i, cut in enumerate(cuts):
            step, at = _before(cut), _equal(cut)
            part = F.when(step, 2 * i) if part is None else part.when(step, 2 * i)
            part = part.when(at, 2 * i + 1)
        counts = dict(left.groupBy(part.otherwise(2 * len(cuts)).alias("part")).count().collect())
        for i in range(2 * len(cuts) + 1):
            size = counts.get(i, 0)
            if before + size >= k:
                break
            before += size
        else:
            raise ValueError(f"there is no row {k} of {n}")
        if i % 2:
            return cuts[i // 2], before, size
        low = cuts[i // 2 - 1] if i else low
        high = cuts[i // 2] if i // 2 < len(cuts) else high
        turn += 1


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; rank counts the drawn ones from 1, else null.

    Of the N rows with at least ``least_words`` words floor(percent * N / 100) are drawn, highest scores
    first, ties to the smaller id (null ids last, then fewer features, then the lower weight). Rows that
    are equal in all of that are the same in the result; as many of them are drawn as there is room for.
    Null and empty texts have no feature and weight 0. ``target`` needs a column ``text``; with no target text
    each bucket counts as equally likely there. Tables may be empty.
    """
    small_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = weights(docs, gain, longest).withColumn("score", F.col("weight") + noise(seed))
    rows = materialize(scored.select(
        "doc_id", "n_words", "n_features", "weight", "score", (-F.col("score")).alias("worse"),
        F.col("doc_id").isNull().cast("int").alias("without_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_key")), "scores")
    fit = rows.where(F.col("n_words") >= least_words)
    n = fit.count()
    k = percent * n // 100
    result = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if k < 1:
        return rows.select(*result, none)
    key, before, same = kth_key(fit, k, n)
    drawn = numbered(fit.where(_before(key)), list(KEY), [], "place").select(*result, (F.col("place") + 1).alias("rank"))
    others = rows.where((F.col("n_words") < least_words) | ~_before(key, inclusive=True)).select(*result, none)
    # Rows with the k-th key are equal, so they are made from their number.
    worse, without_id, doc_key, n_features, weight = key
    place = F.col("id") + before + 1
    last = rows.sparkSession.range(same).select(
        F.lit(None if without_id else doc_key).cast("long").alias("doc_id"), F.lit(n_features).cast("long").alias("n_features"),
        F.lit(weight).cast("long").alias("weight"), F.lit(-worse).cast("long").alias("score"), F.when(place <= k, place).alias("rank"))
    return drawn.unionByName(others).unionByName(last)


def resample_sql() -> str:
    return f"""
WITH table_of AS (SELECT list(c ORDER BY i) AS entries FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, r: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))),
docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
words AS (SELECT row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM (SELECT row, text FROM docs UNION ALL SELECT -item_id - 1, text FROM benchmark)),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)),
crcs AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
  lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM hexed, table_of),
placed AS (SELECT row, bucket FROM words JOIN crcs USING (word)),
counts AS (SELECT bucket, count(*) FILTER (row > 0) AS s, count(*) FILTER (row < 0) AS t FROM placed GROUP BY ALL),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + {BUCKETS}))::DOUBLE / ((s + 1) * (t_all + {BUCKETS}))::DOUBLE))::BIGINT AS gain
  FROM counts, (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts)),
weighed AS (SELECT row, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE row > 0 GROUP BY ALL),
scored AS (SELECT row, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (row)),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (row)
"""
