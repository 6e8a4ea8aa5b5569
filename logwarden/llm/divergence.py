"""How far the word use of sources lies apart, per language, over run-length columns.

Term counts of each (language, source) group are a column over the language's vocabulary. The vocabulary
is reordered so that equal counts stand together, each column is run-length encoded, and a pair of
columns is compared by intersecting their run boundaries: the difference of a stretch times its length.
Columns are cut into blocks of the vocabulary and sources into tiles, so a task sees a bounded part of
a bounded number of columns whatever the number of terms or sources. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logwarden.llm.hashing import buffers, slices
from logwarden.llm.ordering import numbered
from logwarden.llm.tables import small_batches, whole_text
from logwarden.llm.terms import LETTERS, cut_words
from logwarden.operators.ranks import top_k_per_group
from logwarden.session import materialize

#: A term belongs to the vocabulary of a language from so many of its documents on; added to each count; terms reported.
LEAST_DOCUMENTS, PRIOR, TERMS = 30, 5, 50
SCALE = 1_000_000_000
#: Bytes of text that are counted at once; terms of a block; sources of a tile.
SLICE, BLOCK, TILE = 8_000_000, 8_192, 64
#: So many of a language's largest sources give the order of its vocabulary.
LEADING = 6


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of slices of texts: occurrences, and documents that have the term."""
    for batch in batches:
        pairs = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
        data, offsets = buffers(batch.column(2))
        for begin, end in slices(offsets, SLICE):
            own = offsets[begin:end + 1] - offsets[begin]
            words, bounds = cut_words(data[offsets[begin]:offsets[end]], own, LETTERS)
            if not len(words):
                continue
            coded = words.dictionary_encode()
            terms, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            names = pairs.slice(begin, end - begin).flatten()
            joined = [n.cast(pa.large_string()).dictionary_encode() for n in names]
            group = joined[0].indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(joined[1].dictionary) + joined[1].indices.to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(end - begin), np.diff(bounds))
            keys, n = np.unique(doc * len(terms) + codes, return_counts=True)
            cells, cell = np.unique(group[keys // len(terms)] * len(terms) + keys % len(terms), return_inverse=True)
            g = cells // len(terms)
            yield pa.RecordBatch.from_arrays([
                joined[0].dictionary.take(pa.array(g // len(joined[1].dictionary))).cast(pa.string()),
                joined[1].dictionary.take(pa.array(g % len(joined[1].dictionary))).cast(pa.string()),
                terms.take(pa.array(cells % len(terms))).cast(pa.string()),
                pa.array(np.bincount(cell, n, len(cells)).astype(np.int64)), pa.array(np.bincount(cell, minlength=len(cells)).astype(np.int64))],
                ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and the documents that have it."""
    small_batches(docs.sparkSession)
    rows = docs.select(whole_text("lang").alias("lang"), whole_text("source").alias("source"), whole_text().alias("text"))
    counts = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(cells: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """(lang, term, total, place): terms in at least ``least`` documents of the language, in an order that clusters equal counts.

    The order is by the counts in the language's largest groups, one after the other, then by the total.
    """
    by_size = W.partitionBy("lang").orderBy(F.desc("documents"), "source")
    leading = groups.withColumn("slot", F.row_number().over(by_size)).where(F.col("slot") <= LEADING).select("lang", "source", "slot")
    rows = cells.join(leading, ["lang", "source"], "left")
    slots = {f"slot{i}": F.coalesce(F.max(F.when(F.col("slot") == i, F.col("n"))), F.lit(0)) for i in range(1, LEADING + 1)}
    terms = rows.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), *[v.alias(k) for k, v in slots.items()])
    kept = terms.where(F.col("docs") >= least).drop("docs")
    return numbered(kept, [*slots, "total", "term"], ["lang"], "place").select("lang", "term", "total", "place")


def _share(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * size)) in whole numbers."""
    top = f"CAST({SCALE} AS DECIMAL(10, 0)) * (CAST({n} AS DECIMAL(20, 0)) + {PRIOR})"
    return F.expr(f"1 + ({top}) div (CAST({total} AS DECIMAL(20, 0)) + {PRIOR} * CAST(size AS DECIMAL(18, 0)))")


def column_runs(columns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, block, start, length, n): stretches of neighbouring places with the same count above 0, cut at blocks."""
    rows = columns.select("lang", "source", "place", "n", F.expr(f"place div {block}").alias("block"))
    order = W.partitionBy("lang", "source", "block").orderBy("place")
    new = F.coalesce((F.lag("place").over(order) != F.col("place") - 1) | (F.lag("n").over(order) != F.col("n")), F.lit(True))
    runs = rows.withColumn("run", F.sum(new.cast("int")).over(order))
    return runs.groupBy("lang", "source", "block", "run").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("length"), F.first("n").alias("n")).drop("run")


def _steps(start: np.ndarray, length: np.ndarray, p: np.ndarray, base: int, first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries of a column over one block and the value from each on; between the runs stands ``base``."""
    ends = start + length
    bounds = np.concatenate([[first], np.column_stack([start, ends]).ravel()])
    values = np.concatenate([[base], np.column_stack([p, np.full(len(p), base)]).ravel()])
    keep = np.append(bounds[1:] > bounds[:-1], True) & (bounds < first + size)
    return bounds[keep], values[keep]


def _compare(key: tuple, rows: pa.Table) -> pa.Table:
    """Sums of differences over one block, for pairs of one tile with another or of a tile with itself."""
    tiles = key[2].as_py(), key[3].as_py()
    rows = rows.sort_by([("no", "ascending"), ("start", "ascending")])
    no, start, length, p = (rows.column(c).to_numpy() for c in ("no", "start", "length", "p"))
    columns, first_rows = np.unique(no, return_index=True)
    ends = np.append(first_rows[1:], len(no))
    steps = {}
    for column, a, b in zip(columns.tolist(), first_rows, ends):  # start -1: the whole block, with the value of count 0
        first, size = rows.column("first")[int(a)].as_py(), int(length[a])
        steps[column] = _steps(start[a + 1:b], length[a + 1:b], p[a + 1:b], int(p[a]), first, size), first + size
    lefts, rights, sums = [], [], []
    for a in columns.tolist():
        for b in columns.tolist():
            if a >= b or not (a // TILE, b // TILE) == tiles:
                continue
            ((xs, xv), end), ((ys, yv), _) = steps[a], steps[b]
            bounds = np.union1d(xs, ys)
            f = np.abs(xv[np.searchsorted(xs, bounds, "right") - 1] - yv[np.searchsorted(ys, bounds, "right") - 1])
            lefts.append(a)
            rights.append(b)
            sums.append(int((f * np.diff(np.append(bounds, end))).sum()))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(sums), pa.string()), "a": pa.array(lefts, pa.int64()),
                     "b": pa.array(rights, pa.int64()), "value": pa.array(sums, pa.int64())})


def pair_sums(runs: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, a, b, value) by group numbers a < b: differences summed over the vocabulary.

    ``runs`` as of ``column_runs``; ``groups`` has lang, source, no, total, size and n_groups. Each column has
    one row per block that stands for its zeros; columns go to each pair of tiles that theirs is part of.
    """
    known = groups.where("size > 0")
    zeros = known.withColumn("block", F.explode(F.expr(f"sequence(0L, (size - 1) div {block})")))
    zeros = zeros.withColumn("first", F.col("block") * block).select(
        "lang", "no", "n_groups", "block", "first", F.lit(-1).cast("long").alias("start"),
        F.least(F.lit(block).cast("long"), F.col("size") - F.col("first")).alias("length"), _share("0", "total").alias("p"))
    full = runs.join(known, ["lang", "source"]).select(
        "lang", "no", "n_groups", "block", F.lit(0).cast("long").alias("first"), "start", "length", _share("n", "total").alias("p"))
    tile, last = F.expr(f"no div {TILE}"), F.expr(f"(n_groups - 1) div {TILE}")
    rows = zeros.unionByName(full).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.select("lang", "block", F.least(tile, "other").alias("left"), F.greatest(tile, "other").alias("right"), "no", "first", "start", "length", "p")
    sums = rows.groupBy("lang", "block", "left", "right").applyInArrow(_compare, "lang string, a long, b long, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, terms: int = TERMS, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): divergences of sources, and the terms that mark each source.

    Null text, lang and source count as ''. Terms are runs of letters, A-Z lower-cased; a language keeps
    those in at least ``least`` of its documents (rows), V in number. With N, the sum of the counts of
    kept terms, a term counted n times has the share p = 1 + floor(SCALE * (n + PRIOR) / (N + PRIOR * V)).
    Part ``pair``: every other source of the language as item, and the sum of abs(p - q) over the kept terms, 0
    if there is none. Part ``term``: kept terms that the source has and that have a larger share in it than
    in the language, with the difference, ``terms`` per source. Ranks are by value descending, then item.
    An empty table gives no row. Every group occurs, also one without text.
    """
    named = docs.select(whole_text("lang").alias("lang"), whole_text("source").alias("source"))
    groups = materialize(named.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents")), "groups")
    cells = materialize(term_counts(docs), "cells")
    words = materialize(vocabulary(cells, groups, least), "vocabulary")
    columns = materialize(cells.drop("docs").join(words, ["lang", "term"]), "columns")

    sizes = words.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("total").alias("lang_total"))
    totals = columns.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbers, all_groups = W.partitionBy("lang").orderBy("source"), W.partitionBy("lang")
    groups = groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").select(
        "lang", "source", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("size", "total", "lang_total")],
        (F.row_number().over(numbers) - 1).cast("long").alias("no"), F.count(F.lit(1)).over(all_groups).cast("long").alias("n_groups"))
    groups = materialize(groups, "groups")

    sums = pair_sums(column_runs(columns, block), groups, block)
    left, right = groups.select("lang", "source", "no"), groups.select("lang", F.col("source").alias("item"), F.col("no").alias("other"))
    pairs = left.join(right, "lang").where("source <> item").withColumns({"a": F.least("no", "other"), "b": F.greatest("no", "other")})
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    marks = columns.withColumnRenamed("total", "in_lang").join(groups, ["lang", "source"])
    marks = marks.withColumn("value", _share("n", "total") - _share("in_lang", "lang_total"))
    marks = marks.where("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return pairs.unionByName(top_k_per_group(marks, ["lang", "source"], [F.desc("value"), F.col("item")], terms))


def audit_sql() -> str:
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
vocabulary AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT row) >= {LEAST_DOCUMENTS}),
sizes AS (SELECT lang, count(*) AS size, sum(total) AS lang_total FROM vocabulary GROUP BY ALL),
cells AS (SELECT lang, source, term, count(*) AS n FROM words JOIN vocabulary USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
shares AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
    1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (coalesce(t.total, 0)::HUGEINT + {PRIOR} * s.size) AS p,
    1 + ({SCALE}::HUGEINT * (v.total + {PRIOR})) // (s.lang_total::HUGEINT + {PRIOR} * s.size) AS q
  FROM groups g JOIN vocabulary v USING (lang) JOIN sizes s USING (lang)
  LEFT JOIN sums t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM groups g JOIN groups h ON h.lang = g.lang AND h.source <> g.source LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b
    ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL) d
  ON d.lang = g.lang AND d.source = g.source AND d.item = h.source),
marks AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM marks QUALIFY rank <= {TERMS}
"""
