"""Bounded samples of labelled documents, and models fitted on them in one task."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logwarden.llm.tables import held_out, whole_text


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents outside the held-out fifth.

    Chosen in the order of a hash of the id, so they are spread over the table and the same
    each time, also where ids repeat. The bound makes it right to broadcast their ids, which spares a shuffle of the
    texts. Rows without id or label don't count; an id with several labels has the largest.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(most)


def fit_in_one_task(sample: DataFrame, fit: Callable[[pa.Table], bytes]) -> bytes | None:
    """The model that ``fit`` makes of a bounded sample, as bytes; None of an empty one."""
    def task(rows):
        return _fitted(fit, rows)

    rows = sample.groupBy(F.lit(0).alias("all")).applyInArrow(task, "model binary").collect()
    return bytes(rows[0][0]) if rows else None


def _fitted(fit, rows):
    """Fits on rows in the order of id and text, whatever order they came in."""
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return pa.table({"model": pa.array([fit(rows)], pa.binary())})
