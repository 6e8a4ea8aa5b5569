"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order in which it sees a fixed set of pivots, nearest first. It is
posted in the files of its nearest pivots; a query looks into the files of its own nearest pivots,
ranks what it finds by the footrule distance of the two orders, and takes the exact cosine of the
best share of each file.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from logwarden.session import materialize

#: Pivots; files a vector is posted in; files a query opens.
PIVOTS, POSTED, OPENED = 64, 2, 32
#: Share of each file that is compared exactly, and how many vectors at least.
SHARE, LEAST = 0.25, 64
#: Vectors, and queries, that a task holds at once.
HOLD = 20_000
ORDERED = "vec_id long, vector binary, seen binary, files array<int>"
NEAR = "query_id long, vec_id long, score double"


def _usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v) of vectors that have a direction, all of the most frequent length."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null")
    sound = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    length = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sound.where(F.size("v") == (length[0] if length else 0))


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that neither squares nor their sum overflow or vanish."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _order(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pivots = shared.value
    for batch in batches:
        if not len(batch):
            continue
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        rows = flat.reshape(len(batch), -1)
        order = np.argsort(-(_unit(rows) @ pivots.T), axis=1, kind="stable")
        seen = np.argsort(order, axis=1).astype(np.uint8)
        width = order.shape[1]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([r.tobytes() for r in seen], pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * width, pa.int32()), pa.array(order.reshape(-1), pa.int32()))],
            ["vec_id", "vector", "seen", "files"])


def _search_file(k: int, share: float, least: int, rows):
    """The nearest k of a file for each query that opens it."""
    asks = rows.column("asks").to_numpy()
    ids = rows.column("vec_id").to_numpy()
    seen = np.frombuffer(b"".join(rows.column("seen").to_pylist()), np.uint8).reshape(len(ids), -1).astype(np.int16)
    vectors = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.float64).reshape(len(ids), -1)
    unit = _unit(vectors)
    file, out = np.flatnonzero(~asks), []
    file = file[np.argsort(ids[file], kind="stable")]
    file_ids, file_seen, file_unit = ids[file], seen[file], unit[file]
    taken = min(len(file), max(least, int(np.ceil(share * len(file)))))
    for q in np.flatnonzero(asks) if len(file) else []:
        near = np.arange(len(file))
        if taken < len(file):
            footrule = np.abs(file_seen - seen[q]).sum(1, dtype=np.int64)
            near = np.argpartition(footrule * len(file) + near, taken - 1)[:taken]  # the file is sorted by id, so equal orders go by id
        near = np.sort(near[file_ids[near] != ids[q]])
        score = (file_unit[near] * unit[q]).sum(1)  # of equal vectors equal to the last bit, wherever they are
        order = np.lexsort((file_ids[near], -score))
        best = order[np.sort(np.unique(file_ids[near][order], return_index=True)[1])[:k]]  # equal ids count once
        out += [(int(ids[q]), int(file_ids[near[b]]), float(score[b])) for b in best]
    columns = list(zip(*out)) or [[]] * 3
    return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})


def _search(index: DataFrame, queries: DataFrame, k: int, posted: int, opened: int, share: float = SHARE) -> DataFrame:
    """Pairs of query and near vector from all files opened; a pair may come from several."""
    post = index.select("vec_id", "vector", "seen", F.explode(F.slice("files", 1, posted)).alias("file"))
    ask = queries.select("vec_id", "vector", "seen", F.explode(F.slice("files", 1, opened)).alias("file"))
    # Large files are split, and so are many queries of one file: every part meets every part.
    parts = {side: {r[0]: -(-r[1] // HOLD) for r in rows.groupBy("file").count().collect()} for side, rows in (("post", post), ("ask", ask))}

    def split(rows: DataFrame, own: dict, other: dict, mine: str, theirs: str, asks: bool) -> DataFrame:
        of = lambda d: F.coalesce(F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("file")], F.lit(1)) if d else F.lit(1)
        return rows.select("file", F.pmod(F.xxhash64("vec_id"), of(own)).cast("int").alias(mine),
                           F.explode(F.sequence(F.lit(0), (of(other) - 1).cast("int"))).alias(theirs), F.lit(asks).alias("asks"), "vec_id", "vector", "seen")

    both = split(post, parts["post"], parts["ask"], "p", "a", False).unionByName(split(ask, parts["ask"], parts["post"], "a", "p", True))
    step = partial(_search_file, k, share, LEAST)

    def task(rows):
        return step(rows)

    return both.groupBy("file", "p", "a").applyInArrow(task, NEAR)


def _top(near: DataFrame, k: int) -> DataFrame:
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding",
            pivots: int = PIVOTS, posted: int = POSTED, opened: int = OPENED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query that the index finds.

    Pivots are ``pivots`` of the vectors, chosen by a hash of the id; every vector is indexed.
    Candidates are all vectors but those of the query's own id; rows of equal ids count once, by
    their best score; ties go to the smaller id. A query that finds fewer than k opens all files
    and compares all of them exactly, so that it has k results if there are k candidates. Vectors
    that are null, zero, of another length than most, or hold null or non-finite components take no
    part, nor do rows without id.
    """
    spark = vectors.sparkSession
    sound = _usable(vectors, id_column, vector_column)
    sample = sound.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(_unit(np.array([r[1] for r in sample])))
    index = materialize(sound.mapInArrow(partial(_order, shared), ORDERED), "index")
    asked = index.join(queries.select(F.col(id_column).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    near = materialize(_top(_search(index, asked, k, posted, opened), k), "near")
    done = near.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = materialize(asked.join(done, "vec_id", "left_anti"), "short")
    if not short.isEmpty():
        again = _top(_search(index, short, k, 1, len(sample), 1.0), k)
        near = near.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
