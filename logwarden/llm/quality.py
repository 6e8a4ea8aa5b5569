"""Document quality by naive Bayes support vectors.

Indicators of byte n-grams are scaled by the log-ratio of their counts in the two classes; a linear
hinge-loss model over them is fitted by dual coordinate descent, and its margin is turned into a
probability on documents that took no part in the fit.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logwarden.llm.hashing import IS_SPACE, buffers, mix, sequences, slices, words
from logwarden.llm.labelled import fit_in_one_task, labelled_sample
from logwarden.llm.tables import held_out

BUCKETS = 1 << 18
SAMPLE = 4_000
#: Lengths of the byte n-grams.
GRAMS = (2, 3, 4)
_KIND = np.array([0 if IS_SPACE[b] else 1 if chr(b).islower() and b < 128 else 2 if chr(b).isupper() and b < 128
                  else 3 if chr(b).isdigit() and b < 128 else 4 if b < 128 else 5 for b in range(256)])


def indicators(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's different features, as (feature, document), by document.

    Features are its byte n-grams and, as further indicators, the tenths in which the shares of
    capitals, digits and signs among its bytes, of repeated word triples among all, and of words that
    repeat the one before lie.
    """
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    features, owners = [], []
    gram = data.astype(np.uint64)
    for k in range(1, max(GRAMS)):
        if len(data) <= k:
            break
        gram = gram[:-1] * np.uint64(257) + data[k:]
        if k + 1 in GRAMS:
            inside = doc[:-k] == doc[k:]
            features.append(mix(gram[inside] * np.uint64(8) + np.uint64(k)))
            owners.append(doc[:-k][inside])
    shares = np.zeros((n, 5))
    for i, kind in enumerate((2, 3, 4)):
        shares[:, i] = np.bincount(doc, _KIND[data] == kind, minlength=n) / np.maximum(size, 1)
    hashes, _, bounds = words(data, offsets)
    runs, run_docs, _ = sequences(hashes, bounds, 3)
    order = np.lexsort((runs, run_docs))
    again = (runs[order][1:] == runs[order][:-1]) & (run_docs[order][1:] == run_docs[order][:-1])
    shares[:, 3] = np.bincount(run_docs[order][1:][again], minlength=n) / np.maximum(np.bincount(run_docs, minlength=n), 1)
    word_docs = np.repeat(np.arange(n), np.diff(bounds))
    twice = (hashes[1:] == hashes[:-1]) & (word_docs[1:] == word_docs[:-1])
    shares[:, 4] = np.bincount(word_docs[1:][twice], minlength=n) / np.maximum(np.diff(bounds), 1)
    level = np.ceil(shares * 10).astype(np.uint64) + np.arange(5, dtype=np.uint64) * np.uint64(16)
    features.append(mix(level.reshape(-1) + np.uint64(1 << 40)))
    owners.append(np.repeat(np.arange(n), 5))
    feature = (np.concatenate(features) & np.uint64(BUCKETS - 1)).astype(np.int64)
    pair = np.concatenate(owners) * BUCKETS + feature
    pair.sort()
    pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
    return pair & (BUCKETS - 1), pair >> 18


def _collect(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = buffers(column)
    for begin, end in slices(offsets, 1_000_000):
        yield begin, end, *indicators(data[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin])


def descend(rows: list[np.ndarray], scale: np.ndarray, sign: np.ndarray, cost: float, rounds: int) -> np.ndarray:
    """Weights of a hinge-loss model over unit-length rows, by dual coordinate descent.

    Row i has the value ``scale[f]`` in its features f, over the row's length. The last weight
    is that of a constant 1.
    """
    weight = np.zeros(len(scale) + 1)
    dual = np.zeros(len(rows))
    lengths = np.array([max(np.sqrt((scale[f] ** 2).sum()), 1e-9) for f in rows])
    order = np.arange(len(rows))
    for turn in range(rounds):
        np.random.default_rng(turn).shuffle(order)
        most = 0.0
        for i in order:
            f, y = rows[i], sign[i]
            slope = y * ((weight[f] @ scale[f]) / lengths[i] + weight[-1]) - 1
            then = min(max(dual[i] - slope / 2, 0.0), cost)  # each row with its constant has squared length 2
            if then != dual[i]:
                step = (then - dual[i]) * y
                weight[f] += step / lengths[i] * scale[f]
                weight[-1] += step
                most = max(most, abs(then - dual[i]))
                dual[i] = then
        if most < 1e-3:
            break
    return weight


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by Newton steps on smoothed targets."""
    good = y.sum()
    target = np.where(y, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margin).sum() + 1e-3 * slope, (p - target).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - np.clip(step[0], -5, 5), offset - np.clip(step[1], -5, 5)
    return max(slope, 0.0), offset


def fit(rows: pa.Table, cost: float = 1.0, rounds: int = 20, smoothing: float = 1.0) -> bytes:
    """Weights per bucket (already scaled), a constant, and the calibration."""
    y = rows.column("label").to_numpy().astype(bool)
    features: list[np.ndarray] = []
    for begin, end, feature, doc in _collect(rows.column("text")):
        features += np.split(feature.astype(np.int32), np.cumsum(np.bincount(doc, minlength=end - begin))[:-1])

    def model(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.full((2, BUCKETS), smoothing)
        for i in chosen:
            counts[int(y[i]), features[i]] += 1
        scale = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        scale[counts.sum(0) <= 2 * smoothing + 1] = 0  # a feature of one document says nothing about others
        return scale, descend([features[i] for i in chosen], scale, np.where(y[chosen], 1.0, -1.0), cost, rounds)

    def margins(scale: np.ndarray, weight: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        return np.array([(weight[f] @ scale[f]) / max(np.sqrt((scale[f] ** 2).sum()), 1e-9) + weight[-1]
                         for f in (features[i] for i in chosen)])

    everyone = np.arange(len(y))
    if y.all() or not y.any():
        scale, weight, curve = np.zeros(BUCKETS), np.zeros(BUCKETS + 1), (0.0, 30.0 if y.all() else -30.0)
    else:
        apart = everyone % 4 == 3
        if len(set(y[apart])) == 2 and len(set(y[~apart])) == 2:
            curve = _calibrate(margins(*model(everyone[~apart]), everyone[apart]), y[apart])
        else:
            curve = (4.0, 0.0)
        scale, weight = model(everyone)
    out = io.BytesIO()
    np.savez_compressed(out, scale=scale.astype(np.float32), weight=weight.astype(np.float32), curve=np.array(curve))
    return out.getvalue()


class Model:
    def __init__(self, stored: bytes):
        with np.load(io.BytesIO(stored)) as parts:
            scale, weight = parts["scale"].astype(np.float64), parts["weight"].astype(np.float64)
            self.slope, self.offset = parts["curve"]
        self.product, self.square, self.constant = scale * weight[:-1], scale * scale, weight[-1]

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for begin, end, feature, doc in _collect(column):
            length = np.sqrt(np.bincount(doc, self.square[feature], minlength=end - begin))
            margin = np.bincount(doc, self.product[feature], minlength=end - begin) / np.maximum(length, 1e-9) + self.constant
            out[begin:end] = 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))
        return out


def _score(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = Model(shared.value) if shared is not None else None
    for batch in batches:
        text, kept = batch.column(batch.num_columns - 1), batch.select(list(range(batch.num_columns - 1)))
        score = model.score(text) if model else np.full(len(text), 0.5)
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(score)], [*kept.schema.names, "score"])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> bytes | None:
    """Trains on at most ``sample`` labelled documents outside the held-out fifth."""
    return fit_in_one_task(labelled_sample(docs, labels, label, sample), fit)


def score(docs: DataFrame, model: bytes | None, id_column: str = "doc_id", text_column: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """Each row's ``keep`` columns (default: the id) with ``score`` (0 to 1, higher is better).

    Rows are kept one for one. A null text counts as empty; an empty text has only the
    indicators of its shape. Without a model (no labelled rows) every score is 0.5; if all labels
    are the same, every score says so. Rows equal in text score alike.
    """
    columns = [id_column] if keep is None else keep
    rows = docs.select(*columns, F.col(text_column).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(model) if model is not None else None
    return rows.mapInArrow(partial(_score, shared), f"{schema}, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
