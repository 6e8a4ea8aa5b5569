"""Toxicity by multiple-instance learning.

A document is toxic if at least one of its sentences is. Only documents carry labels, so a
sentence's probability is a logistic function of its words, a document's is the noisy-or of its
sentences, and the weights are trained through that from the labels of documents. Afterwards the
sentences that made a document toxic are at hand.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logwarden.llm.hashing import IS_SIGN, WORD_VALUE, buffers, mix, slices, words
from logwarden.llm.labelled import fit_in_one_task, labelled_sample
from logwarden.llm.tables import held_out, small_batches

BUCKETS = 1 << 19
SAMPLE = 8_000
#: Lengths of the beginnings of words that are features.
HEADS = (4, 5, 6, 7)
#: A sentence ends at one of these bytes: full stop, exclamation mark, question mark, line feed.
_ENDS = np.isin(np.arange(256), list(b".!?\n"))
SENTENCE = "array<struct<start:int,bytes:int,score:double>>"
SCORED = f"score double, n_sentences int, sentences {SENTENCE}"


def instances(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Features of each sentence: (feature, its sentence), the first byte and length of each
    sentence that has words, and the document of each sentence.

    Features are the sentence's words and how they begin (4 to 7 bytes, so that inflected and
    compound forms share them), hashed into buckets.
    """
    hashes, starts, bounds = words(data, offsets, IS_SIGN, WORD_VALUE)
    if not len(hashes):
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing, nothing, nothing
    ends = np.flatnonzero(_ENDS[data])
    stretch = np.searchsorted(ends, starts)  # how many ends come before the word
    docs = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    new = np.ones(len(hashes), bool)
    new[1:] = (stretch[1:] != stretch[:-1]) | (docs[1:] != docs[:-1])
    sentence = np.cumsum(new) - 1
    first = starts[new]
    last = np.concatenate([first[1:], [len(data)]])
    last = np.minimum(last, offsets[docs[new] + 1])
    close = np.searchsorted(ends, first)
    stop = np.where(close < len(ends), ends[np.minimum(close, len(ends) - 1)] + 1 if len(ends) else last, last)
    features, owners = [hashes], [sentence]
    head, at, alive = np.zeros(len(hashes), np.uint64), starts, np.arange(len(hashes))
    for k in range(1, HEADS[-1] + 1):
        inside = (at < len(data)) & (at < offsets[docs[alive] + 1])
        at, alive, head = at[inside], alive[inside], head[inside]
        inside = ~IS_SIGN[data[at]]
        at, alive, head = at[inside], alive[inside], head[inside]
        head = mix(head * np.uint64(31) + WORD_VALUE[data[at]] + np.uint64(k))
        at = at + 1
        if k in HEADS:
            features.append(head)
            owners.append(sentence[alive])
    feature = np.concatenate(features) & np.uint64(BUCKETS - 1)
    owner = np.concatenate(owners)
    return feature.astype(np.int64), owner, first, np.minimum(stop, last) - first, docs[new]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _descend(column: np.ndarray, owner: np.ndarray, document: np.ndarray, y: np.ndarray, n_sentences: int,
             weight: np.ndarray, bias: float, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient with a step that halves whenever the loss would rise."""
    n_docs = len(y)
    worded = np.bincount(document, minlength=n_docs) > 0

    def loss(weight: np.ndarray, bias: float) -> tuple[float, np.ndarray, np.ndarray]:
        z = np.clip(bias + np.bincount(owner, weight[column], minlength=n_sentences), -30, 30)
        total = np.clip(np.bincount(document, _softplus(z), minlength=n_docs), 1e-4, None)
        each = np.where(y, -np.log(-np.expm1(-total)), total)
        return float(each[worded].sum()) / n_docs + penalty * np.abs(weight).sum(), z, total

    def slopes(z: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, float]:
        pull = np.where(y, -1 / np.expm1(np.minimum(total, 50)), 1.0) / n_docs
        each = pull[document] / (1 + np.exp(-z))
        return np.bincount(column, each[owner], minlength=len(weight)), float(each.sum())

    ahead, ahead_bias, momentum, rate = weight, bias, 1.0, 4.0
    now, z, total = loss(weight, bias)
    for _ in range(steps):
        step, bias_step = slopes(z, total)
        moved = ahead - rate * step
        moved = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
        moved_bias = ahead_bias - 0.05 * rate * bias_step
        then = loss(moved, moved_bias)[0]
        if then > now + 1e-9:
            if rate < 1e-6:
                break
            rate, ahead, ahead_bias, momentum = rate / 2, weight, bias, 1.0
        else:
            following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
            push = (momentum - 1) / following
            ahead, ahead_bias = moved + push * (moved - weight), moved_bias + push * (moved_bias - bias)
            weight, bias, momentum, rate, now = moved, moved_bias, following, rate * 1.2, then
        _, z, total = loss(ahead, ahead_bias)
    return weight, bias


def fit(rows: pa.Table, steps: int = 150, sparsity: float = 2.0, least: int = 3) -> bytes:
    """Weights per bucket and a bias, by accelerated proximal gradient on the noisy-or likelihood.

    Starts from the log-ratio of document counts, so that sentences differ from the first step
    on. ``sparsity``, in documents, is the pull of a feature towards no weight; those in fewer
    than ``least`` training documents have none.
    """
    data, offsets = buffers(rows.column("text"))
    y = rows.column("label").to_numpy().astype(bool)
    # First the counts of documents, then the places of the features that have enough: few of all features do.
    seen, bad = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for begin, end in slices(offsets):
        f, o, _, _, d = instances(data[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin])
        pair = np.unique(f * (end - begin) + d[o])
        seen += np.bincount(pair // (end - begin), minlength=BUCKETS)
        bad += np.bincount((pair // (end - begin))[y[begin:end][pair % (end - begin)]], minlength=BUCKETS)
    names = np.flatnonzero(bad >= least)
    place = np.full(BUCKETS, -1, np.int32)
    place[names] = np.arange(len(names))
    column, owner, document, done = [], [], [], 0
    for begin, end in slices(offsets):
        f, o, _, _, d = instances(data[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin])
        used = place[f] >= 0
        column.append(place[f[used]])
        owner.append((o[used] + done).astype(np.int32))
        document.append((d + begin).astype(np.int32))
        done += len(d)
    column, owner, document = map(np.concatenate, (column, owner, document))
    n_docs, n_bad = len(y), int(y.sum())
    ratio = np.log((bad[names] + 0.5) / (n_bad + 1)) - np.log((seen[names] - bad[names] + 0.5) / (n_docs - n_bad + 1))
    weight, bias = np.maximum(ratio - 1, 0), -6.0
    # First few features, then those few without the pull that keeps them few.
    for pull, rounds in ((sparsity, steps), (sparsity / 100, 3 * steps)):
        weight, bias = _descend(column, owner, document, y, done, weight, bias, pull / n_docs, rounds)
        kept = np.flatnonzero(weight)
        place = np.full(len(weight), -1, np.int32)
        place[kept] = np.arange(len(kept))
        alive = place[column] >= 0
        column, owner, names, weight = place[column[alive]], owner[alive], names[kept], weight[kept]
    whole = np.zeros(BUCKETS, np.float32)
    whole[names] = weight
    out = io.BytesIO()
    np.savez_compressed(out, weight=whole, bias=np.array([bias]))
    return out.getvalue()


class Model:
    def __init__(self, stored: bytes):
        with np.load(io.BytesIO(stored)) as parts:
            self.weight, self.bias = parts["weight"].astype(np.float64), float(parts["bias"][0])

    def score(self, column: pa.Array, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        """Per slice of documents: probability, number of sentences, and the offending sentences."""
        data, offsets = buffers(column)
        for begin, end in slices(offsets):
            n = end - begin
            feature, owner, first, size, document = instances(
                data[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin])
            z = np.clip(self.bias + np.bincount(owner, self.weight[feature], minlength=len(document)), -30, 30)
            total = np.bincount(document, _softplus(z), minlength=n)
            chance = 1 / (1 + np.exp(-z))
            score = -np.expm1(-total)
            # Of a document over the threshold, the sentences over it, or else the worst one.
            best = np.zeros(n)
            np.maximum.at(best, document, chance)
            hit = np.flatnonzero((score[document] >= threshold) & ((chance >= threshold) | (chance >= best[document])))
            place = first[hit] - (offsets[begin:end] - offsets[begin])[document[hit]]
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.bincount(document[hit], minlength=n))]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(size[hit], pa.int32()), pa.array(chance[hit])],
                                           ["start", "bytes", "score"]))
            yield score, np.bincount(document, minlength=n), lists


def _score(shared, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = Model(shared.value) if shared is not None else None
    for batch in batches:
        text, begin = batch.column(batch.num_columns - 1), 0
        kept = batch.select(list(range(batch.num_columns - 1)))
        for score, n, lists in model.score(text, threshold) if model else _unknown(len(text)):
            rows = kept.slice(begin, len(score))
            begin += len(score)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(score, pa.float64()), pa.array(n, pa.int32()), lists],
                [*rows.schema.names, "score", "n_sentences", "sentences"])


def _unknown(n: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("bytes", pa.int32()), ("score", pa.float64())]))
    yield np.zeros(n), np.zeros(n, np.int64), pa.array([[]] * n, kind)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> bytes | None:
    """Trains on at most ``sample`` labelled documents outside the held-out fifth."""
    return fit_in_one_task(labelled_sample(docs, labels, label, sample), fit)


def score(docs: DataFrame, model: bytes | None, threshold: float = 0.5, id_column: str = "doc_id",
          text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row's ``keep`` columns (default: the id) with ``score`` (0 to 1), ``n_sentences`` and
    ``sentences``: start and length in bytes of the UTF-8 text and the probability of each
    offending sentence, empty below ``threshold``.

    Rows are kept one for one. A text that is null, empty or without words has no sentence and
    scores 0, as all do without a model (no labelled rows). Rows equal in text score alike.
    """
    small_batches(docs.sparkSession)
    columns = [id_column] if keep is None else keep
    rows = docs.select(*columns, F.col(text_column).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(model) if model is not None else None
    return rows.mapInArrow(partial(_score, shared, threshold), f"{schema}, {SCORED}")


def _reject(shared, threshold: float, text: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = Model(shared.value)
    for batch in batches:
        score = np.concatenate([s for s, _, _ in model.score(batch.column(text), threshold)] or [np.zeros(0)])
        yield batch.filter(pa.array(score < threshold))


def reject(docs: DataFrame, model: bytes | None, threshold: float = 0.5, text_column: str = "text") -> DataFrame:
    """The documents that score below ``threshold``, with all their columns; all, without a model."""
    if model is None:
        return docs
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_reject, shared, threshold, docs.columns.index(text_column)), docs.schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score, predicted, and how many sentences offend and where the worst is."""
    worst = F.expr("array_max(transform(sentences, s -> struct(s.score as score, -s.start as back, s.bytes as bytes)))")
    return score(docs, learn(docs, labels)).select(
        F.col("doc_id"), held_out().alias("held_out"), F.col("score"),
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("n_sentences"),
        F.size("sentences").alias("n_offending"), (-worst["back"]).alias("worst_start"), worst["bytes"].alias("worst_bytes"))
