"""Language identification of mixed text.

The script of a word (its range of code points) narrows down which languages it may be in. Each
candidate scores the word by its byte n-grams and as a whole. Viterbi over the words, with a
penalty for each switch, labels spans; the language with the most letters names the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from logwarden.llm.hashing import buffers, byte_tables, slices, words
from logwarden.llm.tables import held_out

BUCKETS = 1 << 16
#: Documents that each language learns from, about, and how many languages there may be.
SAMPLE, LANGUAGES = 1_500, 200
SWITCH = 12.0
#: Between words: ASCII characters that are no letters.
NO_LETTER, LETTER_VALUE = byte_tables(np.array([b < 128 and not chr(b).isalpha() for b in range(256)]))
#: First bytes of the UTF-8 forms of script ranges: Latin with its supplements, Greek, Cyrillic,
#: Armenian and Hebrew, Arabic and its neighbours, South Asia, South-East Asia and Georgian, signs,
#: East Asia, Hangul, all beyond.
SCRIPT_STARTS = np.array([0x00, 0xCD, 0xD0, 0xD5, 0xD8, 0xE0, 0xE1, 0xE2, 0xE3, 0xEA, 0xEE])
FOUND = "lang_pred string, score double, spans array<struct<lang:string,start:int,bytes:int>>"


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """N-gram bucket of each byte (the extra last one between words), and each word's bucket,
    first byte, script and the words before each document."""
    hashes, starts, bounds = words(data, offsets, NO_LETTER, LETTER_VALUE)
    clean = np.where(NO_LETTER[data], 0, data).astype(np.uint64)
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    back, gram = clean, clean.copy()
    for k in range(1, 4):
        before = np.concatenate([np.zeros(1, np.uint64), back[:-1]])
        before[heads] = 0
        if k > 1:
            before[back == 0] = 0
        gram += before << np.uint64(8 * k)
        back = before
    gram = (gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)
    gram[clean == 0] = BUCKETS
    script = np.zeros(len(starts), np.int64)
    if len(starts):
        script = np.searchsorted(SCRIPT_STARTS, np.maximum.reduceat(clean, starts).astype(np.int64), "right") - 1
        # Continuation bytes lie below first bytes, so the largest byte of a word starts its highest character.
    return gram, (hashes >> np.uint64(48)).astype(np.int64), starts, script, bounds


LEARNED = "lang string, grams binary, words binary, scripts binary"


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        tags = batch.column(0).dictionary_encode()
        names, tag = tags.dictionary.to_pylist(), tags.indices.to_numpy()
        data, offsets = buffers(pc.utf8_lower(batch.column(1)))
        for begin, end in slices(offsets):
            part = offsets[begin:end + 1] - offsets[begin]
            gram, word, _, script, bounds = _features(data[offsets[begin]:offsets[end]], part)
            by_byte, by_word = np.repeat(tag[begin:end], np.diff(part)), np.repeat(tag[begin:end], np.diff(bounds))
            for t in np.unique(tag[begin:end]):
                mine = by_word == t
                sums = totals.setdefault(names[t], [np.zeros(BUCKETS + 1), np.zeros(BUCKETS), np.zeros(len(SCRIPT_STARTS))])
                sums[0] += np.bincount(gram[by_byte == t], minlength=BUCKETS + 1)
                sums[1] += np.bincount(word[mine], minlength=BUCKETS)
                sums[2] += np.bincount(script[mine], minlength=len(SCRIPT_STARTS))
    for name, sums in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([name]), *[pa.array([s.tobytes()], pa.binary()) for s in sums]],
                                         ["lang", "grams", "words", "scripts"])


def _total(rows):
    sums = [sum(np.frombuffer(x) for x in rows.column(c).to_pylist()) for c in ("grams", "words", "scripts")]
    return pa.table({"lang": rows.column("lang")[:1], **{c: pa.array([s.tobytes()], pa.binary()) for c, s in zip(("grams", "words", "scripts"), sums)}})


@dataclass
class Model:
    names: list[str]
    grams: np.ndarray  # language x bucket, log-probabilities; 0 between words
    words: np.ndarray
    candidates: np.ndarray  # script x language


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from about ``sample`` documents of each language, chosen by a hash of the id.

    Reads text and non-null lang of documents outside the held-out fifth, nothing else. More
    than LANGUAGES languages are an error.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return Model([], np.zeros((0, BUCKETS + 1)), np.zeros((0, BUCKETS)), np.zeros((len(SCRIPT_STARTS), 0), bool))
    share = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, sample / n))])
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.where(chance < share[F.col("lang")]).select("lang", "text")
    rows = chosen.mapInArrow(_learn, LEARNED).groupBy("lang").applyInArrow(_plain(_total), LEARNED).collect()
    rows = sorted(rows, key=lambda r: r["lang"])
    grams, whole, scripts = (np.array([np.frombuffer(r[c]) for r in rows]) for c in ("grams", "words", "scripts"))
    scripts = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
    candidates = (scripts >= 0.005).T
    candidates[~candidates.any(1)] = True
    grams[:, -1] = 0
    log = lambda x, a: np.log((x + a) / (x.sum(1, keepdims=True) + a * BUCKETS))
    grams = log(grams, 0.1)
    grams[:, -1] = 0
    return Model([r["lang"] for r in rows], grams.astype(np.float32), log(whole, 0.1).astype(np.float32), candidates)


def _plain(step):
    def task(rows):
        return step(rows)

    return task


def viterbi(scores: np.ndarray, switch: float) -> list[int]:
    """The best language of each word, where every change of language costs ``switch``."""
    rows = scores.tolist()
    state, back = rows[0], []
    for row in rows[1:]:
        top = max(state)
        best, floor = state.index(top), top - switch
        back.append([best if s < floor else i for i, s in enumerate(state)])
        state = [r + (floor if s < floor else s) for r, s in zip(row, state)]
    path = [state.index(max(state))]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def _one_span(scores: np.ndarray, bounds: np.ndarray, best: np.ndarray, switch: float) -> np.ndarray:
    """Documents that are surely one span: no stretch gains as much as half a switch costs in any other language.

    Every switch then costs more than the two stretches beside it can gain.
    """
    n, total = len(bounds) - 1, len(scores)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    own = scores[np.arange(total), best[doc]]
    worth = np.zeros(n)
    for language in range(scores.shape[1]):
        sums = np.concatenate([[0.0], np.cumsum(scores[:, language] - own)])
        drop = (sums.max() - sums.min() + 1.0) * doc  # each document lies below all before it
        least = np.minimum.accumulate(sums[:-1] - drop) + drop
        np.maximum.at(worth, doc, sums[1:] - least)
    return worth < switch / 2


def _label(shared, switch: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    n_lang = len(model.names)
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        keep = batch.select(list(range(batch.num_columns - 1)))
        lower = pc.utf8_lower(column)
        lettered = pc.fill_null(pc.match_substring_regex(lower, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        data, offsets = buffers(lower)
        names, shares, spans = [], [], []
        for begin, end in slices(offsets):
            part = offsets[begin:end + 1] - offsets[begin]
            gram, word, starts, script, bounds = _features(data[offsets[begin]:offsets[end]], part)
            raw = data[offsets[begin]:offsets[end]]
            # Letters before each byte: bytes that start a character and are no ASCII sign.
            before = np.concatenate([[0], np.cumsum((raw & 0xC0 != 0x80) & ~NO_LETTER[raw])])
            scores = np.zeros((len(starts), n_lang))
            for language in range(n_lang if len(starts) else 0):
                scores[:, language] = np.add.reduceat(model.grams[language][gram], starts) + model.words[language][word]
            scores[~model.candidates[script]] -= 100.0
            sums = np.concatenate([np.zeros((1, n_lang)), np.cumsum(scores, 0)])[bounds]
            totals = sums[1:] - sums[:-1]
            best = totals.argmax(1) if n_lang else np.zeros(end - begin, np.int64)
            simple = _one_span(scores, bounds, best, switch) if n_lang else np.ones(end - begin, bool)
            for d in range(end - begin):
                first, last = bounds[d], bounds[d + 1]
                if not lettered[begin + d] or first == last or not n_lang:
                    names.append("und")
                    shares.append(0.0)
                    spans.append([])
                    continue
                ends = np.concatenate([starts[first + 1:last], part[d + 1:d + 2]])
                if simple[d]:
                    names.append(model.names[best[d]])
                    shares.append(1.0)
                    spans.append([(names[-1], int(starts[first] - part[d]), int(ends[-1] - starts[first]))])
                    continue
                path = np.array(viterbi(scores[first:last], switch))
                letters = np.bincount(path, before[ends] - before[starts[first:last]], minlength=n_lang)
                names.append(model.names[int(letters.argmax())])
                shares.append(float(letters.max() / letters.sum()))
                cut = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1, [len(path)]])
                spans.append([(model.names[path[a]], int(starts[first + a] - part[d]), int(ends[b - 1] - starts[first + a]))
                              for a, b in zip(cut[:-1], cut[1:])])
        kind = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("bytes", pa.int32())])
        flat = [s for own in spans for s in own]
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum([len(s) for s in spans])]), pa.int32()),
            pa.StructArray.from_arrays([pa.array([s[k] for s in flat], t.type) for k, t in enumerate(kind)], fields=list(kind)))
        yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(names, pa.string()), pa.array(shares, pa.float64()), lists],
                                         [*keep.schema.names, "lang_pred", "score", "spans"])


def label(docs: DataFrame, model: Model, switch: float = SWITCH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row.

    ``score`` is the share of the document's letters in spans of ``lang_pred``; ``spans`` has
    language, start and length in bytes of the lower-cased UTF-8 text. A text that is null or has
    no letter is ``und`` with score 0 and no span, as is every text if nothing was learned. Equal
    scores go to the language that sorts first. Rows are kept one for one.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(partial(_label, shared, switch), f"doc_id long, {FOUND}")


def digest(docs: DataFrame) -> DataFrame:
    return label(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
