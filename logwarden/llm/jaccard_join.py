"""Documents joined by the Jaccard similarity of their word n-grams, with token-combination prefixes.

A set's tokens are put in one order for all sets: by the number of sets that hold them, and the
frequent ones last. Two sets of similarity t or more
differ in few tokens, so a prefix just longer than that number holds a token of both. Rare tokens
are indexed alone. Tokens that very many sets hold are poor keys; they make up classes of which
*pairs* are indexed instead, and as two tokens of a class must then be shared, the prefix is
extended until it covers as many differences as before. Candidates that share a key are verified
on their whole sets.

Why nothing is lost: let x and y be similar, and the prefix of x end no later in the order than
that of y. If they share no key, no single token of x's prefix is in y, and of each class at most
one. So x has at least (single tokens + tokens of each class less one) tokens that y lacks; the
prefix is made so long that this is more than similarity t allows.

Sets that are equal are one *node*, known by a hash of the set. Nodes without a similar one fall
out early, because most of their tokens occur nowhere else. Groups that share a key are not
expanded into pairs: each node is first compared with the most central one of its largest group, then
in each round a few pivots of each group are compared with the others, nodes
known to be connected aren't compared again, and pivots leave the group. The number of pivots
grows from round to round, so the rounds are few; what is compared in the end is every pair of
candidates that isn't connected otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from logwarden.llm.components import stars
from logwarden.llm.hashing import buffers, distinct, mix, sequences, slices, words
from logwarden.llm.tables import partitions, small_batches
from logwarden.session import discard, materialize

#: Frequent tokens are in this many sets at least, and in so many that no more than so many can be:
#: that bounds the list of them, which is broadcast.
OFTEN, FREQUENT = 2_000, 200_000
#: Bins of the token counts that bound an overlap before sets are compared, as bytes; the largest stands for itself and all above.
BINS, FULL = 64, 127
#: Tokens that a task takes together, and that a bucket holds on average at most.
TAKE, BUCKET = 750_000, 1_000_000
#: Pivots of a group, and how their number grows. The links of one comparison per node stand for the round of the fewest;
#: the next holds 16, the third 1024.
PIVOTS, GROWTH = 2, 8
#: Bits of the filter of sets that several rows have, at most: it is broadcast too.
REPEATED = 1 << 24


def allowed(n: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens of a set of n may be missing in one that is similar enough."""
    return n - -(-n * percent // 100)


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First document, sorted distinct tokens, and bounds per document, slice by slice."""
    data, offsets = buffers(column)
    for begin, end in slices(offsets):
        hashes, _, bounds = words(data[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin])
        tokens, docs = distinct(*sequences(hashes, bounds, n)[:2])
        yield begin, tokens, np.searchsorted(docs, np.arange(end - begin + 1))


def _node_ids(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; of the empty set 0."""
    size = np.diff(bounds)
    out = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        out[full] = mix(np.add.reduceat(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1][full]) + size[full].astype(np.uint64))
    return out


def _taken(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]]:
    """Different sets in lots of about TAKE tokens: node, size, tokens, their node's place; and per slice its other columns,
    first row, nodes and sizes."""
    nodes, sizes, tokens, rows, seen, held = [], [], [], [], set(), 0

    def lot():
        size = np.array(sizes, np.int64)
        return (np.array(nodes, np.uint64), size, np.concatenate(tokens) if tokens else np.zeros(0, np.uint64),
                np.repeat(np.arange(len(size)), size), rows)

    for batch in batches:
        for begin, values, bounds in _sets(batch.column(batch.num_columns - 1), n):
            names = _node_ids(values, bounds)
            rows.append((batch.columns[:-1], begin, names, np.diff(bounds)))
            for d, name in enumerate(names.tolist()):
                if name and name not in seen:
                    seen.add(name)
                    nodes.append(name)
                    sizes.append(int(bounds[d + 1] - bounds[d]))
                    tokens.append(values[bounds[d]:bounds[d + 1]])
                    held += sizes[-1]
            if held >= TAKE:
                yield lot()
                nodes, sizes, tokens, rows, held = [], [], [], [], 0
                seen.clear()
    if rows:
        yield lot()


SURVEYED = "doc_id long, tie long, node long, n int, token long, sets long"


def _survey(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with its node, and the tokens that are frequent in a lot."""
    names = ["doc_id", "tie", "node", "n", "token", "sets"]
    for nodes, sizes, tokens, _, rows in _taken(batches, n):
        for (ids, ties), begin, node, size in rows:
            none = pa.nulls(len(node), pa.int64())
            yield pa.RecordBatch.from_arrays([ids.slice(begin, len(node)), ties.slice(begin, len(node)), pa.array(node.view(np.int64)),
                                              pa.array(size, pa.int32()), none, none], names)
        values, counts = np.unique(tokens, return_counts=True)
        often = counts >= max(2, len(tokens) / FREQUENT)
        k = int(often.sum())
        none = pa.nulls(k, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(k, pa.int32()), pa.array(values[often].view(np.int64)), pa.array(counts[often])], names)


def _blobs(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Runs of an array's elements as bytes, one run from each cut to the next."""
    offsets = (cuts * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(column: pa.ChunkedArray, kind=np.uint8) -> tuple[np.ndarray, np.ndarray]:
    """All elements of such runs, and how many each row has; a null has none."""
    runs = [np.frombuffer(x or b"", kind) for x in column.to_pylist()]
    return np.concatenate(runs or [np.zeros(0, kind)]), np.array([len(x) for x in runs], np.int64)


def _steps(places: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Runs of ascending numbers, as the steps between them from 0 on: a byte each, and one more for every 255 of a step."""
    steps = np.diff(places, prepend=0)
    steps[cuts[:-1]] = places[cuts[:-1]]
    ends = np.concatenate([[0], np.cumsum(steps // 255 + 1)])
    out = np.full(ends[-1], 255, np.uint8)
    out[ends[1:] - 1] = steps % 255
    return _blobs(out, ends[cuts])


def _places(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all runs, and the row of each."""
    steps, lengths = _bytes(column)
    total = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
    begins = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    ends, row = steps < 255, np.repeat(np.arange(len(lengths)), lengths)
    return (total[1:] - total[begins][row])[ends], row[ends]


def _five(tokens: np.ndarray) -> np.ndarray:
    """The low 40 bits of each token, five bytes each, as elements of that size."""
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :5]).view("V5").ravel()


def _tokens(column: pa.ChunkedArray) -> np.ndarray:
    data, _ = _bytes(column)
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = data.reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    n = len(columns[0])
    new = np.ones(n + 1, bool)
    if n:
        new[1:n] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new) if n else np.zeros(1, np.int64)


def _filter(rows: DataFrame, documents: int) -> np.ndarray:
    """Bits at two places for each set that several rows have; at most REPEATED bits, more sets only make it less sharp."""
    size = min(REPEATED, max(64, 1 << (4 * documents).bit_length()))
    again = rows.where("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    at = F.explode(F.array(F.col("node").bitwiseAND(F.lit(size - 1)), F.shiftright("node", 30).bitwiseAND(F.lit(size - 1)))).alias("at")
    words = again.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _maybe(bits: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Whether several rows may have each set; never false of one that several have."""
    at = np.stack([nodes, nodes >> np.uint64(30)]) & np.uint64(64 * len(bits) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=0)


DEALT = "bucket long, part long, alone int, owners binary, nodes binary, tokens binary, sizes binary, counts binary"


def _parts(nodes: np.ndarray, n_parts: int) -> np.ndarray:
    return -1 - (mix(nodes) % np.uint64(n_parts)).astype(np.int64)


def _deal(n: int, n_buckets: int, frequent, repeated, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each lot by bucket, as five bytes each, in the order of their nodes.

    A node is known in its lot by its place, which takes a byte a token. Only those that may be in other
    lots too are named, as they count once; they come last, and are gathered by their name and not by lot.
    Rows with ``sizes`` aren't counted in the bucket: they have the nodes of a part, and of each its size and
    its frequent tokens, as places in the list of those.
    """
    common, bits = frequent.value, repeated.value
    names = ["bucket", "part", "alone", "owners", "nodes", "tokens", "sizes", "counts"]
    for nodes, sizes, tokens, owner, _ in _taken(batches, n):
        if not len(nodes):
            continue
        many = _maybe(bits, nodes)
        order = np.argsort(many, kind="stable")
        place = np.empty(len(nodes), np.int64)
        place[order] = np.arange(len(nodes))
        nodes, sizes, owner, alone = nodes[order], sizes[order], place[owner], int((~many).sum())
        # Known by what is in it: were the rows of a task cut otherwise when it is run again, its answers would find no lot.
        lot = int(mix(nodes[:alone] + np.arange(alone, dtype=np.uint64)).sum() >> np.uint64(1))
        at = np.minimum(np.searchsorted(common, tokens), max(len(common) - 1, 0))
        often = common[at] == tokens if len(common) else np.zeros(len(tokens), bool)
        bucket = ((tokens >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)
        rare = np.flatnonzero(~often)
        rare = rare[np.lexsort((owner[rare], bucket[rare]))]
        if len(rare):
            b, own = bucket[rare], owner[rare]
            cuts = _heads(b)
            named = _heads(b, own)[:-1]
            named = named[own[named] >= alone]
            rows = len(cuts) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(b[cuts[:-1]]), pa.array(np.full(rows, lot)), pa.array(np.full(rows, alone, np.int32)), _steps(own, cuts),
                 _blobs(nodes[own[named]], np.searchsorted(named, cuts)), _blobs(_five(tokens[rare]), cuts), pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.binary())], names)
        part = np.where(np.arange(len(nodes)) < alone, lot, _parts(nodes, n_buckets))
        by_node = np.flatnonzero(often)
        by_node = by_node[np.argsort(owner[by_node], kind="stable")]
        n_often = np.bincount(owner[by_node], minlength=len(nodes))
        begins = np.concatenate([[0], np.cumsum(n_often)])
        order = np.argsort(part, kind="stable")
        cuts = _heads(part[order])
        rows, none = len(cuts) - 1, pa.nulls(len(cuts) - 1, pa.binary())
        ranks = at[by_node].astype(np.uint32)
        ranks = np.concatenate([ranks[begins[i]:begins[i + 1]] for i in order])
        known = part[order][cuts[:-1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array((mix(known.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)), pa.array(known), pa.nulls(rows, pa.int32()), none,
             _blobs(nodes[order], cuts), _blobs(ranks, np.concatenate([[0], np.cumsum(n_often[order])])[cuts]),
             _blobs(sizes[order].astype(np.uint32), cuts), _blobs(n_often[order].astype(np.uint32), cuts)], names)


ANSWERED = "part long, bucket long, owners binary, nodes binary, tokens binary, sets binary, many binary, sizes binary, counts binary"


def _answers(bucket: int, part: np.ndarray, place: np.ndarray, node: np.ndarray | None, token: np.ndarray, sets: np.ndarray) -> pa.Table:
    """Shared tokens by part, in the order of their nodes: known by place in the lot, or named."""
    order = np.lexsort((token, place if node is None else node, part))
    part, token, sets = part[order], token[order], sets[order]
    cuts = _heads(part)
    rows = len(cuts) - 1
    if node is None:
        place, names = place[order], pa.nulls(rows, pa.binary())
    else:
        node = node[order]
        first = _heads(part, node)[:-1]
        before = np.searchsorted(first, cuts)
        place = np.searchsorted(first, np.arange(len(node)), "right") - 1 - np.repeat(before[:-1], np.diff(cuts))
        names = _blobs(node[first], before)
    large = np.flatnonzero(sets >= 255)
    return pa.Table.from_arrays(
        [pa.array(part[cuts[:-1]]), pa.array(np.full(rows, bucket)), _steps(place, cuts), names, _blobs(_five(token), cuts),
         _blobs(np.minimum(sets, 255).astype(np.uint8), cuts), _blobs(sets[large].astype(np.uint32), np.searchsorted(large, cuts)),
         pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.binary())],
        ["part", "bucket", "owners", "nodes", "tokens", "sets", "many", "sizes", "counts"])


def _count(n_parts: int, rows):
    """In how many sets each token of a bucket is; tokens in two or more go on to their nodes' parts."""
    known = rows.filter(pc.is_valid(rows.column("sizes")))
    none = pa.nulls(known.num_rows, pa.binary())
    out = [pa.Table.from_arrays([known.column("part"), known.column("bucket"), none, known.column("nodes"), known.column("tokens"), none, none,
                                 known.column("sizes"), known.column("counts")],
                                ["part", "bucket", "owners", "nodes", "tokens", "sets", "many", "sizes", "counts"])]
    rows = rows.filter(pc.is_null(rows.column("sizes")))
    if rows.num_rows:
        bucket = rows.column("bucket")[0].as_py()
        lots, alone = rows.column("part").to_numpy(), rows.column("alone").to_numpy()
        place, row = _places(rows.column("owners"))
        first = _heads(row, place)
        named = place[first[:-1]] >= alone[row[first[:-1]]]
        names, which = np.unique(_bytes(rows.column("nodes"), np.uint64)[0], return_inverse=True)
        # Nodes known by their place come before those with a name, which are one node wherever they are.
        single = np.flatnonzero(~named)
        number = np.empty(len(named), np.int64)
        number[single] = np.arange(len(single))
        number[named] = len(single) + which
        if len(single) + len(names) >= 1 << 24:
            raise ValueError("too many sets in a bucket: raise the number of buckets")
        owner = np.repeat(number, np.diff(first)).astype(np.uint64)
        both = _tokens(rows.column("tokens")) << np.uint64(24) | owner
        both.sort()
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        token = both >> np.uint64(24)
        sets = np.diff(_heads(token))
        sets = np.repeat(sets, sets)
        shared = sets > 1
        owner, token, sets = (both[shared] & np.uint64((1 << 24) - 1)).astype(np.int64), token[shared], sets[shared]
        ours = owner < len(single)
        head = first[single[owner[ours]]]
        out.append(_answers(bucket, lots[row[head]], place[head], None, token[ours], sets[ours]))
        node = names[owner[~ours] - len(single)]
        out.append(_answers(bucket, _parts(node, n_parts), None, node, token[~ours], sets[~ours]))
    return pa.concat_tables(out).select(["part", "bucket", "owners", "nodes", "tokens", "sets", "many", "sizes", "counts"])


NODES = "node long, n int, need int, n_rare int, central double, tokens array<long>, bins array<tinyint>"


def _gather(percent: int, rows):
    """The nodes of a part that may have a similar one, with all their shared tokens, rarest first.

    ``need`` is how many differences the keys must cover beyond the tokens that no other set has.
    """
    known = rows.filter(pc.is_valid(rows.column("sizes")))
    listed, lengths = _bytes(known.column("nodes"), np.uint64)
    node, first = np.unique(listed, return_index=True)
    size = _bytes(known.column("sizes"), np.uint32)[0][first].astype(np.int64)
    counts = _bytes(known.column("counts"), np.uint32)[0].astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(counts)])
    ranks = _bytes(known.column("tokens"), np.uint32)[0].astype(np.int64)
    n_often = counts[first]
    rows = rows.filter(pc.is_null(rows.column("sizes")))
    place, row = _places(rows.column("owners"))
    names, n_names = _bytes(rows.column("nodes"), np.uint64)
    if rows.num_rows and not len(names):  # a lot: places are those in its only list of nodes
        if known.num_rows != 1:
            raise ValueError("the rows of a task came in another order when it was run again")
        owner = np.searchsorted(node, listed[place])
    else:
        owner = np.searchsorted(node, names[place + (np.cumsum(n_names) - n_names)[row]])
    token = _tokens(rows.column("tokens")) | rows.column("bucket").to_numpy().astype(np.uint64)[row] << np.uint64(40)
    sets = _bytes(rows.column("sets"))[0].astype(np.int64)
    sets[sets == 255] = _bytes(rows.column("many"), np.uint32)[0]
    n_rare = np.bincount(owner, minlength=len(node))
    need = allowed(size, percent) + 1 - (size - n_rare - n_often)
    alive = (need > 0) & (size > 1)
    mine = alive[owner]
    owner, token, sets = owner[mine], token[mine], sets[mine]
    order = np.lexsort((token, sets, owner))
    owner, token, sets = owner[order], token[order], sets[order]
    cuts = np.searchsorted(owner, np.arange(len(node) + 1))
    kept = np.flatnonzero(alive)
    lists, central = [], []
    for i in kept:
        often = np.sort(ranks[begins[first[i]]:begins[first[i]] + n_often[i]])
        # Frequent tokens are told apart from rare ones by their sign.
        lists.append(np.concatenate([token[cuts[i]:cuts[i + 1]].view(np.int64), -1 - often]))
        central.append((np.log2(sets[cuts[i]:cuts[i + 1]]).sum() + 20.0 * len(often)) / size[i])
    values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    bin_of = mix(values.view(np.uint64)) % np.uint64(BINS) + np.repeat(np.arange(len(lists), dtype=np.uint64) * np.uint64(BINS), np.diff(offsets))
    bins = np.minimum(np.bincount(bin_of.astype(np.int64), minlength=BINS * len(lists)), FULL)
    return pa.table({
        "node": node[kept].view(np.int64), "n": pa.array(size[kept], pa.int32()), "need": pa.array(need[kept], pa.int32()),
        "n_rare": pa.array(n_rare[kept], pa.int32()), "central": pa.array(central, pa.float64()),
        "tokens": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
        "bins": pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * BINS, pa.int32()), pa.array(bins, pa.int8()))})


KEYS = "key long, node long, n int, central double"


def pair_keys(often: np.ndarray, need: int, n: int, percent: int) -> np.ndarray:
    """Keys of pairs of frequent tokens, of the shortest prefix of ``often`` that covers ``need`` differences.

    Classes hold about ten tokens of a set of n, so their number follows n; a pair of sets uses
    the number for the smaller one, and each set makes keys for all sizes it may be paired with.
    """
    out = []
    for level in {n.bit_length(), max(1, -(-n * percent // 100)).bit_length()}:
        classes = max(1, (1 << level - 1) // 8)
        kind = mix(often.astype(np.uint64)) % np.uint64(classes)
        first = np.zeros(len(often), bool)
        first[np.unique(kind, return_index=True)[1]] = True
        covered = np.cumsum(~first)
        end = int(np.searchsorted(covered, need)) + 1
        order = np.argsort(kind[:end], kind="stable")
        token, kind = often[:end][order].astype(np.uint64), kind[:end][order]
        for gap in range(1, len(token)):
            same = np.flatnonzero(kind[gap:] == kind[:-gap])
            if not len(same):
                break
            a, b = token[same], token[same + gap]
            out.append(mix(mix(np.minimum(a, b) + np.uint64(level)) + np.maximum(a, b)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _keys(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(5)
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        keys, counts = [], []
        for i, (n, need, n_rare) in enumerate(zip(*[batch.column(c).to_pylist() for c in (1, 2, 3)])):
            tokens = values[offsets[i]:offsets[i + 1]]
            own = mix(tokens[:min(need, n_rare)].astype(np.uint64))
            if need > n_rare:
                own = np.concatenate([own, pair_keys(-1 - tokens[n_rare:], need - n_rare, n, percent)])
            keys.append(own)
            counts.append(len(own))
        for begin in range(0, len(counts), 2000):
            part = slice(begin, begin + 2000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys[part]).view(np.int64)),
                 *[pa.array(np.repeat(batch.column(c).to_numpy()[part], counts[part])) for c in (0, 1, 4)]],
                ["key", "node", "n", "central"])


def _enough(common, n_a, n_b, percent: int):
    return common * 100 >= (n_a + n_b - common) * percent


def _bound(a: str, b: str):
    """No more tokens can two sets share than, bin by bin, the smaller of their counts; where both bins are full, any number."""
    least = F.zip_with(a, b, lambda x, y: F.least(x, y))
    few = F.aggregate(least, F.lit(0), lambda x, y: x + y.cast("int")).cast("long")
    many = F.aggregate(least, F.lit(0).cast("long"), lambda x, y: x + F.when(y == FULL, 1 << 40).otherwise(y).cast("long"))
    return F.when((F.array_max(a) == FULL) & (F.array_max(b) == FULL), many).otherwise(few)


def _similar(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough; all tokens that two sets share are in both lists."""
    def side(x: str) -> DataFrame:
        return nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "tokens")])

    both = pairs.join(side("b"), "b").join(side("a"), "a")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return both.where(_enough(common, F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _first_links(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Stars of the links that one comparison per node finds: with the most central node of its largest group.

    Most groups are near copies of one text. These links spare their other keys, without a row for each of them.
    """
    near = F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * percent
    best = rows.where((F.col("node") != F.col("p_node")) & near).groupBy("node").agg(F.max(F.struct("size", "p_node")).alias("b"))
    pairs = best.select(F.least("node", "b.p_node").alias("a"), F.greatest("node", "b.p_node").alias("b")).distinct()
    found = materialize(_similar(pairs, nodes, percent).toDF("u", "v"), "found")
    links = stars(found)
    discard(found)
    return links


def _connect(nodes: DataFrame, percent: int) -> DataFrame:
    """Stars (u, v) over the nodes: which node stands for each that is linked with another."""
    keys = materialize(nodes.mapInArrow(partial(_keys, percent), KEYS), "keys")
    # Keys with the same nodes say the same; one of them is enough.
    groups = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        F.max(F.struct("central", "node", "n")).alias("first"))
    chosen = groups.where("size > 1").groupBy("size", "x", "y").agg(F.min(F.struct("key", "first")).alias("k")).select(
        "k.key", "size", F.col("k.first.node").alias("p_node"), F.col("k.first.n").alias("p_n"))
    rows = materialize(keys.join(chosen, "key").distinct(), "shared")
    discard(keys)
    links = _first_links(rows, nodes, percent)
    # Groups that these links make one part of are done, so bins are moved for the others only.
    placed = rows.select("key", "node", "n", "central").join(
        nodes.select("node").join(links.toDF("node", "part"), "node", "left").withColumn("part", F.coalesce("part", "node")), "node")
    apart = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("key")
    postings = materialize(placed.join(apart, "key", "left_semi").join(nodes.select("node", "bins"), "node"), "postings")
    discard(rows)
    pivots_each = PIVOTS * GROWTH
    while True:
        # Nodes that aren't linked yet go first: once they have been compared, a group is one part and done.
        salt = F.pmod(F.xxhash64("node", F.lit(pivots_each)), F.lit(pivots_each))
        best = postings.groupBy("key", salt.alias("salt")).agg(
            F.max(F.struct((F.col("part") == F.col("node")).alias("alone"), "central", "node", "n", "part", "bins")).alias("pivot"), F.min("part").alias("p"), F.max("part").alias("q"))
        of_key = Window.partitionBy("key")
        live = best.withColumns({"p": F.min("p").over(of_key), "q": F.max("q").over(of_key)}).where("p <> q")
        pivots = materialize(live.select("key", *[F.col(f"pivot.{c}").alias(f"p_{c}") for c in ("node", "n", "part", "bins")]), "pivots")
        if pivots.isEmpty():
            discard(pivots)
            discard(postings)
            return links
        # What can't be similar by size or bins isn't made a pair of, so groups aren't multiplied out.
        meet = ((F.col("part") != F.col("p_part")) & (F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * percent)
                & _enough(_bound("bins", "p_bins"), F.col("n"), F.col("p_n"), percent))
        pairs = postings.join(pivots, (postings["key"] == pivots["key"]) & meet).select(
            F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct()
        # Written once: the stars read their edges several times, and would find them anew each time.
        found = materialize(_similar(pairs, nodes, percent).toDF("u", "v"), "found")
        then = stars(links.union(found))
        # Pivots have been compared with all the rest of their groups.
        spent = pivots.groupBy("key").agg(F.collect_set("p_node").alias("spent"))
        rest = postings.join(spent, "key").where(~F.array_contains("spent", F.col("node"))).drop("spent", "part")
        left = rest.join(then.select(F.col("u").alias("node"), F.col("v").alias("part")), "node", "left")
        left = materialize(left.withColumn("part", F.coalesce("part", "node")), "postings")
        for old in (postings, pivots, found, links):
            discard(old)
        postings, links, pivots_each = left, then, GROWTH * pivots_each


def _classes(docs: DataFrame, words_each: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """Per row: doc_id, tie (hash of its text), node, n, and part (the node that stands for all linked with it)."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_column), F.lit(""))
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    surveyed = materialize(texts.mapInArrow(partial(_survey, words_each), SURVEYED), "survey")
    rows = surveyed.where("n is not null").select("doc_id", "tie", "node", "n")
    documents, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    often = (surveyed.where("token is not null").groupBy("token").agg(F.sum("sets").alias("sets"))
             .where(F.col("sets") >= max(OFTEN, total / FREQUENT)).orderBy(F.desc("sets"), "token").limit(FREQUENT))
    # Sorted by value for the search; a frequent token is known by its place in the list.
    common = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in often.collect()], np.int64).view(np.uint64)))
    repeated = spark.sparkContext.broadcast(_filter(rows, documents))
    n_buckets = max(2 * partitions(spark), -(-total // BUCKET))
    nodes = (texts.select("text").mapInArrow(partial(_deal, words_each, n_buckets, common, repeated), DEALT)
             .groupBy("bucket").applyInArrow(_task(_count, n_buckets), ANSWERED)
             .groupBy("part").applyInArrow(_task(_gather, percent), NODES))
    links = _connect(materialize(nodes, "nodes"), percent)
    return rows.join(links.withColumnRenamed("u", "node"), "node", "left").withColumn("part", F.coalesce("v", "node")).drop("v")


def components(docs: DataFrame, words_each: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id reachable by links), n_copies (rows with the same set).

    Links join sets with 100 * intersection >= percent * union. Words are runs of characters
    other than white space with A-Z lower-cased. A text of fewer than ``words_each`` words is one
    token; a text that is null, empty or without words has no token, is its own component and
    counts no copies. Rows that repeat an id stay rows, each with its own text. Where a
    component has rows without id, the least of the others stands for all; if there are none, null.
    """
    rows = _classes(docs, words_each, percent, id_column, text_column)
    least = rows.where("n > 0").groupBy("part").agg(F.min("doc_id").alias("component_id"))
    copies = rows.where("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("n_copies"))
    return (rows.join(least, "part", "left").join(copies, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_copies", F.lit(0).cast("long")).alias("n_copies")))


def deduplicate(docs: DataFrame, words_each: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each component, the one of the least id, with all its columns; see ``components``.

    Texts without words stay. Of rows that are equal in id and text one stays; ids that are null
    come last.
    """
    rows = _classes(docs, words_each, percent, id_column, text_column)
    first = rows.where("n > 0").groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("s"))
    kept = materialize(first.select("s.doc_id", "s.tie").union(rows.where("n = 0").select("doc_id", "tie").distinct()), "kept")
    same = lambda a, b: (a["doc_id"].eqNullSafe(b["doc_id"])) & (a["tie"] == b["tie"])
    whole = docs.select(F.struct("*").alias("row"), F.col(id_column).cast("long").alias("doc_id"),
                        F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("tie"))
    out = whole.join(kept, same(whole, kept), "left_semi")
    again = rows.where("n > 0").groupBy("doc_id", "tie").count().where("count > 1").select("doc_id", "tie")
    again = materialize(again.join(kept, same(again, kept), "left_semi"), "again")
    if not again.isEmpty():
        out = out.join(again, same(out, again), "left_anti").unionByName(
            out.join(again, same(out, again), "left_semi").dropDuplicates(["doc_id", "tie"]))
    return out.select("row.*")


def _task(step, *parameters):
    """A function of one group's rows, without annotations that Spark would read as another kind."""
    def task(rows):
        return step(*parameters, rows)

    return task
