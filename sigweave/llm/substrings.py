"""Removal of repeated runs of words: every word that a window seen earlier covers goes.

A window is WINDOW consecutive words of one document. Its words are removed if the same
window starts earlier: in a document of a smaller id, or earlier in its own. Windows are judged
on the input.

The windows are the paths of depth WINDOW in the tree of all suffixes, and a node there with two leaves or more is a repeat. The tree is
built in groups. A window belongs to its seed, the leftmost of its runs of SEED words with the least hash, which stands at the same
place in each copy of the window; consecutive windows of one seed form a stretch of up to 2 * WINDOW - SEED words, which is
sent with its words. A seed that occurs once has no repeat, so its stretches stay away. The prefix by which
suffixes are put into groups is the seed; a seed of more than GROUP occurrences is lengthened to whole windows, of which a batch
sends the first only, as it can settle the later ones itself. So a group fits in memory whatever the corpus holds. In a group
the suffixes of the stretches are sorted by prefix doubling on whole words, not hashes, and the classes of suffixes with
WINDOW words in common are the nodes; every leaf of a node but its first is a repeat, and leaves one after
the other in a document make a maximal one.

Null text has no words. A null id comes after all others. Rows equal in id and text are one
document listed more than once and get the same result; rows equal in id only are ordered
by a hash of their texts. An empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.llm import graph, words

WINDOW, SEED, GROUP = 20, 8, 4096
CHUNK = 1 << 14  # stretches that are sorted at a time, and as many more as their last group has
_U = np.uint64
_KEY = "struct<k1: bigint, k2: bigint>"
_STRETCH = "part bigint, o bigint, k1 bigint, k2 bigint, place int, n int, stretch string"


def seeds(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of SEED words and their first words' places; the first words of all windows, and the run that is the seed of each."""
    g, gat = words.windows(h, at, SEED)
    width = WINDOW - SEED + 1
    own = words.owners(gat)
    if len(g) < width:
        return g, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    # Places of runs, word by word: a text of n words has n - SEED + 1 of them.
    first_word = np.arange(len(g)) + (at[:-1] - gat[:-1])[own]
    least, chosen, have = g, np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        a, b = least[:-step], least[step:]
        left = a <= b
        chosen = np.where(left, chosen[:-step], chosen[step:])
        least, have = np.where(left, a, b), have + step
    valid = own[: len(least)] == own[width - 1 :]
    return g, first_word, first_word[: len(least)][valid], chosen[valid]


def _parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _seed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each seed of a part, and how often it has it."""
    for b in _parts(batches, 5000):
        texts, found = words.encoded(b.column(0)), []
        for i, j in words.blocks(texts):
            g, _, _, chosen = seeds(*words.hashes(texts[i:j]))
            found.append(g[np.unique(chosen)])
        g, n = np.unique(np.concatenate(found or [np.empty(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], names=["seed", "n"])


def _pairs(own: np.ndarray, g: np.ndarray) -> np.ndarray:
    """One hash for (text, hash)."""
    with np.errstate(over="ignore"):
        return words.mix(g + own.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct seeds of each text (key, text)."""
    for b in _parts(batches, 2000):
        texts = words.encoded(b.column(1))
        for i, j in words.blocks(texts):
            h, at = words.hashes(texts[i:j])
            g, first_word, _, chosen = seeds(h, at)
            chosen = np.unique(chosen)
            own = np.searchsorted(at, first_word[chosen], "right") - 1 + i
            _, first = np.unique(_pairs(own, g[chosen]), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(g[chosen][first].view(np.int64)), b.column(0).take(pa.array(own[first]))], names=["seed", "k"])


def _nodes(stretches: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, stretch, which of its n windows) of all windows of some stretches: equal windows, and no others, have one node.

    Suffixes are ranked by their first word, and by their first 2, 4, 8, ... words from the ranks of half as many.
    """
    split = pc.ascii_split_whitespace(stretches.cast(pa.large_string()))
    rank = np.asarray(split.flatten().dictionary_encode().indices).astype(np.int64)
    begin = np.asarray(split.offsets)[:-1]
    row = np.repeat(np.arange(len(n)), n)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[row] + turn
    ranks, have = {1: rank}, 1
    while have * 2 <= WINDOW:
        ranks[have * 2] = _named(ranks[have][:-have], ranks[have][have:])
        have *= 2
    node, done = ranks[have][at], have
    while done < WINDOW:
        step = max(x for x in ranks if x <= WINDOW - done)
        node = _named(node, ranks[step][at + done])
        done += step
    return node, row, turn


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of each pair."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _settled(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, which window, whether it is its node's first, whether a repeat) of all windows of some stretches; a leaf listed twice is neither the second time."""
    o, k1, k2, place, n = (np.asarray(b.column(i)).astype(np.int64) for i in range(1, 6))
    node, row, turn = _nodes(b.column(6), n)
    order = np.lexsort((place[row] + turn, k2[row], k1[row], o[row], node))
    node, row, turn = node[order], row[order], turn[order]
    head = np.ones(len(node), bool)
    head[1:] = node[1:] != node[:-1]
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    same = (k1[row] == k1[row[first]]) & (k2[row] == k2[row[first]]) & (place[row] + turn == place[row[first]] + turn[first])
    return row, turn, head, ~same


def _runs(b: pa.RecordBatch, row: np.ndarray, turn: np.ndarray) -> pa.RecordBatch:
    """Repeats (k, place, length) of neighbouring windows of a stretch."""
    by = np.lexsort((turn, row))
    row, turn = row[by], turn[by]
    start = np.ones(len(row), bool)
    start[1:] = (row[1:] != row[:-1]) | (turn[1:] != turn[:-1] + 1)
    starts = np.flatnonzero(start)
    at = row[starts]
    key = pa.StructArray.from_arrays([b.column(i).take(pa.array(at)) for i in (2, 3)], names=["k1", "k2"])
    place = np.asarray(b.column(4))[at] + turn[starts]
    return pa.RecordBatch.from_arrays([key, pa.array(place.astype(np.int32)), pa.array(np.diff(np.append(starts, len(row))).astype(np.int32))], names=["k", "place", "length"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of (k, order, text, seeds, frequent) at its repeated seeds; at frequent seeds the windows that are the batch's first, and its repeats with a null stretch."""
    for b in _parts(batches, 2000):
        keys = np.asarray(b.column(0).field(0)), np.asarray(b.column(0).field(1))
        order, texts = np.asarray(b.column(1)), words.encoded(b.column(2))
        lengths = np.asarray(b.column(3).value_lengths())
        known = np.asarray(b.column(3).flatten()).view(np.uint64)
        frequent = np.asarray(b.column(4).flatten())
        seen = _pairs(np.repeat(np.arange(len(texts)), lengths), known)
        by = np.argsort(seen)
        seen, frequent = seen[by], frequent[by]
        for i, j in words.blocks(texts):
            joined = b"\n".join(texts[i:j])
            h, at = words.hashes(texts[i:j])
            g, _, window, seed = seeds(h, at)
            if not len(window):
                continue
            doc = np.searchsorted(at, window, "right") - 1
            mine = _pairs(doc + i, g[seed])
            found = np.minimum(np.searchsorted(seen, mine), len(seen) - 1)
            hit = seen[found] == mine
            window, seed, doc, often = window[hit], seed[hit], doc[hit], frequent[found[hit]]
            if not len(window):
                continue
            starts, ends = words.bounds(np.frombuffer(joined, np.uint8))
            new = np.ones(len(window), bool)
            new[1:] = (seed[1:] != seed[:-1]) | (window[1:] != window[:-1] + 1)
            rare = np.flatnonzero(new & ~often)
            n = np.diff(np.append(np.flatnonzero(new), len(window)))[~often[new]]

            def made(at_: np.ndarray, n: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
                w, d = window[at_], doc[at_]  # noqa: B023
                text = words.cut(joined, starts[w], ends[w + n + (WINDOW - 2)])  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(order[i + d]), pa.array(keys[0][i + d]), pa.array(keys[1][i + d]), pa.array((w - at[d]).astype(np.int32)), pa.array(n.astype(np.int32)), text], names=[c.split()[0] for c in _STRETCH.split(", ")])  # noqa: B023

            yield made(rare, n, g[seed[rare]])
            hot = np.flatnonzero(often)
            if len(hot):
                whole = made(hot, np.ones(len(hot), np.int64), words.windows(h, np.array([0, len(h)]), WINDOW)[0][window[hot]])
                row, turn, first, repeat = _settled(whole)
                yield whole.take(pa.array(row[first]))
                runs = _runs_of_windows(whole, row[repeat])
                none = pa.nulls(runs.num_rows, pa.int64()).fill_null(0)
                yield pa.RecordBatch.from_arrays([pa.array(words.mix((np.asarray(runs.column(0).field(0)) + np.asarray(runs.column(1))).view(np.uint64)).view(np.int64)), none, runs.column(0).field(0), runs.column(0).field(1), runs.column(1), runs.column(2), pa.nulls(runs.num_rows, pa.string())], names=whole.schema.names)


def _runs_of_windows(b: pa.RecordBatch, row: np.ndarray) -> pa.RecordBatch:
    """_runs() of stretches that are one window each."""
    k1, k2, place = (np.asarray(b.column(i)).astype(np.int64)[row] for i in (2, 3, 4))
    by = np.lexsort((place, k2, k1))
    k1, k2, place = k1[by], k2[by], place[by]
    start = np.ones(len(row), bool)
    start[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (place[1:] != place[:-1] + 1)
    s = np.flatnonzero(start)
    key = pa.StructArray.from_arrays([pa.array(k1[s]), pa.array(k2[s])], names=["k1", "k2"])
    return pa.RecordBatch.from_arrays([key, pa.array(place[s].astype(np.int32)), pa.array(np.diff(np.append(s, len(row))).astype(np.int32))], names=["k", "place", "length"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeats of groups of stretches, sorted by part; a group is in one piece."""
    held: list[pa.RecordBatch] = []

    def settle(b: pa.RecordBatch) -> pa.RecordBatch:
        row, turn, _, repeat = _settled(b)
        return _runs(b, row[repeat], turn[repeat])

    for b in batches:
        told = b.filter(b.column(6).is_null())
        if told.num_rows:
            key = pa.StructArray.from_arrays([told.column(2), told.column(3)], names=["k1", "k2"])
            yield pa.RecordBatch.from_arrays([key, told.column(4), told.column(5)], names=["k", "place", "length"])
        b = b.filter(b.column(6).is_valid())
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) < CHUNK:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        part = np.asarray(whole.column(0))
        end = int(np.searchsorted(part, part[-1]))  # the last group may go on
        if end:
            yield settle(whole.slice(0, end))
        held = [whole.slice(end)]
    if held:
        yield settle(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept) of each row; kept is the words that stay, joined by one space.

    The repeated seeds are written to the checkpoint folder, as their number decides how they are met.
    """
    k = F.struct(F.xxhash64(docs[id_col], docs[text_col]).alias("k1"), F.xxhash64(F.lit(1), docs[id_col], docs[text_col]).alias("k2"))
    rows = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"), k.alias("k"))
    repeated = rows.select("__text").mapInArrow(_seed_counts, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1").checkpoint()
    total = repeated.agg(F.sum("n")).first()[0] or 0
    held = rows.select("k", "__text").mapInArrow(_seed_rows, f"seed bigint, k {_KEY}")
    seen = graph.meet(held, repeated, "seed", "n", total).groupBy("k").agg(F.collect_list(F.struct("seed", (F.col("n") > GROUP).alias("often"))).alias("seeds"))
    order = F.coalesce(F.col("__id").cast("long"), F.lit((1 << 63) - 1))
    # Both joins shuffle the same rows by the same key, so that Spark does it once.
    stretches = rows.join(seen, "k").select("k", order.alias("o"), "__text", "seeds.seed", "seeds.often").mapInArrow(_stretches, _STRETCH)
    repeats = stretches.repartition("part").sortWithinPartitions("part").mapInArrow(_repeats, f"k {_KEY}, place int, length int")
    repeats = repeats.groupBy("k").agg(F.collect_list(F.struct("place", "length")).alias("repeats"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, 500):
            out = []
            for text, found in zip(words.encoded(b.column(1)), b.column(2), strict=True):
                kept = text.split()
                n = len(kept)
                if found.is_valid:
                    places = np.asarray(found.values.field(0)).astype(np.int64)
                    lengths = np.maximum(np.asarray(found.values.field(1)).astype(np.int64), 1)
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, places, 1)
                    np.add.at(edge, places + lengths + (WINDOW - 1), -1)
                    kept = list(compress(kept, (np.cumsum(edge[:-1]) == 0).tolist()))
                out.append((n, n - len(kept), b" ".join(kept)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()).cast(pa.string())], names=[id_col, "n_words", "n_removed", "kept"])

    return rows.join(repeats, "k", "left").select("__id", "__text", "repeats").mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept string")
