"""Line dedup: documents that overlap are aligned in pairs, and the later one loses the common blocks.

The lines of a text are its \\n-split parts; a line counts if it holds more than white space. For
each line, and for the shortest runs of MIN_CHARS characters from each line onward and from each line back,
the first document with it (the least id) is known, however many have it. A document is paired with each
earlier one that was first with one of its lines or with a run of it. So a document has at most three partners
for each line, and each line of a block that any earlier document has is in such a block of a partner. A pair is aligned by patience diff: the lines
that are unique in both and in the longest order common to both are anchors, and between anchors the
search goes on within the gap; equal lines next to an anchor or at a gap's ends belong to its block.
The later document loses the lines of all blocks that have MIN_CHARS characters or more.

Documents meet by one 64-bit hash of a line or run and are aligned by another, so that two lines that differ are taken for one
only if both are equal. What is compared is the input, not what other pairs have left. Alignment takes the two documents'
line hashes, a bounded table for each pair; it goes pair by pair, so that a document with many partners is
not held with all of them. A line that very many documents have goes by broadcast, and the first holder's partners are spread over cells,
so that neither is left to one task.

Null text stays null; empty text, and lines without words, stay as they are. A null id comes
after all others. Rows equal in id and text are one document listed more than once; rows equal
in id only are ordered by a hash of their texts. An empty table gives an empty result. All other columns are kept, whatever
their names, but for n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.llm import graph

MIN_CHARS = 20
_KEY = "struct<k1: bigint, k2: bigint>"


def _anchors(a: list[int], b: list[int], alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Places of lines unique in both ranges, in the longest common order."""
    ca, cb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
    at = {h: i for i, h in enumerate(b[blo:bhi], blo) if cb[h] == 1}
    pairs = [(i, at[a[i]]) for i in range(alo, ahi) if ca[a[i]] == 1 and a[i] in at]
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back.append(ends[p - 1] if p else -1)
        if p == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[p], ends[p] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in a, in b) of the lines that a patience diff pairs, ascending."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        found = _anchors(a, b, alo, ahi, blo, bhi) if alo < ahi and blo < bhi else []
        if found:
            bounds = [(alo, blo), *((i + 1, j + 1) for i, j in found)]
            out += found
            todo += [(i, x, j, y) for (i, j), (x, y) in zip(bounds, [*found, (ahi, bhi)], strict=True)]
    return sorted(out)


def blocks(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(place in the second, length) of the runs of neighbours among paired places."""
    out: list[list[int]] = []
    last = (-2, -2)
    for i, j in pairs:
        if (i, j) == (last[0] + 1, last[1] + 1):
            out[-1][1] += 1
        else:
            out.append([j, 1])
        last = i, j
    return [(j, n) for j, n in out]


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks that each later document (key, lines) of a pair shares with the lines of the earlier."""
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            row, place, length = [], [], []
            for k, (earlier, later) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                for j, n in blocks(patience(earlier, later)):
                    row.append(k)
                    place.append(j)
                    length.append(n)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int32())), pa.array(place, pa.int32()), pa.array(length, pa.int32())], names=["k", "place", "length"])


def _runs(full: F.Column, min_chars: int) -> F.Column:
    """Hashes of the runs of two lines or more, one from each line on, that reach min_chars characters with their last line."""
    add = lambda run, x: F.when(run["n"] >= min_chars, run).otherwise(F.struct(F.xxhash64(run["h"], x["h"]).alias("h"), (run["n"] + x["n"]).alias("n")))
    run = lambda x, i: F.when(x["n"] < min_chars, F.aggregate(F.slice(full, i + 2, min_chars), x, add))
    return F.transform(F.filter(F.transform(full, run), lambda x: x["n"] >= min_chars), lambda x: x["h"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the text's common blocks removed, n_lines (with words) and n_removed.

    The repeated lines with their first holders, and the pairs, are written to the checkpoint folder, as their numbers decide how they are dealt out.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    own = [f"c{i}" for i in range(len(kept))]
    place = kept.index(text_col)
    key = F.struct(F.xxhash64(docs[id_col], docs[text_col]).alias("k1"), F.xxhash64(F.lit(1), docs[id_col], docs[text_col]).alias("k2"))
    rows = docs.select(key.alias("k"), *(docs[c].alias(o) for c, o in zip(kept, own, strict=True)), F.coalesce(docs[id_col].cast("long"), F.lit((1 << 63) - 1)).alias("o"))
    # Lines without words stay outside the alignment: their hash is null.
    split = F.split(F.col(own[place]), "\n", -1)
    hashed = F.transform(split, lambda x: F.when(F.length(F.trim(x, F.lit(" \t\r\x0b\x0c"))) > 0, F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n"), F.xxhash64(F.lit(1), x).alias("own"))))
    full = rows.where(F.col(own[place]).isNotNull()).select("k", F.struct("o", "k").alias("order"), F.filter(hashed, lambda x: x.isNotNull()).alias("full"))
    bare = F.arrays_zip(F.col("full.h").alias("h"), F.col("full.n").alias("n"))
    runs = F.concat("full.h", _runs(bare, min_chars), _runs(F.reverse(bare), min_chars))
    lines = full.select("order", F.explode(F.array_distinct(runs)).alias("line"))
    firsts = lines.groupBy("line").agg(F.min("order").alias("first"), F.count("*").alias("n")).where("n > 1").checkpoint()
    total = firsts.agg(F.sum("n")).first()[0] or 0
    met = graph.meet(lines, firsts, "line", "n", total).where("order.k <> first.k")
    pairs = met.select(F.col("order.k").alias("later"), F.col("first.k").alias("earlier")).distinct().checkpoint()
    sequences = full.select("k", F.col("full.own").alias("hashes")).dropDuplicates(["k"])
    pairs = pairs.withColumn("cell", F.pmod(F.xxhash64("later"), F.lit(max(64, pairs.count() // 5000))))
    earlier = pairs.select("earlier", "cell").distinct().join(sequences.withColumnsRenamed({"k": "earlier", "hashes": "a"}), "earlier")
    both = pairs.join(sequences.withColumnsRenamed({"k": "later", "hashes": "b"}), "later").join(earlier, ["earlier", "cell"]).select("later", "a", "b")
    found = both.mapInArrow(_aligned, f"k {_KEY}, place int, length int").groupBy("k").agg(F.collect_set(F.struct("place", "length")).alias("found"))
    joined = rows.join(found, "k", "left").select(*own, "found")
    schema = T.StructType([T.StructField(c, joined.schema[o].dataType) for c, o in zip(kept, own, strict=True)] + [T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                got = [without(t, x or [], min_chars) for t, x in zip(part.column(place).to_pylist(), part.column(len(kept)).to_pylist(), strict=True)]
                columns = [part.column(i) for i in range(len(kept))]
                columns[place] = pa.array([g[0] for g in got], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], names=[*kept, "n_lines", "n_removed"])

    return joined.mapInArrow(run, schema)


def without(text: str | None, found: list[dict], min_chars: int) -> tuple[str | None, int, int]:
    """The text without the found blocks of lines with words, the number of such lines, and of those removed."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
    gone: set[int] = set()
    for x in found:
        block = full[x["place"] : x["place"] + x["length"]]
        if sum(len(lines[i]) for i in block) >= min_chars:
            gone.update(block)
    if not gone:
        return text, len(full), 0
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(full), len(gone)
