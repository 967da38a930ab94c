"""Packing of tokenized documents into sequences, by multiway differencing.

`cut` tokenizes whole texts and cuts each document's ids into pieces: whole windows first, and
what is left into parts of at most PART ids. `pack` deals the pieces into groups of about GROUP
and divides each group among windows by Karmarkar-Karp differencing: a partial partition is
a vector of window sums; the two with the largest spread are merged, the fullest windows of one
with the emptiest of the other, until one is left. The number of windows starts at the least
possible and rises by one while any window is over capacity.

Each id lies in exactly one piece, pieces of a window lie one after the other from offset 0,
and a group takes bounded memory at any input size. Null text is as empty: its document is the
end id alone. Repeated ids and rows are packed each on its own; a null id stays null. An
empty table gives no pieces. Other columns are not carried.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.llm import wordpieces, words

CAPACITY, PART, GROUP = 2048, 512, 4096
BLOCK = 1 << 23  # bytes of text that are tokenized at a time


def cuts(n: int, capacity: int = CAPACITY, part: int = PART) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole windows, then parts of `part` ids and a shorter last one."""
    whole = n - n % capacity
    return [(i, capacity) for i in range(0, whole, capacity)] + [(i, min(part, n - i)) for i in range(whole, n, part)]


def cut(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, part: int = PART, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]) of each piece."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens"))])
    if keep_ids:
        schema.add("ids", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = wordpieces.load(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            texts = b.column(1).fill_null("")
            for first, last in words.slices(words.span_of(texts)[1], BLOCK):
                row, rest, ids = [], [], []
                for i, got in enumerate(tokenizer.encode(texts.slice(first, last - first)).to_pylist(), first):
                    got += end
                    n = len(got) // 4
                    for start, length in cuts(n, capacity, part):
                        piece = got[start * 4 : (start + length) * 4]
                        row.append(i)
                        rest.append((start, length, zlib.crc32(piece), n))
                        if keep_ids:
                            ids.append(piece)
                columns = [b.column(0).take(pa.array(row, pa.int32())), *(pa.array(c) for c in np.array(rest, np.int64).reshape(-1, 4).T)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * keep_ids, schema.fieldNames())

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, schema)


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window, 0 to k-1, of each size, by Karmarkar-Karp differencing into k windows."""
    n = len(sizes)
    children: list[tuple[int, int]] = []  # of nodes n, n+1, ...: sets of sizes put together
    heap = [(-int(s), i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a, own_a = heapq.heappop(heap)
        _, _, b, own_b = heapq.heappop(heap)
        over = max(0, len(a) + len(b) - k)
        # Sums are in descending order: the emptiest windows of a meet the emptiest of b, but the fuller of the one the emptier of the other.
        low_a, low_b = a[len(a) - over :], b[len(b) - over :][::-1]
        new = np.arange(n + len(children), n + len(children) + over)
        children += zip(own_a[len(a) - over :].tolist(), own_b[len(b) - over :][::-1].tolist(), strict=True)
        sums = np.concatenate([a[: len(a) - over], b[: len(b) - over], low_a + low_b])
        own = np.concatenate([own_a[: len(a) - over], own_b[: len(b) - over], new])
        order = np.argsort(-sums, kind="stable")
        sums, own = sums[order], own[order]
        heapq.heappush(heap, (int(sums[-1]) * (len(sums) == k) - int(sums[0]), tie, sums, own))
        tie += 1
    at = np.zeros(n + len(children), np.int64)
    if heap:
        at[heap[0][3]] = np.arange(len(heap[0][3]))
    for i in range(len(children) - 1, -1, -1):
        at[list(children[i])] = at[n + i]
    return at[:n]


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Window of each size; no window over capacity."""
    out = np.zeros(len(sizes), np.int64)
    full = sizes >= capacity
    out[full] = np.arange(full.sum())
    rest = sizes[~full]
    k = max(1, -(-int(rest.sum()) // capacity))
    while True:
        at = difference(rest, k)
        if not len(rest) or np.bincount(at, rest).max() <= capacity:
            out[~full] = at + full.sum()
            return out
        k += 1


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces of any size up to capacity.

    The pieces are written to the checkpoint folder, as their number decides the number of groups.
    """
    held = pieces.checkpoint()
    groups = max(1, -(-held.count() // group))
    dealt = held.withColumn("__place", F.monotonically_increasing_id()).withColumn("__group", F.pmod(F.xxhash64("__place"), F.lit(groups)).cast("long"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__place", kind="stable")
        sizes, first = frame["length"].to_numpy(np.int64), int(frame["__group"].iat[0])
        at = windows(sizes, capacity)
        order = np.argsort(at, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        starts = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
        offset = np.empty(len(sizes), np.int64)
        offset[order] = before - np.repeat(before[starts], np.diff(np.r_[starts, len(sizes)]))
        return frame.drop(columns=["__place", "__group"]).assign(sequence_id=at * groups + first, offset=offset)

    return dealt.groupBy("__group").applyInPandas(run, schema)
