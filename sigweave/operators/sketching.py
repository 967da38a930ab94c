"""Sketches of groups of rows: building, merging, expanding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sigweave.functions import kernels as k
from sigweave.functions.expressions import _ordered, empty_sketch
from sigweave.functions.hashing import _lists, matrix
from sigweave.spec import Spec

#: Rows that a task sketches at a time.
ROWS = 1 << 18


def _starts(columns: list[pa.Array], n: int) -> np.ndarray:
    """Where a row's keys differ from the row's before, null being equal to null."""
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        same = pc.or_kleene(pc.and_(a.is_null(), b.is_null()), pc.fill_null(pc.equal(a, b), False))
        new[1:] |= ~np.asarray(same)
    return np.flatnonzero(new)


def _codes(columns: list[pa.Array], n: int) -> np.ndarray:
    """A number for each row, equal for rows of equal keys, null being equal to null."""
    out = np.zeros(n, np.int64)
    for c in columns:
        found = c.dictionary_encode(null_encoding="encode")
        out = np.unique(out * (len(found.dictionary) + 1) + np.asarray(found.indices), return_inverse=True)[1]
    return out


def _least(d: np.ndarray, starts: np.ndarray, spec: Spec) -> np.ndarray:
    """The registers of runs of digests that begin at `starts`."""
    out = np.empty((len(starts), spec.permutations), np.uint64)
    if len(starts):
        for i, h in enumerate(k.stream(d, spec)):
            out[:, i] = np.minimum.reduceat(h, starts)
    return out


def _partial(spec: Spec, n_keys: int, from_digest: bool, rows: int):
    """A pass over unsorted rows (keys, value): for each group of so many rows its sketch, or its distinct digests while these are fewer than registers."""
    names = [f"k{i}" for i in range(n_keys)]

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys, value = t.columns[:n_keys], t.column(n_keys)
        if from_digest:
            d, there = np.asarray(value.fill_null(0)).view(np.uint64), np.asarray(value.is_valid())
        else:
            d, there = k.digest(value, spec.hasher)
        code = _codes(keys, t.num_rows)
        of_code = np.unique(code, return_index=True)[1]
        at = np.flatnonzero(there)
        at = at[np.lexsort((d[at], code[at]))]
        d, code = d[at], code[at]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (code[1:] != code[:-1])
        d, code = d[new], code[new]
        n = np.bincount(code, minlength=len(of_code))
        large = n >= spec.permutations
        inside = large[code]
        sketches = np.zeros((len(n), spec.permutations), np.uint64)
        sketches[large] = _least(d[inside], np.cumsum(n[large]) - n[large], spec)
        few = np.where(large, 0, n)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(few)]).astype(np.int32)), pa.array(d[~inside].view(np.int64)))
        return pa.RecordBatch.from_arrays([*(c.take(pa.array(of_code)) for c in keys), lists, _lists(sketches, large, spec)], names=[*names, "digests", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for first in range(0, whole.num_rows, rows):
                held.append(whole.slice(first, rows))
                size += held[-1].num_rows
                if size >= rows:
                    yield settle(held)
                    held, size = [], 0
        if held:
            yield settle(held)

    return run


def _merged(spec: Spec, n_keys: int):
    """A pass over the rows of _partial sorted by keys; the last group of a batch stays open for the next."""

    def registers_of(b: pa.RecordBatch) -> np.ndarray:
        lengths = np.asarray(b.column(n_keys).value_lengths().fill_null(0))
        out, there = matrix(b.column(n_keys + 1), spec)
        out[~there] = np.uint64(spec.kind.mask)
        some = np.flatnonzero(lengths)
        d = np.asarray(b.column(n_keys).flatten()).view(np.uint64)
        out[some] = np.minimum(out[some], _least(d, np.cumsum(lengths[some]) - lengths[some], spec))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[pa.Array], np.ndarray] | None = None
        step = max(1, (1 << 22) // spec.permutations)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                keys = [b.column(i) for i in range(n_keys)]
                starts = _starts(keys, b.num_rows)
                out = np.minimum.reduceat(registers_of(b), starts, axis=0)
                keys = [c.take(pa.array(starts)) for c in keys]
                if held is not None:
                    joined = [pa.concat_arrays([h, c.slice(0, 1)]) for h, c in zip(held[0], keys, strict=True)]
                    if len(_starts(joined, 2)) == 1:
                        out[0] = np.minimum(out[0], held[1])
                    else:
                        yield batch(held[0], held[1][None])
                n = len(starts)
                if n > 1:
                    yield batch([c.slice(0, n - 1) for c in keys], out[:-1])
                held = [c.slice(n - 1) for c in keys], out[-1].copy()
        if held is not None:
            yield batch(held[0], held[1][None])

    def batch(keys: list[pa.Array], words: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*keys, _lists(words, np.ones(len(words), bool), spec)], names=[f"k{i}" for i in range(len(keys))] + ["words"])

    return run


def minhash_agg(df: DataFrame, keys: list[str], value: str | Column, spec: Spec, rows: int = ROWS, from_digest: bool = False) -> DataFrame:
    """(keys, words): the sketch of the values of each group.

    Null values don't count; a group of nulls alone has the empty sketch, and without keys so has an empty
    table. Each task makes partial sketches of `rows` rows at a time, so that what goes through the one shuffle is a sketch, or fewer values than
    registers, for each group of each such lot, however many values the group has. Keys are of types that can be sorted. from_digest: the
    value is a BIGINT digest of one's own.
    """
    value = df[value] if isinstance(value, str) else value
    names = [f"k{i}" for i in range(len(keys))]
    given = df.select(*(df[c].alias(n) for c, n in zip(keys, names, strict=True)), value.alias("v"))
    if not keys:
        given, names = given.select(F.lit(0).alias("k0"), "v"), ["k0"]
    fields = [given.schema[n] for n in names]
    partial = given.mapInArrow(_partial(spec, len(names), from_digest, rows), T.StructType([*fields, T.StructField("digests", T.ArrayType(T.LongType())), T.StructField("words", spec.array)]))
    schema = T.StructType([*fields, T.StructField("words", spec.array)])
    if not keys:
        return union_agg(partial.mapInArrow(_merged(spec, 1), schema), [], "words", spec)
    return partial.repartition(*names).sortWithinPartitions(*names).mapInArrow(_merged(spec, len(names)), schema).toDF(*keys, "words")


def union_agg(df: DataFrame, keys: list[str], sketch: str, spec: Spec) -> DataFrame:
    """(keys, words): the union of each group's sketches; without keys one row, the empty sketch if there is none.

    Register-wise minima, with partial sums before the shuffle. Null sketches don't count; of another size they raise.
    """
    w = spec.kind
    sized = F.when(F.size(sketch) == spec.permutations, F.col(sketch)).otherwise(F.raise_error(F.lit("a sketch of another size")).cast("void"))
    rows = df.where(F.col(sketch).isNotNull()).select(*keys, F.posexplode(sized).alias("i", "h"))
    least = rows.groupBy(*keys, "i").agg(F.min(_ordered(F.col("h"), w)).alias("h")).withColumn("h", _ordered(F.col("h"), w).cast(w.storage))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
    if keys:
        return least.groupBy(*keys).agg(listed.alias("words"))
    return least.agg(listed.alias("words")).select(F.when(F.size("words") > 0, F.col("words")).otherwise(empty_sketch(spec)).alias("words"))


def registers(df: DataFrame, keys: list[str], sketch: str = "words") -> DataFrame:
    """(keys, i, h): a row for each register."""
    return df.select(*keys, F.posexplode(sketch).alias("i", "h"))


def sketch_arrays(df: DataFrame, array_id: str, counter: str, value: str, spec: Spec, n: int) -> DataFrame:
    """(array_id, counters): arrays of n independent sketches, each of the values of its counter number."""
    held = minhash_agg(df.where(F.col(counter).between(0, n - 1)), [array_id, counter], value, spec)
    found = F.map_from_entries(F.collect_list(F.struct(F.col(counter).cast("int"), "words")))
    counters = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.coalesce(F.try_element_at(F.col("m"), i), empty_sketch(spec)).alias("words")))
    return held.groupBy(array_id).agg(found.alias("m")).select(array_id, counters.alias("counters"))


def nearest(df: DataFrame, keys: list[str], pairs_score: str, n: int) -> DataFrame:
    """The n rows of each group with the largest score."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(pairs_score), *[c for c in df.columns if c not in keys and c != pairs_score]))
    return df.withColumn("turn", turn).where(F.col("turn") <= n).drop("turn")


__all__ = ["matrix", "minhash_agg", "nearest", "registers", "sketch_arrays", "union_agg"]
