"""Hash streams, sketches of arrays and band hashes as Arrow functions, and their SQL names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.functions import kernels as k
from sigweave.spec import FNV, SIP, Hasher, Spec


def _lists(values: np.ndarray, there: np.ndarray, spec: Spec) -> pa.Array:
    """Rows of registers as a list column; null where a row isn't there."""
    n, p = values.shape
    flat = pa.array(k.stored(np.ascontiguousarray(values), spec.kind).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p), flat, mask=pa.array(~there))


def matrix(column: pa.Array, spec: Spec, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A list column as rows of unsigned lanes; any other length than the sketch's raises."""
    size = size or spec.permutations
    there = np.asarray(column.is_valid())
    lengths = np.asarray(column.value_lengths().fill_null(size))
    if (lengths != size).any():
        raise ValueError(f"a sketch hasn't {size} registers")
    out = np.zeros((len(column), size), np.uint64)
    out[there] = k.loaded(np.asarray(column.drop_null().flatten()).reshape(-1, size), spec.kind)
    return out, there


def digest_udf(hasher: Hasher):
    """Digest of any hashable column, as BIGINT bits."""

    @F.arrow_udf(T.LongType())
    def digest(values: pa.Array) -> pa.Array:
        d, there = k.digest(values, hasher)
        return pa.array(d.view(np.int64), mask=~there)

    return digest


def digest(value: Column, hasher: Hasher = SIP) -> Column:
    return digest_udf(hasher)(value)


def hash_stream_udf(spec: Spec):
    @F.arrow_udf(spec.array)
    def hash_stream(values: pa.Array) -> pa.Array:
        d, there = k.digest(values, spec.hasher)
        return _lists(np.stack(list(k.stream(d, spec)), axis=1), there, spec)

    return hash_stream


def hash_stream(value: Column, spec: Spec) -> Column:
    """The hashes of a value, one for each register; null of null."""
    return hash_stream_udf(spec)(value)


def stream_of_digest(digest_: Column, spec: Spec) -> Column:
    """The hashes that follow from a digest of one's own, as BIGINT bits."""

    @F.arrow_udf(spec.array)
    def stream(values: pa.Array) -> pa.Array:
        there = np.asarray(values.is_valid())
        return _lists(np.stack(list(k.stream(np.asarray(values.fill_null(0)).view(np.uint64), spec)), axis=1), there, spec)

    return stream(digest_)


#: Elements that are digested at a time; values other than integers are Python objects meanwhile.
ELEMENTS = 1 << 17


def _runs(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Where to cut arrays into runs of at most so many elements, or of one array."""
    ends, cuts = np.cumsum(lengths), [0]
    while cuts[-1] < len(lengths):
        at = cuts[-1]
        cuts.append(max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ELEMENTS, "right"))))
    return list(zip(cuts, cuts[1:]))


def sketch_array_udf(spec: Spec):
    def filled(values: pa.Array, out: np.ndarray) -> None:
        lengths = np.asarray(values.value_lengths().fill_null(0))
        d, member = k.digest(values.flatten(), spec.hasher)
        own = np.repeat(np.arange(len(values)), lengths)[member]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else []
        for i, h in enumerate(k.stream(d[member], spec)):
            if len(own):
                out[own[starts], i] = np.minimum.reduceat(h, starts)

    @F.arrow_udf(spec.array)
    def sketch(values: pa.Array) -> pa.Array:
        out = np.full((len(values), spec.permutations), spec.kind.mask, np.uint64)
        for at, to in _runs(np.asarray(values.value_lengths().fill_null(0))):
            filled(values.slice(at, to - at), out[at:to])
        return _lists(out, np.asarray(values.is_valid()), spec)

    return sketch


def sketch_array(values: Column, spec: Spec) -> Column:
    """The sketch of an array's elements. Null elements don't count; an empty array has the empty sketch, null has null."""
    return sketch_array_udf(spec)(values)


def band_hashes_udf(spec: Spec, bands: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def band_hashes(sketches: pa.Array) -> pa.Array:
        words, there = matrix(sketches, spec)
        out = k.band_hashes(words, bands, spec.kind).view(np.int64).reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * bands), pa.array(out), mask=pa.array(~there))

    return band_hashes


def band_hashes(sketch: Column, spec: Spec, bands: int) -> Column:
    """The hash of each band of a sketch, in order; none for no bands."""
    return band_hashes_udf(spec, bands)(sketch)


def band_hash(words: Column, spec: Spec) -> Column:
    """The hash of any run of registers."""

    @F.arrow_udf(T.LongType())
    def band(column: pa.Array) -> pa.Array:
        lengths, there = np.asarray(column.value_lengths().fill_null(0)), np.asarray(column.is_valid())
        flat, at = np.asarray(column.flatten()), np.cumsum(lengths) - lengths
        out = np.zeros(len(column), np.uint64)
        for size in np.unique(lengths[there]):  # runs of one length make a matrix
            rows = np.flatnonzero(there & (lengths == size))
            words = k.loaded(flat[at[rows][:, None] + np.arange(size)], spec.kind) if size else np.zeros((len(rows), 0), np.uint64)
            out[rows] = k.band_hashes(words, 1, spec.kind)[:, 0]
        return pa.array(out.view(np.int64), mask=~there)

    return band(words)


def register_functions(spark: SparkSession, spec: Spec = Spec(), bands: int = 16, prefix: str = "minhash") -> None:
    """SQL names for a sketch's functions: PREFIX_stream, _sketch, _bands, _digest, and the table function _rows."""
    spark.udf.register(f"{prefix}_stream", hash_stream_udf(spec))
    spark.udf.register(f"{prefix}_sketch", sketch_array_udf(spec))
    spark.udf.register(f"{prefix}_bands", band_hashes_udf(spec, bands))
    spark.udf.register(f"{prefix}_digest", digest_udf(spec.hasher))

    class Rows:
        """(i, h) of each register's hash of a digest."""

        def eval(self, digest_: int):
            if digest_ is not None:
                for i, h in enumerate(k.stream(np.array([digest_], np.int64).view(np.uint64), spec)):
                    yield i, int(k.stored(h, spec.kind)[0])

    spark.udtf.register(f"{prefix}_rows", F.udtf(Rows, returnType="i int, h bigint"))


__all__ = ["FNV", "SIP", "band_hash", "band_hashes", "digest", "hash_stream", "register_functions", "sketch_array", "stream_of_digest"]
