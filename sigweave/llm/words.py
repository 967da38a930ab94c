"""Word tokens and 64-bit hashes of whole texts, on numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D, which on UTF-8 is
the pattern ``[^\\x20\\x09-\\x0D]+``. Memory is bounded by BLOCK bytes of text at a
time plus one hash for each word of the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GEN = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _GEN.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_TABLE[_SPACE] = 0
_LOWER[_SPACE] = 0
_BASE = _U(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def mix(z: np.ndarray) -> np.ndarray:
    """Murmur3's 64-bit finalizer."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        z = (z ^ (z >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return z ^ (z >> _U(33))


def powers(n: int) -> np.ndarray:
    """_BASE to the powers 0 .. n-1, modulo 2**64."""
    global _POWERS
    while len(_POWERS) < n:
        with np.errstate(over="ignore"):
            last = _POWERS[-1] * _BASE
            _POWERS = np.concatenate([_POWERS, _POWERS * last])
    return _POWERS[:n]


def _hash_block(buf: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and one past the last byte of each word of a buffer."""
    space = _SPACE[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[0] = not space[0]
    edge[-1] = not space[-1]
    np.not_equal(space[1:], space[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    gap = np.diff(np.append(starts, len(buf)))
    place = np.arange(starts[0], len(buf)) - np.repeat(starts, gap)
    part = (_LOWER if lower else _TABLE)[buf[starts[0] :]]
    with np.errstate(over="ignore"):
        part *= powers(int(gap.max()))[place]
        h = np.add.reduceat(part, starts - starts[0])
        return mix(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)), starts, ends


def text_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """Hash of each word of one text of any length."""
    found, at = [], 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        found.append(_hash_block(np.frombuffer(text, np.uint8, end - at, at), lower)[0])
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK bytes each; a longer text stands alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > BLOCK:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts of a block and n+1 offsets of the texts in them."""
    if len(texts) == 1:
        h = text_hashes(texts[0], lower)
        return h, np.array([0, len(h)])
    joined = b"\n".join(texts)
    if not joined:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h, starts, _ = _hash_block(np.frombuffer(joined, np.uint8), lower)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(starts, begins)


def owners(offsets: np.ndarray) -> np.ndarray:
    """Index of the text that each word belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def windows(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and n+1 offsets of the texts in them."""
    counts = np.maximum(np.diff(offsets) - (k - 1), 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    if len(h) < k:
        return np.empty(0, np.uint64), out
    p = powers(k)
    with np.errstate(over="ignore"):
        g = h[: len(h) - k + 1] * p[k - 1]
        for j in range(1, k):
            g += h[j : len(h) - k + 1 + j] * p[k - 1 - j]
    own = owners(offsets)
    return mix(g[own[: len(g)] == own[k - 1 :]]), out


def shingles(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As windows(); a text of fewer than k words, but one at least, has one: the whole sequence."""
    g, at = windows(h, offsets, k)
    n = np.diff(offsets)
    short = np.flatnonzero((n > 0) & (n < k))
    if not len(short):
        return g, at
    own = np.concatenate([owners(at), short])
    with np.errstate(over="ignore"):
        extra = np.array([mix(np.array([(h[offsets[i] : offsets[i + 1]] * powers(k)[: n[i]]).sum() + _U(n[i])]))[0] for i in short], np.uint64)
    order = np.argsort(own, kind="stable")
    return np.concatenate([g, extra])[order], np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(n)))])


def unique_within(g: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text in ascending order, and their offsets."""
    own = owners(offsets)
    order = np.lexsort((g, own))
    g, own = g[order], own[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
    return g[keep], np.concatenate([[0], np.cumsum(np.bincount(own[keep], minlength=len(offsets) - 1))])


def encoded(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def is_space(buf: np.ndarray) -> np.ndarray:
    return _SPACE[buf]


def span_of(column: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The UTF-8 of a string column without nulls, and n+1 offsets of its rows in it."""
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return pa.py_buffer(b""), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    return data or pa.py_buffer(b""), np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)


def units(data: pa.Buffer, starts: np.ndarray, end: int) -> tuple[list[str], np.ndarray]:
    """The distinct units of text that begin at `starts` and go on to the next or to `end`, and the number of each unit among them. Units are compared whole."""
    at = np.append(starts, end).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), data).dictionary_encode()
    return found.dictionary.to_pylist(), np.asarray(found.indices)


def put_together(pieces: list[bytes] | pa.Array, which: np.ndarray, offsets: np.ndarray) -> pa.LargeBinaryArray:
    """For each row i the pieces numbered which[offsets[i] : offsets[i + 1]], one after the other."""
    flat = pa.array(pieces, pa.large_binary()).take(pa.array(which)) if isinstance(pieces, list) else pieces.take(pa.array(which))
    _, ends, data = flat.buffers()
    ends = np.frombuffer(ends, np.int64, len(flat) + 1) if len(flat) else np.zeros(1, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends[offsets])), data or pa.py_buffer(b"")])


def slices(offsets: np.ndarray, size: int = 4 * BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `size` bytes each; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


class Recent:
    """A bounded cache of two generations: what is asked for moves to the young one, and the old one goes when the young one is full."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, asked: list[str]) -> list[str]:
        """What has to be put into `young`; afterwards that holds all that was asked for."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        new = set(asked).difference(self.young)
        known = new.intersection(self.old)
        self.young.update(zip(known, map(self.old.__getitem__, known), strict=True))
        return list(new - known)

    def forget(self, new: list[str]) -> None:
        """Drops those of some entries that are too long to keep."""
        for w in new:
            if len(w) > 64:
                del self.young[w]


def bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and one past the last byte of each word of a buffer."""
    space = _SPACE[buf]
    edge = np.ones(len(buf) + 1, bool)
    if len(buf):
        edge[0], edge[-1] = not space[0], not space[-1]
        np.not_equal(space[1:], space[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    return at[0::2], at[1::2]


def cut(data: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """Pieces data[start:end], which may overlap, as a column."""
    return pa.array([data[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()).cast(pa.string())
