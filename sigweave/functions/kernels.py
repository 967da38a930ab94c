"""Bit-exact hash kernels on numpy, on unsigned 64-bit lanes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from sigweave.spec import Hasher, Spec, Word

_U = np.uint64
M64 = (1 << 64) - 1
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def splitmix(z: np.ndarray) -> np.ndarray:
    """The finalizer alone, without an increment."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


def xorshift(x: np.ndarray, word: Word) -> np.ndarray:
    """One step; 16-bit words take the 32-bit step and are cut at its end."""
    a, b, c = map(_U, word.shifts)
    m = _U({8: 0xFF, 16: 0xFFFFFFFF, 32: 0xFFFFFFFF, 64: M64}[word.bits])
    x = x ^ ((x << a) & m)
    x = x ^ (x >> b)
    x = x ^ ((x << c) & m)
    return x & _U(word.mask)


def seed(digest: np.ndarray, word: Word) -> np.ndarray:
    """Two splitmix rounds, cut to the word's low bits; 0 becomes 1."""
    s = splitmix(splitmix(digest)) & _U(word.mask)
    return np.where(s == 0, _U(1), s)


def stream(digest: np.ndarray, spec: Spec):
    """The hashes of each digest for register 0, 1, ...: the generator steps before each."""
    x = seed(digest, spec.kind)
    for _ in range(spec.permutations):
        x = xorshift(x, spec.kind)
        x = np.where(x == 0, _U(1), x)
        yield x


def fnv(data: np.ndarray, keys: tuple[int, ...] = ()) -> np.ndarray:
    """FNV-1a of the rows of a byte matrix; a key takes the basis' place."""
    h = np.full(len(data), (keys or (FNV_BASIS,))[0] & M64, np.uint64)
    with np.errstate(over="ignore"):
        for column in data.T:
            h = (h ^ column.astype(np.uint64)) * _U(FNV_PRIME)
    return h


def _left(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def _rounds(v: list[np.ndarray], n: int) -> None:
    for _ in range(n):
        v[0] = v[0] + v[1]
        v[2] = v[2] + v[3]
        v[1] = _left(v[1], 13) ^ v[0]
        v[3] = _left(v[3], 16) ^ v[2]
        v[0] = _left(v[0], 32)
        v[2] = v[2] + v[1]
        v[0] = v[0] + v[3]
        v[1] = _left(v[1], 17) ^ v[2]
        v[3] = _left(v[3], 21) ^ v[0]
        v[2] = _left(v[2], 32)


def siphash(data: np.ndarray, keys: tuple[int, ...] = (), compress: int = 1, finish: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the 128-bit SipHash of the rows of a byte matrix."""
    k0, k1 = (k & M64 for k in (keys or (0, 0)))
    n, size = data.shape
    start = (k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D ^ 0xEE, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573)
    v = [np.full(n, x, np.uint64) for x in start]
    padded = np.zeros((n, size // 8 * 8 + 8), np.uint8)
    padded[:, :size] = data
    padded[:, -1] = size & 0xFF
    with np.errstate(over="ignore"):
        for m in np.ascontiguousarray(padded).view("<u8").astype(np.uint64).T:
            v[3] = v[3] ^ m
            _rounds(v, compress)
            v[0] = v[0] ^ m
        v[2] = v[2] ^ _U(0xEE)
        _rounds(v, finish)
        first = v[0] ^ v[1] ^ v[2] ^ v[3]
        v[1] = v[1] ^ _U(0xDD)
        _rounds(v, finish)
        return first, v[0] ^ v[1] ^ v[2] ^ v[3]


def digest_bytes(data: np.ndarray, hasher: Hasher) -> np.ndarray:
    """64-bit digest of the rows of a byte matrix; of SipHash the second half."""
    return fnv(data, hasher.keys) if hasher.family == "fnv" else siphash(data, hasher.keys)[1]


def encode(value: object, kind: pa.DataType) -> bytes:
    """The bytes of a nested value: integers little-endian at their own width, text with 0xFF behind it, lists with their length before them."""
    if pa.types.is_struct(kind):
        return b"".join(encode(value[f.name], f.type) for f in kind)
    if pa.types.is_list(kind):
        return len(value).to_bytes(8, "little") + b"".join(encode(v, kind.value_type) for v in value)
    if pa.types.is_binary(kind):
        return len(value).to_bytes(8, "little") + value
    if pa.types.is_string(kind):
        return value.encode() + b"\xff"
    if pa.types.is_boolean(kind):
        return bytes([value])
    if pa.types.is_integer(kind):
        return value.to_bytes(kind.bit_width // 8, "little", signed=True)
    raise TypeError(f"values of type {kind} can't be hashed")


def digest(column: pa.Array, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Digest of each value at its column's own width, and whether it is there; a null has no digest."""
    there = np.asarray(column.is_valid())
    out = np.zeros(len(column), np.uint64)
    kind = column.type
    if pa.types.is_integer(kind):
        flat = np.asarray(column.fill_null(0))
        data = np.ascontiguousarray(flat.astype(flat.dtype.newbyteorder("<"))).view(np.uint8).reshape(len(flat), flat.dtype.itemsize)
        return digest_bytes(data, hasher), there
    if pa.types.is_floating(kind) or pa.types.is_temporal(kind) or pa.types.is_decimal(kind):
        raise TypeError(f"values of type {kind} can't be hashed")
    rows = [None if v is None else encode(v, kind) for v in column.to_pylist()]
    sizes = np.array([-1 if r is None else len(r) for r in rows])
    for size in np.unique(sizes[sizes >= 0]):  # texts of one length make a matrix
        at = np.flatnonzero(sizes == size)
        data = np.frombuffer(b"".join(rows[i] for i in at), np.uint8).reshape(len(at), size)
        out[at] = digest_bytes(data, hasher)
    return out, there


def band_hashes(words: np.ndarray, bands: int, word: Word) -> np.ndarray:
    """FNV-1a of each band's registers at their own width; registers beyond bands * rows count for nothing."""
    n, p = words.shape
    rows = p // bands if bands else 0
    out = np.empty((n, bands), np.uint64)
    kind = np.dtype(f"<u{word.bits // 8}")
    for b in range(bands):
        data = np.ascontiguousarray(words[:, b * rows : (b + 1) * rows].astype(kind)).view(np.uint8).reshape(n, rows * word.bits // 8)
        out[:, b] = fnv(data)
    return out


def stored(words: np.ndarray, word: Word) -> np.ndarray:
    """Unsigned lanes as stored in Spark."""
    return words.view(np.int64) if word.bits == 64 else words.astype({8: np.int16, 16: np.int32, 32: np.int64}[word.bits])


def loaded(values: np.ndarray, word: Word) -> np.ndarray:
    return values.astype(np.int64).view(np.uint64) & _U(word.mask)
