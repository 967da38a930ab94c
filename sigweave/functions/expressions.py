"""Scalar kernels and sketch functions as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigweave.spec import BIAS, WORDS, Spec, Word

_LOW = 0xFFFFFFFF


def signed(x: int) -> int:
    """A 64-bit pattern as BIGINT."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), f)[0]


def times(x: Column, by: int) -> Column:
    """Wrapping 64-bit product of a cheap expression. Under ANSI rules * raises, so that 32-bit halves of x meet 16-bit parts of the factor, and no sum reaches 63 bits."""
    m = F.lit(_LOW)
    lo, hi = x.bitwiseAND(m), F.shiftrightunsigned(x, 32)
    part = [F.lit((by >> (16 * i)) & 0xFFFF).cast("long") for i in range(4)]
    p0, p1 = lo * part[0], lo * part[1]
    low = p0.bitwiseAND(m) + F.shiftleft(p1, 16).bitwiseAND(m)
    cut = lambda y: F.shiftleft(y.bitwiseAND(F.lit(0xFFFF)), 16)
    high = F.shiftrightunsigned(p0, 32) + F.shiftrightunsigned(p1, 16) + F.shiftrightunsigned(low, 32) + lo * part[2] + cut(lo * part[3]) + hi * part[0] + cut(hi * part[1])
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(m))


def splitmix(x: Column) -> Column:
    """The finalizer of BIGINT bits."""
    step = lambda n: lambda z: z.bitwiseXOR(F.shiftrightunsigned(z, n))
    z = let(let(x, step(30)), lambda v: times(v, 0xBF58476D1CE4E5B9))
    z = let(let(z, step(27)), lambda v: times(v, 0x94D049BB133111EB))
    return let(z, step(31))


def xorshift(x: Column, word: str = "u64") -> Column:
    """One generator step of a word given as BIGINT bits."""
    w = WORDS[word]
    a, b, c = w.shifts
    m = {8: 0xFF, 16: _LOW, 32: _LOW, 64: -1}[w.bits]
    x = let(x, lambda v: v.bitwiseXOR(F.shiftleft(v, a).bitwiseAND(F.lit(m))))
    x = let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, b)))
    x = let(x, lambda v: v.bitwiseXOR(F.shiftleft(v, c).bitwiseAND(F.lit(m))))
    return narrow(x, word)


def narrow(x: Column, word: str) -> Column:
    """The low bits."""
    w = WORDS[word]
    return x if w.bits == 64 else x.bitwiseAND(F.lit(w.mask))


def maximal(word: str) -> Column:
    return F.lit(WORDS[word].sentinel).cast(WORDS[word].storage)


def fnv_integer(x: Column, width: int, key: int | None = None) -> Column:
    """FNV-1a of an integer's little-endian bytes at a width of 1 to 8."""
    start = F.lit(signed(0xCBF29CE484222325 if key is None else key)).cast("long")

    def absorb(h: Column, i: Column) -> Column:
        byte = F.call_function("shiftright", x.cast("long"), i * 8).bitwiseAND(F.lit(255))
        return let(h.bitwiseXOR(byte), lambda v: times(v, 0x100000001B3))

    return F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), start, absorb)


# --- sketches, as arrays of registers


def _ordered(x: Column, w: Word) -> Column:
    """A register's place in unsigned order."""
    return x.bitwiseXOR(F.lit(BIAS)) if w.bits == 64 else x


def _alike(a: Column, b: Column, then: Column) -> Column:
    """`then`, once the sketches are known to have as many registers; zip_with alone would pad the shorter."""
    return F.when(F.size(a) == F.size(b), then).otherwise(F.raise_error(F.lit("sketches of different size")).cast("void"))


def empty_sketch(spec: Spec) -> Column:
    return F.array_repeat(maximal(spec.word), spec.permutations)


def is_empty(sketch: Column, spec: Spec) -> Column:
    return F.forall(sketch, lambda w: w == maximal(spec.word))


def is_full(sketch: Column) -> Column:
    """All registers are 1, the least hash; 0 is never made."""
    return F.forall(sketch, lambda w: w == 1)


def number_of_permutations(sketch: Column) -> Column:
    return F.size(sketch)


def memory_bits(sketch: Column, spec: Spec) -> Column:
    return F.size(sketch).cast("long") * spec.kind.bits


def register(sketch: Column, i: int | Column) -> Column:
    """A register by its place from 0; beyond the end it raises."""
    return sketch[i]


def with_register(sketch: Column, i: int, value: Column) -> Column:
    changed = F.transform(sketch, lambda w, k: F.when(k == i, value).otherwise(w))
    return F.when(F.size(sketch) > i, changed).otherwise(F.raise_error(F.lit("no such register")).cast("void"))


def map_words(sketch: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Each register as f(register, place) makes it."""
    return F.transform(sketch, f)


def words_slice(sketch: Column, start: int, length: int) -> Column:
    return F.slice(sketch, start + 1, length)


def union(a: Column, b: Column, spec: Spec) -> Column:
    """The sketch of both sets: register-wise the unsigned minimum."""
    w = spec.kind
    least = lambda x, y: _ordered(F.least(_ordered(x, w), _ordered(y, w)), w)
    return _alike(a, b, F.zip_with(a, b, least))


def jaccard(a: Column, b: Column) -> Column:
    """Share of equal registers."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return _alike(a, b, same / F.size(a).cast("double"))


def may_contain(sketch: Column, hashes: Column, spec: Spec) -> Column:
    """Whether no register exceeds the value's hash; never false of a member."""
    w = spec.kind
    return _alike(sketch, hashes, F.forall(F.zip_with(sketch, hashes, lambda x, y: _ordered(x, w) <= _ordered(y, w)), lambda x: x))


def band_matches(a: Column, b: Column) -> Column:
    """Places, ascending, where two arrays of band hashes agree."""
    places = F.transform(F.zip_with(a, b, lambda x, y: x == y), lambda m, i: F.when(m, i))
    return _alike(a, b, F.filter(places, lambda i: i.isNotNull()))


def any_band(a: Column, b: Column) -> Column:
    return _alike(a, b, F.exists(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def empty_array(spec: Spec, n: int) -> Column:
    """n independent sketches."""
    return F.array_repeat(F.struct(empty_sketch(spec).alias("words")), n)


def counter(array: Column, i: int | Column) -> Column:
    return array[i]["words"]


def with_counter(array: Column, i: int, sketch: Column) -> Column:
    changed = F.transform(array, lambda c, k: F.when(k == i, F.struct(sketch.alias("words"))).otherwise(c))
    return F.when(F.size(array) > i, changed).otherwise(F.raise_error(F.lit("no such counter")).cast("void"))


def exact_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)).cast("double"))
