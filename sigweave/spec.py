"""What a sketch is made of: register width, number of registers, and hash family."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

BIAS = -(1 << 63)


@dataclass(frozen=True)
class Word:
    """A register type. `storage` is the Spark type of its values; 64-bit words are kept as raw bits."""

    name: str
    bits: int
    storage: T.DataType
    shifts: tuple[int, int, int]

    @property
    def sentinel(self) -> int:
        """The largest value, as stored: what an untouched register holds."""
        return -1 if self.bits == 64 else (1 << self.bits) - 1

    @property
    def mask(self) -> int:
        return (1 << self.bits) - 1


WORDS = {
    w.name: w
    for w in (
        Word("u8", 8, T.ShortType(), (3, 7, 1)),
        Word("u16", 16, T.IntegerType(), (13, 17, 5)),
        Word("u32", 32, T.LongType(), (13, 17, 5)),
        Word("u64", 64, T.LongType(), (13, 7, 17)),
        Word("usize", 64, T.LongType(), (13, 7, 17)),
    )
}


def register_word(word: Word) -> None:
    """Adds a register type of one's own; its bits must be those of a known kernel."""
    WORDS[word.name] = word


@dataclass(frozen=True)
class Hasher:
    """`sip13` with no or two keys, or `fnv` with no key or one."""

    family: str
    keys: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        if self.family not in ("sip13", "fnv") or len(self.keys) not in {"sip13": (0, 2), "fnv": (0, 1)}[self.family]:
            raise ValueError(f"no such hash family: {self}")


SIP, FNV = Hasher("sip13"), Hasher("fnv")


@dataclass(frozen=True)
class Spec:
    """A sketch of `permutations` registers of a word type, filled by a hash family."""

    permutations: int = 128
    word: str = "u64"
    hasher: Hasher = field(default=SIP)

    def __post_init__(self) -> None:
        if self.permutations < 1 or self.word not in WORDS:
            raise ValueError(f"no such sketch: {self}")

    @property
    def kind(self) -> Word:
        return WORDS[self.word]

    @property
    def array(self) -> T.ArrayType:
        return T.ArrayType(self.kind.storage)
