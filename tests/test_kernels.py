"""Scalar kernels: known values, and the Catalyst forms against numpy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigweave.functions import expressions as x
from sigweave.functions import kernels as k
from sigweave.functions.hashing import band_hash, digest, hash_stream
from sigweave.spec import FNV, SIP, WORDS, Hasher, Spec

U = np.uint64
EDGES = [0, 1, 42, 12345, 2**31, 2**32 - 1, 2**32, 2**63 - 1, 2**63, 2**64 - 1, 0xDEADBEEF1234ABCD]


@pytest.mark.parametrize(
    ("word", "value", "want"),
    [("u64", 1, 1082269761), ("u64", 12345, 13289605635609), ("u32", 1, 270369), ("u32", 12345, 3336926330), ("u16", 1, 8225), ("u16", 12345, 29818), ("u8", 1, 27), ("u8", 17, 168), ("usize", 1, 1082269761), ("usize", 12345, 13289605635609)],
)
def test_xorshift(word, value, want):
    assert int(k.xorshift(np.array([value], U), WORDS[word])[0]) == want


def test_narrow_words_are_bijections():
    for word, n in (("u8", 256), ("u16", 65536)):
        out = k.xorshift(np.arange(n, dtype=U), WORDS[word])
        assert len(np.unique(out)) == n and out[0] == 0


def test_splitmix():
    z = k.splitmix(np.array([0, 1], U))
    assert z.tolist() == [0, 6238072747940578789] and int(k.splitmix(z)[1]) == 8841707400507832957


def one(value, kind, hasher):
    return int(k.digest(pa.array([value], kind), hasher)[0][0])


def test_digests():
    assert one(1, pa.int64(), FNV) == 9929646806074584996 and one(1, pa.int32(), FNV) == 12478008331234465636
    assert one("abc", pa.string(), FNV) == 18165309246051714780
    assert one(42, pa.int64(), Hasher("fnv", (0x0123456789ABCDEF,))) == 11170752815835084901
    assert [one(v, pa.int64(), SIP) for v in (0, 1, 42)] == [11375155654212205663, 6705287596333789739, 15268047712177372079]
    assert one(42, pa.int32(), SIP) == 7719706982456774457 and one("abc", pa.string(), SIP) == 6435097591801663713
    assert one(42, pa.int64(), Hasher("sip13", (0x0123456789ABCDEF, 0xFEDCBA9876543210))) == 17870951898506832119


def test_siphash_published_vector():
    """SipHash-2-4 of 128 bits, empty input, key 00..0f."""
    key = tuple(int.from_bytes(bytes(range(i, i + 8)), "little") for i in (0, 8))
    a, b = k.siphash(np.zeros((1, 0), np.uint8), key, 2, 4)
    assert (int(a[0]).to_bytes(8, "little") + int(b[0]).to_bytes(8, "little")).hex() == "a3817f04ba25a8e66df67214c7550293"


@pytest.mark.parametrize(("hasher", "want"), [(FNV, [6107090181004601339, 5004290018017322356, 10580726218994651454, 6349293316951290780]), (SIP, [2595949224388254862, 9651106158563886775, 12808607292267682170, 691305296765184072])])
def test_stream(hasher, want):
    d, _ = k.digest(pa.array([42], pa.int64()), hasher)
    assert [int(h[0]) for h in k.stream(d, Spec(4, "u64", hasher))] == want


def test_zero_is_never_a_hash():
    d, _ = k.digest(pa.array(range(256), pa.int64()), FNV)
    assert min(int(h.min()) for h in k.stream(d, Spec(16, "u8", FNV))) > 0


def test_nested_values():
    kind = pa.struct([("a", pa.int32()), ("b", pa.list_(pa.string()))])
    assert k.encode({"a": 1, "b": ["x", "yz"]}, kind) == b"\x01\0\0\0" + (2).to_bytes(8, "little") + b"x\xffyz\xff"
    assert k.encode(b"ab", pa.binary()) == (2).to_bytes(8, "little") + b"ab" and k.encode(True, pa.bool_()) == b"\x01"
    for bad in (pa.array([1.5]), pa.array([1], pa.timestamp("us"))):
        with pytest.raises(TypeError):
            k.digest(bad, FNV)


def test_band_hash(spark):
    assert int(k.band_hashes(np.array([[1, 2, 3]], U), 1, WORDS["u64"])[0, 0]) == 15720935049292226309
    assert int(k.band_hashes(np.array([[1, 2, 3]], U), 1, WORDS["u8"])[0, 0]) == 15035938162879559083
    assert int(k.band_hashes(np.empty((1, 0), U), 1, WORDS["u64"])[0, 0]) == k.FNV_BASIS
    rows = spark.createDataFrame([([1, 2, 3],), ([3, 2, 1],), ([],), (None,)], "w array<bigint>")
    got = [r[0] for r in rows.select(band_hash(F.col("w"), Spec(3))).collect()]
    assert got[0] == x.signed(15720935049292226309) and got[1] != got[0] and got[2] == x.signed(k.FNV_BASIS) and got[3] is None


def test_catalyst_forms(spark):
    rows = spark.createDataFrame([(x.signed(v),) for v in EDGES], "v bigint").coalesce(1)
    v, a = F.col("v"), np.array(EDGES, U)
    got = rows.select(x.splitmix(v).alias("s"), *(x.xorshift(x.narrow(v, w), w).alias(w) for w in WORDS), x.fnv_integer(v, 8).alias("f"), x.fnv_integer(v, 8, 99).alias("g")).collect()
    assert [r.s for r in got] == k.splitmix(a).view(np.int64).tolist()
    for w in WORDS:
        assert [r[w] for r in got] == k.xorshift(a & U(WORDS[w].mask), WORDS[w]).view(np.int64).tolist()
    column = pa.array(a.view(np.int64))
    assert [r.f for r in got] == k.digest(column, FNV)[0].view(np.int64).tolist()
    assert [r.g for r in got] == k.digest(column, Hasher("fnv", (99,)))[0].view(np.int64).tolist()


def test_columns_keep_their_width(spark):
    rows = spark.createDataFrame([(1, 1, "abc", None)], "a int, b bigint, c string, d int")
    r = rows.select(*(digest(F.col(c), FNV).alias(c) for c in "abcd"), hash_stream(F.col("d"), Spec(4)).alias("e")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (x.signed(12478008331234465636), x.signed(9929646806074584996), x.signed(18165309246051714780), None, None)


def test_bad_specs():
    for bad in (lambda: Spec(0), lambda: Spec(4, "u128"), lambda: Hasher("sip13", (1,)), lambda: Hasher("md5")):
        with pytest.raises(ValueError):
            bad()
