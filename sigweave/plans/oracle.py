"""SQL text for DuckDB that says independently what the queries must return."""

from __future__ import annotations

import re

_WRAP = "18446744073709551616::UHUGEINT"
WIDTHS = {"u8": (8, 3, 7, 1, 8), "u16": (16, 13, 17, 5, 32), "u32": (32, 13, 17, 5, 32), "u64": (64, 13, 7, 17, 64)}


def times(a: str, b: str) -> str:
    return f"(({a})::UHUGEINT * ({b})::UHUGEINT % {_WRAP})::UBIGINT"


def plus(a: str, b: str) -> str:
    return f"((({a})::UHUGEINT + ({b})::UHUGEINT) % {_WRAP})::UBIGINT"


def left(a: str, n: int, bits: int = 64) -> str:
    return f"((({a}) & {(1 << (bits - n)) - 1}::UBIGINT) << {n})"


def rotated(a: str, n: int) -> str:
    return f"({left(a, n)} | (({a}) >> {64 - n}))"


def raw(a: str) -> str:
    """Unsigned bits as BIGINT."""
    return f"(CASE WHEN ({a}) >= 9223372036854775808 THEN (({a})::HUGEINT - 18446744073709551616)::BIGINT ELSE ({a})::BIGINT END)"


def unsigned(a: str) -> str:
    return f"(CASE WHEN ({a}) < 0 THEN (({a})::HUGEINT + 18446744073709551616)::UBIGINT ELSE ({a})::UBIGINT END)"


def steps(source: str, *columns: str) -> str:
    """source, with a column z going through expressions of z one after another."""
    for c in columns:
        source = f"SELECT * REPLACE ({c} AS z) FROM ({source})"
    return source


SPLITMIX = (times("xor(z, z >> 30)", "13787848793156543929"), times("xor(z, z >> 27)", "10723151780598845931"), "xor(z, z >> 31)")


def xorshift(word: str) -> tuple[str, ...]:
    bits, a, b, c, wide = WIDTHS[word]
    cut = (f"z & {(1 << bits) - 1}::UBIGINT",) if bits < wide else ()
    return (f"xor(z, {left('z', a, wide)})", f"xor(z, z >> {b})", f"xor(z, {left('z', c, wide)})", *cut)


def integer_bytes(a: str, width: int = 8) -> str:
    return f"list_transform(range(0, {width}), lambda i: ((({a})::BIGINT >> (8 * i)::INTEGER) & 255)::UBIGINT)"


def text_bytes(a: str) -> str:
    return f"list_concat(list_transform(range(0, octet_length(encode({a}))::BIGINT), lambda i: ('0x' || substr(hex(encode({a})), (2 * i + 1)::BIGINT, 2))::UTINYINT::UBIGINT), [255::UBIGINT])"


def fnv(data: str, key: int = 14695981039346656037) -> str:
    return f"list_reduce({data}, lambda h, b: {times('xor(h, b)', '1099511628211')}, {key}::UBIGINT)"


def siphash(source: str, key: str, keys: tuple[int, int] = (0, 0)) -> str:
    """source, with z the digest of its BIGINT column `key`."""
    k0, k1 = keys
    v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D ^ 0xEE, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]
    q = f"SELECT *, {unsigned(key)} AS m, {v[0]}::UBIGINT AS v0, {v[1]}::UBIGINT AS v1, {v[2]}::UBIGINT AS v2, {v[3]}::UBIGINT AS v3 FROM ({source})"

    def put(q: str, **new: str) -> str:
        return f"SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in new.items())}) FROM ({q})"

    def rounds(q: str, n: int) -> str:
        for _ in range(n):
            q = put(q, v0=plus("v0", "v1"), v2=plus("v2", "v3"))
            q = put(q, v1=f"xor({rotated('v1', 13)}, v0)", v3=f"xor({rotated('v3', 16)}, v2)", v0=rotated("v0", 32))
            q = put(q, v2=plus("v2", "v1"), v0=plus("v0", "v3"))
            q = put(q, v1=f"xor({rotated('v1', 17)}, v2)", v3=f"xor({rotated('v3', 21)}, v0)", v2=rotated("v2", 32))
        return q

    for m in ("m", f"{8 << 56}::UBIGINT"):
        q = put(q, v3=f"xor(v3, {m})")
        q = rounds(q, 1)
        q = put(q, v0=f"xor(v0, {m})")
    q = rounds(put(q, v2="xor(v2, 238::UBIGINT)"), 3)
    q = rounds(put(q, v1="xor(v1, 221::UBIGINT)"), 3)
    return f"SELECT * EXCLUDE (m, v0, v1, v2, v3), xor(xor(v0, v1), xor(v2, v3)) AS z FROM ({q})"


def registers(digests: str, p: int, word: str = "u64") -> str:
    """(columns of digests but z, i, h): the unsigned hashes for p registers of rows with a digest z."""
    mask = (1 << WIDTHS[word][0]) - 1
    seeds = steps(digests, *SPLITMIX, *SPLITMIX, f"CASE WHEN (z & {mask}::UBIGINT) = 0 THEN 1::UBIGINT ELSE z & {mask}::UBIGINT END")
    # A step expands to nested expressions of s, as a recursive query has one select for it.
    step = "s"
    for e in xorshift(word):
        step = re.sub(r"\bz\b", lambda _: f"({step})", e)  # noqa: B023
    return f"(WITH RECURSIVE seeds AS ({seeds}), r AS (SELECT * EXCLUDE (z), -1 AS i, z AS s FROM seeds UNION ALL SELECT * REPLACE (i + 1 AS i, {step} AS s) FROM r WHERE i < {p - 1}) SELECT * EXCLUDE (s), greatest(s, 1) AS h FROM r WHERE i >= 0)"


def digests(table: str, key: str, value: str, hasher: str = "fnv", keys: tuple[int, ...] = ()) -> str:
    source = f"SELECT DISTINCT {key} AS k, {value} AS v FROM {table}" if key else f"SELECT DISTINCT {value} AS v FROM {table}"
    if hasher == "fnv":
        return f"SELECT *, {fnv(integer_bytes('v'), *keys)} AS z FROM ({source})"
    return siphash(source, "v", keys or (0, 0))


def sketch(table: str, key: str, value: str, p: int, word: str = "u64", hasher: str = "fnv", keys: tuple[int, ...] = ()) -> str:
    """(k, i, h) in unsigned bits. Hashes are made once for each value, then joined to the groups."""
    values = registers(digests(table, "", value, hasher, keys), p, word)
    return f"SELECT g.k, r.i, min(r.h) AS h FROM (SELECT DISTINCT {key} AS k, {value} AS v FROM {table}) g JOIN {values} r USING (v) GROUP BY ALL"
