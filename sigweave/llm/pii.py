"""Personal data: format-preserving pseudonyms by keyed Feistel permutations, in DataFrame functions only.

Found and validated: payment cards (Luhn), phone numbers with a country code, IPv4 addresses (octets to 255),
US social security numbers (areas, groups and serials in use), ISO and day-first dates of 1900 to 2099
(calendar), e-mail addresses, and access keys (32 to 64 hex digits of one case; AKIA keys). Each is replaced by
another of its format: cards keep their first digit and a right check digit, dates stay dates, phone numbers keep their
country code and punctuation, addresses their domain. A permutation acts on the value, whatever its
punctuation, date layout or case of hex digits, so that equal values stay linked across documents and different ones apart; who
has the key can undo it. What does not validate stays as it is.

Null text stays null, with no replacements. Empty and very long texts, repeated rows and
an empty table need no care. All other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.llm.fingerprints import let

ROUNDS = 8
DAYS = 73049  # of 1900 to 2099: 17 * 4297
KINDS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16})(?![A-Za-z0-9])",
    "phone": r"\+[0-9]{1,3}[ -]?\(?[0-9]{3}\)?[ -]?[0-9]{3}[ -]?[0-9]{4}(?![0-9])",
    "card": r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![A-Za-z0-9])",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z])(?!\.[0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iso": r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z-])",
    "day": r"[0-9]{2}(?:/[0-9]{2}/|\.[0-9]{2}\.)[0-9]{4}(?![0-9A-Za-z])(?!\.[0-9])",
}
PATTERN = "(?<![A-Za-z0-9_.+-])(?:" + "|".join(KINDS.values()) + ")"


def _keyed(key: str, kind: str, i: Column, value: Column) -> Column:
    """A round's pseudo-random number of 60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A permutation of 0 .. a*b-1: halves modulo a and b, each in turn moved by a keyed function of the other."""
    pair = lambda x, y: F.struct(x.alias("l"), y.alias("r"))

    def turn(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(_keyed(key, kind, i, s["r"]), F.lit(a)), F.lit(a).cast("long"))
        right = F.pmod(s["r"] + F.pmod(_keyed(key, kind, i, s["l"]), F.lit(b)), F.lit(b).cast("long"))
        return pair(F.when(i % 2 == 0, left).otherwise(s["l"]), F.when(i % 2 == 1, right).otherwise(s["r"]))

    start = pair(F.call_function("div", value, F.lit(b)), F.pmod(value, F.lit(b).cast("long")))
    return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn), lambda s: s["l"] * b + s["r"])


LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def feistel_text(text: Column, alphabets: tuple[str, ...], key: str, kind: str) -> Column:
    """A permutation of the texts of one form: each character moves within its alphabet, the halves in turn by a keyed function of the other."""
    halves = lambda x, y: F.struct(x.alias("l"), y.alias("r"))
    n = F.char_length(text)

    def moved(half: Column, other: Column, i: Column) -> Column:
        def one(c: Column, j: Column) -> Column:
            told = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), F.call_function("div", j, F.lit(16)).cast("string"), F.array_join(other, "")), 256)
            by = F.conv(F.substring(told, (j % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            out = c
            for alphabet in alphabets:
                at = F.instr(F.lit(alphabet), c)
                out = F.when(at > 0, F.substring(F.lit(alphabet), (at - 1 + by) % len(alphabet) + 1, F.lit(1))).otherwise(out)
            return out

        return F.transform(half, one)

    def turn(s: Column, i: Column) -> Column:
        return halves(F.when(i % 2 == 0, moved(s["l"], s["r"], i)).otherwise(s["l"]), F.when(i % 2 == 1, moved(s["r"], s["l"], i)).otherwise(s["r"]))

    characters = F.split(text, "(?!^)")
    half = F.greatest(F.call_function("div", n, F.lit(2)).cast("int"), F.lit(1))
    start = halves(F.slice(characters, F.lit(1), half), F.slice(characters, half + 1, F.greatest((n - half).cast("int"), F.lit(0))))
    return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn), lambda s: F.array_join(F.concat(s["l"], s["r"]), ""))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refilled(m: Column, digits: Column) -> Column:
    """m with its digits replaced one by one."""
    c = lambda j: F.substring(m, j, F.lit(1))
    return let(digits, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(m)), lambda j: F.when(c(j).between("0", "9"), F.substring(d, F.char_length(_digits(F.substring(m, F.lit(1), j))), F.lit(1))).otherwise(c(j))), ""))


def _luhn(digits: Column, from_right: int) -> Column:
    """Luhn sum of digits, the last of which stands at a place from the right (0: the check digit)."""
    n = F.char_length(digits)

    def add(s: Column, j: Column) -> Column:
        v = F.substring(digits, j, F.lit(1)).cast("int")
        return s + F.when((n - j + from_right) % 2 == 1, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _number(d: Column, key: str, kind: str, n: int) -> Column:
    """n digits to n digits."""
    a, b = 10 ** (n // 2), 10 ** (n - n // 2)
    return F.lpad(feistel(d.cast("long"), a, b, key, kind).cast("string"), n, "0")


def _card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        out = m
        for n in range(13, 20):
            payload = F.concat(F.substring(d, 1, 1), _number(F.substring(d, 2, n - 2), key, f"card{n}", n - 2))
            whole = let(payload, lambda p: F.concat(p, ((10 - _luhn(p, 1) % 10) % 10).cast("string")))
            out = F.when(F.char_length(d) == n, _refilled(m, whole)).otherwise(out)
        return F.when(_luhn(d, 0) % 10 == 0, out).otherwise(m)

    return let(_digits(m), of)


def _phone(m: Column, key: str) -> Column:
    return let(_digits(m), lambda d: _refilled(m, F.concat(F.substring(d, F.lit(1), F.char_length(d) - 10), _number(F.substring(d, F.char_length(d) - 9, F.lit(10)), key, "phone", 10))))


def _ip(m: Column, key: str) -> Column:
    def of(o: Column) -> Column:
        value = feistel(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 1 << 16, 1 << 16, key, "ip")
        told = let(value, lambda v: F.concat_ws(".", *(F.shiftright(v, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0))))
        return F.when(F.array_max(o) <= 255, told).otherwise(m)

    return let(F.split(m, r"\.").cast("array<bigint>"), of)


def _ssn(m: Column, key: str) -> Column:
    def of(p: Column) -> Column:
        area, group, serial = p[0], p[1], p[2]
        right = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        value = (area - 1 - F.when(area > 666, 1).otherwise(0)) * (99 * 9999) + (group - 1) * 9999 + serial - 1

        def told(v: Column) -> Column:
            a = F.call_function("div", v, F.lit(99 * 9999))
            a = a + 1 + F.when(a >= 665, 1).otherwise(0)
            g = F.call_function("div", v, F.lit(9999)) % 99 + 1
            return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad(g.cast("string"), 2, "0"), F.lpad((v % 9999 + 1).cast("string"), 4, "0"))

        return F.when(right, let(feistel(F.when(right, value).otherwise(F.lit(0).cast("long")), 898, 99 * 9999, key, "ssn"), told)).otherwise(m)

    return let(F.split(m, "-").cast("array<bigint>"), of)


def _date(m: Column, key: str, iso: bool) -> Column:
    """Dates in either layout share one permutation of days."""
    plain = m if iso else F.concat(F.substring(m, 7, 4), F.lit("-"), F.substring(m, 4, 2), F.lit("-"), F.substring(m, 1, 2))

    def told(day: Column) -> Column:
        s = F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), day.cast("int")), "yyyy-MM-dd")
        if iso:
            return s
        mark = F.substring(m, 3, 1)
        return F.concat(F.substring(s, 9, 2), mark, F.substring(s, 6, 2), mark, F.substring(s, 1, 4))

    def of(day: Column) -> Column:
        inside = day.isNotNull() & day.between(0, DAYS - 1)
        return F.when(inside, let(feistel(F.when(inside, day).otherwise(0).cast("long"), 17, DAYS // 17, key, "date"), told)).otherwise(m)

    return let(F.datediff(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd")).cast("date"), F.lit("1900-01-01").cast("date")), of)


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(feistel_text(F.substring(m, F.lit(1), at - 1), (LOWER, UPPER, DIGITS), key, "email"), F.substring(m, at, F.char_length(m)))


def _secret(m: Column, key: str) -> Column:
    own = F.concat(F.lit("AKIA"), feistel_text(F.substring(m, F.lit(5), F.char_length(m)), (UPPER, DIGITS), key, "key"))
    told = let(feistel_text(F.lower(m), (HEX,), key, "hex"), lambda v: F.when(m.rlike("[A-F]"), F.upper(v)).otherwise(v))
    return F.when(m.startswith("AKIA"), own).otherwise(told)


def pseudonym(m: Column, key: str) -> Column:
    """Another value of a found string's kind, or the string itself if it does not validate."""
    whole = lambda kind: m.rlike(f"^(?:{KINDS[kind]})$")
    kinds: list[tuple[str, Callable[[], Column]]] = [
        ("email", lambda: _email(m, key)), ("secret", lambda: _secret(m, key)), ("phone", lambda: _phone(m, key)), ("card", lambda: _card(m, key)),
        ("ip", lambda: _ip(m, key)), ("ssn", lambda: _ssn(m, key)), ("iso", lambda: _date(m, key, True)), ("day", lambda: _date(m, key, False)),
    ]
    out = m
    for kind, f in reversed(kinds):
        out = F.when(whole(kind), f()).otherwise(out)
    return out


def _free(name: str, taken: list[str]) -> str:
    """A column name that no column has."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_private") -> DataFrame:
    """docs with the found values of a text column replaced, and the number of replacements; a column of the latter's name gives way to it."""
    text = docs[text_col]
    found = _free("found", [*docs.columns, count_col])
    new = _free("new", [*docs.columns, count_col, found])
    matches = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    between = F.split(text, PATTERN, -1)
    rows = docs.withColumn(found, matches).withColumn(new, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, key))).otherwise(F.col(found)))
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    parts = F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    told = F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(text)
    return rows.withColumns({count_col: F.coalesce(changed, F.lit(0)).cast("long"), text_col: told}).drop(found, new)
