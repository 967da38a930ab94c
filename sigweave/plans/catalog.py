"""The registered queries: each operator over the driver's tables, and SQL for what it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.functions import expressions as x
from sigweave.functions.hashing import band_hash, band_hashes, digest, hash_stream, sketch_array, stream_of_digest
from sigweave.operators import pairs
from sigweave.operators import similarity as sim
from sigweave.operators.sketching import minhash_agg, registers, sketch_arrays, union_agg
from sigweave.plans import accuracy
from sigweave.plans import oracle as o
from sigweave.sources import serial
from sigweave.spec import FNV, SIP, Hasher, Spec

Query = Callable[[SparkSession, str], DataFrame]
P = 16
KEY, KEYS = 0x0123456789ABCDEF, (0x0123456789ABCDEF, 0xFEDCBA9876543210)
U64 = Spec(P, "u64", FNV)
WIDE = Spec(128, "u64", FNV)
WIDE_BANDS = 32
#: How many bytes of rows go to a Python worker at once.
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- scalar kernels

_KEYS = "SELECT o_orderkey, o_orderkey::UBIGINT AS z FROM orders"


@query("splitmix_values", f"SELECT o_orderkey, {o.raw('z')} AS mixed FROM ({o.steps(_KEYS, *o.SPLITMIX)})")
def splitmix_values(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", x.splitmix(F.col("o_orderkey")).alias("mixed"))


def _shifted(word: str) -> None:
    mask = (1 << o.WIDTHS[word][0]) - 1

    @query(f"xorshift_{word}", f"SELECT o_orderkey, {o.raw('z')} AS shifted FROM ({o.steps(_KEYS, f'z & {mask}::UBIGINT', *o.xorshift(word))})")
    def xorshift(spark, sf):
        return table(spark, sf, "orders").select("o_orderkey", x.xorshift(x.narrow(F.col("o_orderkey"), word), word).alias("shifted"))


for _w in o.WIDTHS:
    _shifted(_w)


@query("narrow_values", f"SELECT o_orderkey, {', '.join(f'(z & {(1 << b) - 1}::UBIGINT)::BIGINT AS u{b}' for b in (8, 16, 32))} FROM ({o.steps(_KEYS, *o.SPLITMIX)})")
def narrow_values(spark, sf):
    mixed = table(spark, sf, "orders").select("o_orderkey", x.splitmix(F.col("o_orderkey")).alias("z"))
    return mixed.select("o_orderkey", *(x.narrow(F.col("z"), w).alias(w) for w in ("u8", "u16", "u32")))


@query("fnv_digest_bigint", f"SELECT o_orderkey, {o.raw(o.fnv(o.integer_bytes('o_orderkey')))} AS digest, {o.raw(o.fnv(o.integer_bytes('o_orderkey')))} AS native FROM orders")
def fnv_digest_bigint(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", digest(F.col("o_orderkey"), FNV).alias("digest"), x.fnv_integer(F.col("o_orderkey"), 8).alias("native"))


@query("fnv_digest_int", f"SELECT l_orderkey, l_linenumber, {o.raw(o.fnv(o.integer_bytes('l_linenumber', 4)))} AS digest FROM lineitem")
def fnv_digest_int(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", digest(F.col("l_linenumber"), FNV).alias("digest"))


@query("fnv_digest_string", f"SELECT c_custkey, {o.raw(o.fnv(o.text_bytes('c_name')))} AS digest FROM customer")
def fnv_digest_string(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", digest(F.col("c_name"), FNV).alias("digest"))


@query("fnv_keyed_digest", f"SELECT o_orderkey, {o.raw(o.fnv(o.integer_bytes('o_orderkey'), KEY))} AS digest FROM orders")
def fnv_keyed_digest(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", digest(F.col("o_orderkey"), Hasher("fnv", (KEY,))).alias("digest"))


def _sip(name: str, keys: tuple[int, ...]) -> None:
    @query(name, f"SELECT o_orderkey, {o.raw('z')} AS digest FROM ({o.siphash('SELECT o_orderkey FROM orders', 'o_orderkey', keys or (0, 0))})")
    def sip_digest(spark, sf):
        return table(spark, sf, "orders").select("o_orderkey", digest(F.col("o_orderkey"), Hasher("sip13", keys)).alias("digest"))


_sip("sip_digest", ())
_sip("sip_keyed_digest", KEYS)


def _stream(name: str, hasher: Hasher) -> None:
    sql = o.registers(o.digests("part", "", "p_partkey", hasher.family if hasher.family == "fnv" else "sip", hasher.keys), 8)

    @query(name, f"SELECT v AS p_partkey, i::BIGINT AS i, {o.raw('h')} AS h FROM {sql}")
    def stream(spark, sf):
        rows = table(spark, sf, "part").select("p_partkey").distinct()
        return rows.select("p_partkey", F.posexplode(hash_stream(F.col("p_partkey"), Spec(8, "u64", hasher))).alias("i", "h")).withColumn("i", F.col("i").cast("long"))


for _name, _h in (("fnv", FNV), ("keyed_fnv", Hasher("fnv", (KEY,))), ("sip", SIP), ("keyed_sip", Hasher("sip13", KEYS))):
    _stream(f"hash_stream_{_name}", _h)


@query("hash_stream_custom_digest", f"SELECT v AS p_partkey, i::BIGINT AS i, {o.raw('h')} AS h FROM {o.registers('SELECT DISTINCT p_partkey AS v, (p_partkey * 3 + 1)::UBIGINT AS z FROM part', 8)}")
def hash_stream_custom_digest(spark, sf):
    """A hasher of the caller's own: any BIGINT."""
    rows = table(spark, sf, "part").select("p_partkey").distinct()
    return rows.select("p_partkey", F.posexplode(stream_of_digest(F.col("p_partkey") * 3 + 1, Spec(8))).alias("i", "h")).withColumn("i", F.col("i").cast("long"))


# --- building sketches


def suppliers(spark: SparkSession, sf: str, spec: Spec) -> DataFrame:
    """(l_suppkey, words): the parts that each supplier ships."""
    return minhash_agg(table(spark, sf, "lineitem"), ["l_suppkey"], "l_partkey", spec)


def long_form(df: DataFrame, key: str) -> DataFrame:
    return registers(df, [key]).select(key, F.col("i").cast("long").alias("i"), F.col("h").cast("long").alias("h"))


def parts_sql(p: int = P, word: str = "u64", family: str = "fnv", keys: tuple[int, ...] = ()) -> str:
    return o.sketch("lineitem", "l_suppkey", "l_partkey", p, word, family, keys)


def _sketch(name: str, spec: Spec) -> None:
    sql = parts_sql(spec.permutations, spec.word, "fnv" if spec.hasher.family == "fnv" else "sip", spec.hasher.keys)

    @query(name, f"SELECT k AS l_suppkey, i::BIGINT AS i, {o.raw('h')} AS h FROM ({sql})")
    def sketch_supplier_parts(spark, sf):
        return long_form(suppliers(spark, sf, spec), "l_suppkey")


for _w in o.WIDTHS:
    _sketch(f"sketch_supplier_parts_{_w}", Spec(P, _w, FNV))
_sketch("sketch_keyed_fnv", Spec(P, "u64", Hasher("fnv", (KEY,))))
_sketch("sketch_sip", Spec(P, "u64", SIP))
_sketch("sketch_keyed_sip", Spec(P, "u64", Hasher("sip13", KEYS)))


@query("sketch_in_parts", f"SELECT k AS l_suppkey, i::BIGINT AS i, {o.raw('h')} AS h FROM ({parts_sql()})")
def sketch_in_parts(spark, sf):
    """From many small lots of rows, merged."""
    return long_form(minhash_agg(table(spark, sf, "lineitem"), ["l_suppkey"], "l_partkey", U64, rows=500), "l_suppkey")


@query("sketch_of_all", f"SELECT i::BIGINT AS i, {o.raw('min(h)')} AS h FROM {o.registers(o.digests('lineitem', '', 'l_partkey'), P)} GROUP BY i")
def sketch_of_all(spark, sf):
    out = minhash_agg(table(spark, sf, "lineitem"), [], "l_partkey", U64)
    return out.select(F.posexplode("words").alias("i", "h")).withColumn("i", F.col("i").cast("long"))


@query("sketch_of_arrays", f"SELECT k AS o_custkey, i::BIGINT AS i, {o.raw('h')} AS h FROM ({o.sketch('orders', 'o_custkey', 'o_orderkey', P)})")
def sketch_of_arrays(spark, sf):
    """From collected sets, without keys."""
    sets = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderkey").alias("s"))
    return long_form(sets.select("o_custkey", sketch_array(F.col("s"), U64).alias("words")), "o_custkey")


# --- merging and comparing

_LISTED = "SELECT k, list(h ORDER BY i) AS w FROM ({}) GROUP BY k"


@query("sketch_union_by_nation", f"SELECT s_nationkey::BIGINT AS s_nationkey, i::BIGINT AS i, {o.raw('min(h)')} AS h FROM ({parts_sql()}) JOIN supplier ON k = s_suppkey GROUP BY s_nationkey, i")
def sketch_union_by_nation(spark, sf):
    joined = suppliers(spark, sf, U64).join(table(spark, sf, "supplier"), F.expr("l_suppkey = s_suppkey"))
    return long_form(union_agg(joined.withColumn("s_nationkey", F.col("s_nationkey").cast("long")), ["s_nationkey"], "words", U64), "s_nationkey")


def nations(spark: SparkSession, sf: str) -> DataFrame:
    """(l_suppkey, nation) of suppliers."""
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("nation"))


def neighbours(spark: SparkSession, sf: str, spec: Spec) -> DataFrame:
    """(nation, id, words) of suppliers; only those of one nation are paired."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("nation"))
    return suppliers(spark, sf, spec).join(s, F.expr("l_suppkey = id")).select("nation", "id", "words")


_PAIRED = f"WITH s AS ({_LISTED.format(parts_sql())}), n AS (SELECT s_nationkey::BIGINT AS nation, k, w FROM s JOIN supplier ON k = s_suppkey) SELECT a.nation, a.k AS left_id, b.k AS right_id, {{}} FROM n a JOIN n b ON a.nation = b.nation AND a.k < b.k"


@query("sketch_union_pairs", _PAIRED.format(f"unnest(list_transform(range(0, {P}), lambda i: {o.raw('least(a.w[i + 1], b.w[i + 1])')})) AS h, unnest(range(0, {P})) AS i"))
def sketch_union_pairs(spark, sf):
    return pairs.unions(neighbours(spark, sf, U64), ["nation"], "id", "words", U64)


@query("sketch_jaccard_pairs", _PAIRED.format(f"list_sum(list_transform(range(1, {P + 1}), lambda i: (a.w[i] = b.w[i])::INTEGER))::DOUBLE / {P} AS jaccard"))
def sketch_jaccard_pairs(spark, sf):
    return pairs.estimates(neighbours(spark, sf, U64), ["nation"], "id", "words", U64)


@query(
    "exact_jaccard_pairs",
    """WITH s AS (SELECT s_nationkey::BIGINT AS nation, l_suppkey AS k, list(DISTINCT l_partkey) AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
    SELECT a.nation, a.k AS left_id, b.k AS right_id, round(len(list_intersect(a.p, b.p)) / (len(a.p) + len(b.p) - len(list_intersect(a.p, b.p)))::DOUBLE, 9) AS jaccard
    FROM s a JOIN s b ON a.nation = b.nation AND a.k < b.k""",
)
def exact_jaccard_pairs(spark, sf):
    found = pairs.exact_jaccard_pairs(table(spark, sf, "lineitem"), nations(spark, sf), ["nation"], "l_suppkey", "l_partkey")
    # Most pairs share nothing; rounding is dear.
    return found.withColumn("jaccard", F.when(F.col("jaccard") == 0, F.lit(0.0)).otherwise(F.round("jaccard", 9)))


def _contains(name: str, hasher: Hasher) -> None:
    family = "fnv" if hasher.family == "fnv" else "sip"
    values = o.registers(o.digests("orders", "", "o_custkey", family, hasher.keys), 4)
    sets = o.sketch("lineitem", "l_returnflag || l_linestatus", "l_partkey", 4, "u64", family, hasher.keys)

    @query(name, f"SELECT s.k AS flag, v.v AS o_custkey, bool_and(s.h <= v.h) AS may FROM ({sets}) s JOIN {values} v USING (i) GROUP BY ALL")
    def may_contain(spark, sf):
        spec = Spec(4, "u64", hasher)
        rows = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("flag"), "l_partkey")
        sets = minhash_agg(rows, ["flag"], "l_partkey", spec)
        values = table(spark, sf, "orders").select("o_custkey").distinct().select("o_custkey", hash_stream(F.col("o_custkey"), spec).alias("h"))
        # The sketches are one for each of a handful of flags; each value meets them all.
        return values.crossJoin(F.broadcast(sets)).select("flag", "o_custkey", x.may_contain(F.col("words"), F.col("h"), spec).alias("may"))


for _name, _h in (("fnv", FNV), ("keyed_fnv", Hasher("fnv", (KEY,))), ("sip", SIP), ("keyed_sip", Hasher("sip13", KEYS))):
    _contains(f"may_contain_{_name}", _h)


@query("sketch_states", f"SELECT k AS l_suppkey, bool_and(h = 255) AS is_empty, bool_and(h = 1) AS is_full, count(*)::BIGINT AS permutations, (count(*) * 8)::BIGINT AS memory FROM ({parts_sql(P, 'u8')}) GROUP BY k")
def sketch_states(spark, sf):
    spec, w = Spec(P, "u8", FNV), F.col("words")
    return suppliers(spark, sf, spec).select("l_suppkey", x.is_empty(w, spec).alias("is_empty"), x.is_full(w).alias("is_full"), x.number_of_permutations(w).cast("long").alias("permutations"), x.memory_bits(w, spec).alias("memory"))


@query("sketch_empty", f"SELECT r_regionkey::BIGINT AS r_regionkey, true AS is_empty, false AS is_full, -1::BIGINT AS first, {P}::BIGINT AS size FROM region")
def sketch_empty(spark, sf):
    w = x.empty_sketch(U64)
    return table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), x.is_empty(w, U64).alias("is_empty"), x.is_full(w).alias("is_full"), x.register(w, 0).alias("first"), F.size(w).cast("long").alias("size"))


@query("register_read_write", f"SELECT k AS l_suppkey, {o.raw('max(h) FILTER (i = 3)')} AS third, 7::BIGINT AS written, {o.raw('max(h) FILTER (i = 4)')} AS next, {o.raw('max(h) FILTER (i = 2)')} AS sliced FROM ({parts_sql()}) GROUP BY k")
def register_read_write(spark, sf):
    w = F.col("words")
    new = x.with_register(w, 3, F.lit(7).cast("long"))
    return suppliers(spark, sf, U64).select("l_suppkey", x.register(w, 3).alias("third"), x.register(new, 3).alias("written"), x.register(new, 4).alias("next"), x.words_slice(w, 2, 1)[0].alias("sliced"))


@query("sketch_arrays", f"SELECT k AS l_suppkey, c - 1 AS counter, i::BIGINT AS i, {o.raw('h')} AS h FROM (SELECT k[1] AS k, k[2] AS c, i, h FROM ({o.sketch('lineitem', '[l_suppkey, l_linenumber::BIGINT]', 'l_partkey', 4)}))")
def sketch_arrays_(spark, sf):
    spec = Spec(4, "u64", FNV)
    rows = table(spark, sf, "lineitem").withColumn("counter", F.col("l_linenumber") - 1)
    held = sketch_arrays(rows, "l_suppkey", "counter", "l_partkey", spec, 7)
    each = held.select("l_suppkey", F.posexplode("counters").alias("counter", "c")).where(~x.is_empty(F.col("c.words"), spec))
    return each.select("l_suppkey", F.col("counter").cast("long").alias("counter"), F.posexplode("c.words").alias("i", "h")).withColumn("i", F.col("i").cast("long"))


_ARRAYS = o.sketch("lineitem", "[l_suppkey, l_linenumber::BIGINT]", "l_partkey", 4)


def arrays(spark: SparkSession, sf: str, spec: Spec) -> DataFrame:
    """(l_suppkey, counters): seven sketches for each supplier, by line number."""
    return sketch_arrays(table(spark, sf, "lineitem").withColumn("counter", F.col("l_linenumber") - 1), "l_suppkey", "counter", "l_partkey", spec, 7)


@query("sketch_array_counter", f"SELECT k[1] AS l_suppkey, i::BIGINT AS i, {o.raw('h')} AS h, true AS replaced, true AS kept FROM ({_ARRAYS}) WHERE k[2] = 3")
def sketch_array_counter(spark, sf):
    """One counter is read, and one replaced by an empty sketch, which leaves the others alone."""
    spec = Spec(4, "u64", FNV)
    c = F.col("counters")
    new = x.with_counter(c, 0, x.empty_sketch(spec))
    held = arrays(spark, sf, spec).select("l_suppkey", x.counter(c, 2).alias("third"), x.is_empty(x.counter(new, 0), spec).alias("replaced"), (x.counter(new, 2) == x.counter(c, 2)).alias("kept")).where(~x.is_empty(F.col("third"), spec))
    return held.select("l_suppkey", "replaced", "kept", F.posexplode("third").alias("i", "h")).withColumn("i", F.col("i").cast("long"))


@query("sketch_array_empty", "SELECT r_regionkey::BIGINT AS r_regionkey, 3::BIGINT AS counters, true AS empty FROM region")
def sketch_array_empty(spark, sf):
    a = x.empty_array(U64, 3)
    return table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), F.size(a).cast("long").alias("counters"), F.forall(a, lambda c: x.is_empty(c["words"], U64)).alias("empty"))


@query("array_json_round_trip", "SELECT DISTINCT l_suppkey, true AS same, 7::BIGINT AS counters FROM lineitem")
def array_json_round_trip(spark, sf):
    spec = Spec(4, "u64", FNV)
    out = arrays(spark, sf, spec).withColumn("read", serial.array_from_json(serial.array_to_json(F.col("counters"), spec), spec))
    return out.select("l_suppkey", (F.col("read") == F.col("counters")).alias("same"), F.size("read").cast("long").alias("counters"))


@query("register_map", f"SELECT k AS l_suppkey, i::BIGINT AS i, CASE WHEN i % 2 = 0 THEN i::BIGINT ELSE {o.raw('h')} END AS h FROM ({parts_sql()})")
def register_map(spark, sf):
    """Every other register is overwritten by its place."""
    return long_form(suppliers(spark, sf, U64).withColumn("words", x.map_words(F.col("words"), lambda w, i: F.when(i % 2 == 0, i.cast("long")).otherwise(w))), "l_suppkey")


@query("sketch_supplier_parts_usize", f"SELECT k AS l_suppkey, i::BIGINT AS i, {o.raw('h')} AS h FROM ({parts_sql()})")
def sketch_supplier_parts_usize(spark, sf):
    return long_form(suppliers(spark, sf, Spec(P, "usize", FNV)), "l_suppkey")


@query("maximal_values", "SELECT r_regionkey::BIGINT AS r_regionkey, 255::BIGINT AS u8, 65535::BIGINT AS u16, 4294967295::BIGINT AS u32, -1::BIGINT AS u64, -1::BIGINT AS usize FROM region")
def maximal_values(spark, sf):
    return table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), *(x.maximal(w).cast("long").alias(w) for w in ("u8", "u16", "u32", "u64", "usize")))


@query("fnv_digest_record", f"SELECT o_orderkey, {o.raw(o.fnv(f'list_concat({o.integer_bytes("o_orderkey")}, {o.integer_bytes("o_custkey")})'))} AS digest FROM orders")
def fnv_digest_record(spark, sf):
    """An element of two fields."""
    return table(spark, sf, "orders").select("o_orderkey", digest(F.struct("o_orderkey", "o_custkey"), FNV).alias("digest"))


_OWN = o.registers("SELECT DISTINCT l_partkey AS v, (l_partkey * 3 + 1)::UBIGINT AS z FROM lineitem", P)


@query("sketch_custom_digest", f"SELECT l_suppkey, i::BIGINT AS i, {o.raw('min(h)')} AS h FROM (SELECT DISTINCT l_suppkey, l_partkey AS v FROM lineitem) JOIN {_OWN} USING (v) GROUP BY ALL")
def sketch_custom_digest(spark, sf):
    """Sketches of digests of the caller's own."""
    rows = table(spark, sf, "lineitem")
    return long_form(minhash_agg(rows, ["l_suppkey"], rows["l_partkey"] * 3 + 1, U64, from_digest=True), "l_suppkey")


@query("sketch_classes", f"SELECT k AS l_suppkey, min(k) OVER (PARTITION BY w) AS representative FROM ({_LISTED.format(parts_sql(2, 'u8'))})")
def sketch_classes(spark, sf):
    """Equal sketches, of which two registers of a byte each give many."""
    return sim.classes(suppliers(spark, sf, Spec(2, "u8", FNV)), "l_suppkey")


# --- bands and joins

BANDS = 8
_BANDED = f"SELECT k, b, {{}} AS hash FROM (SELECT k, i // {P // BANDS} AS b, list(h ORDER BY i) AS hs FROM ({parts_sql()}) GROUP BY ALL)".format(o.fnv(f"flatten(list_transform(hs, lambda h: {o.integer_bytes(o.raw('h'))}))"))


@query("band_hashes", f"SELECT k AS l_suppkey, b::BIGINT AS band, {o.raw('hash')} AS hash FROM ({_BANDED})")
def band_hashes_(spark, sf):
    return suppliers(spark, sf, U64).select("l_suppkey", F.posexplode(band_hashes(F.col("words"), U64, BANDS)).alias("band", "hash")).withColumn("band", F.col("band").cast("long"))


@query("band_hash_first", f"SELECT k AS l_suppkey, {o.raw('hash')} AS hash FROM ({_BANDED}) WHERE b = 0")
def band_hash_first(spark, sf):
    """The hash of a run of registers, which are those of the first band."""
    return suppliers(spark, sf, U64).select("l_suppkey", band_hash(x.words_slice(F.col("words"), 0, P // BANDS), U64).alias("hash"))


_CLASSES = f"c AS (SELECT min(k) AS id, w FROM ({_LISTED.format(parts_sql())}) GROUP BY w)"
_CANDIDATES = f"WITH b AS (SELECT * FROM ({_BANDED})), {_CLASSES}, r AS (SELECT id, b, hash, w FROM c JOIN b ON id = k) SELECT x.id AS left_id, y.id AS right_id, count(*)::BIGINT AS matches{{}} FROM r x JOIN r y ON x.b = y.b AND x.hash = y.hash AND x.id < y.id GROUP BY ALL{{}}"


@query("lsh_candidates", _CANDIDATES.format("", ""))
def lsh_candidates(spark, sf):
    return sim.candidate_pairs(suppliers(spark, sf, U64), "l_suppkey", U64, BANDS)


_J = f"list_sum(list_transform(range(1, {P + 1}), lambda i: (x.w[i] = y.w[i])::INTEGER))::DOUBLE / {P}"


@query("similarity_join", f"SELECT * FROM ({_CANDIDATES.format(f', {_J} AS jaccard', '')}) WHERE jaccard >= 0.25")
def similarity_join(spark, sf):
    return sim.similarity_join(suppliers(spark, sf, U64), "l_suppkey", U64, BANDS, 0.25)


@query("band_matches", f"WITH b AS (SELECT s_nationkey::BIGINT AS nation, k, b, hash FROM ({_BANDED}) JOIN supplier ON k = s_suppkey) SELECT x.nation, x.k AS left_id, y.k AS right_id, x.b::BIGINT AS band FROM b x JOIN b y ON x.nation = y.nation AND x.b = y.b AND x.hash = y.hash AND x.k < y.k")
def band_matches(spark, sf):
    n = neighbours(spark, sf, U64).select("nation", "id", band_hashes(F.col("words"), U64, BANDS).alias("b"))
    both = pairs.joined(n, ["nation"], "id", ["b"]).where(x.any_band(F.col("b_a"), F.col("b_b")))
    return both.select("nation", "left_id", "right_id", F.explode(x.band_matches(F.col("b_a"), F.col("b_b"))).alias("band")).withColumn("band", F.col("band").cast("long"))


# --- boundaries


@query("json_round_trip", f"SELECT k AS l_suppkey, '{{\"words\":[' || string_agg(h::VARCHAR, ',' ORDER BY i) || ']}}' AS json, true AS same FROM ({parts_sql()}) GROUP BY k")
def json_round_trip(spark, sf):
    out = suppliers(spark, sf, U64).withColumn("json", serial.to_json(F.col("words"), U64))
    return out.select("l_suppkey", "json", (serial.from_json(F.col("json"), U64) == F.col("words")).alias("same"))


_ERRORS = f"""WITH s AS ({_LISTED.format(parts_sql())}), p AS (SELECT l_suppkey AS k, list(DISTINCT l_partkey) AS p FROM lineitem GROUP BY ALL),
n AS (SELECT s_nationkey::BIGINT AS nation, s.k, w, p FROM s JOIN p USING (k) JOIN supplier ON s.k = s_suppkey),
e AS (SELECT a.nation, list_sum(list_transform(range(1, {P + 1}), lambda i: (a.w[i] = b.w[i])::INTEGER))::DOUBLE / {P} AS approximation, len(list_intersect(a.p, b.p)) / (len(a.p) + len(b.p) - len(list_intersect(a.p, b.p)))::DOUBLE AS ground_truth FROM n a JOIN n b ON a.nation = b.nation AND a.k < b.k)
SELECT nation, round(avg(pow(approximation - ground_truth, 2)), 9) AS mse_mean, round(stddev_samp(pow(approximation - ground_truth, 2)), 9) AS mse_std, count(*)::BIGINT AS mse_count FROM e GROUP BY nation"""


@query("accuracy_by_nation", _ERRORS)
def accuracy_by_nation(spark, sf):
    """Squared errors of the estimates, summed up as in the accuracy study."""
    out = pairs.squared_errors(table(spark, sf, "lineitem"), nations(spark, sf), suppliers(spark, sf, U64), ["nation"], "l_suppkey", "l_partkey", U64)
    return out.select("nation", F.round("mse_mean", 9).alias("mse_mean"), F.round("mse_std", 9).alias("mse_std"), "mse_count")


@query("hll_jaccard")
def hll_jaccard(spark, sf):
    """HyperLogLog estimates of supplier pairs of a nation; Spark's sketches have no counterpart in SQL."""
    held = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.hll_sketch_agg("l_partkey", 12).alias("h")).join(nations(spark, sf), "l_suppkey")
    both = pairs.joined(held.withColumn("n", F.hll_sketch_estimate("h")), ["nation"], "l_suppkey", ["h", "n"])
    # transform() reads the union's estimate once for both places.
    return both.select("nation", "left_id", "right_id", x.let(F.hll_sketch_estimate(F.hll_union("h_a", "h_b")), lambda union: (F.col("n_a") + F.col("n_b") - union) / union).alias("jaccard"))


@query("accuracy_sweep")
def accuracy_sweep(spark, sf):
    """The study on generated sets of up to 10,000 elements."""
    mine, _ = accuracy.sweep(spark, [10, 100, 1000, 10000], 2, [16, 128], ["u16", "u64"], [10], FNV)
    return accuracy.summary(accuracy.with_squared_error(mine), ["permutations", "word", "memory", "elements"])


@query("word_document_sketches", None)
def word_document_sketches(spark, sf):
    """Similar documents by the sketches of their words: (left_id, right_id, matches, jaccard).

    Documents of equal sketches are a class: each is linked to the least id of its class, with jaccard 1. Least ids
    of different classes are linked if their estimate, always under 1, is at least 0.8. So the links of all documents follow.
    At 0.8 at most 25 of the 128 registers differ, and so not all of 32 bands: no pair is missed.
    """
    if spark.conf.get(BYTES, "1b") == "1b":  # not set; 10,000 rows of long texts, the usual batch, have no bound
        spark.conf.set(BYTES, str(8 << 20))
    words = table(spark, sf, "documents").where("text is not null").select("doc_id", sketch_array(F.array_distinct(F.split(F.lower("text"), r"\s+")), WIDE).alias("w"))
    union = lambda a, b: x.union(a, b, WIDE)
    rows = words.groupBy("doc_id").agg(F.collect_list("w").alias("w"))  # rows of one id are one document
    held = rows.select("doc_id", F.aggregate(F.slice("w", 2, F.size("w")), F.col("w")[0], union).alias("words")).cache()
    members = sim.classes(held.select("doc_id", F.sha2(F.array_join("words", ","), 256).alias("key")), "doc_id", "key").where("doc_id <> representative")
    links = members.select(F.col("representative").alias("left_id"), F.col("doc_id").alias("right_id"), F.lit(WIDE_BANDS).cast("long").alias("matches"), F.lit(1.0).alias("jaccard"))
    return sim.similarity_join(held, "doc_id", WIDE, WIDE_BANDS, 0.8).unionByName(links)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
