"""Laws of sketches: building, merging, membership, bands, serialization, streams."""

import random

import pytest
from pyspark.sql import functions as F

from sigweave.functions import expressions as x
from sigweave.functions.hashing import band_hashes, hash_stream, register_functions, sketch_array
from sigweave.operators import similarity as sim
from sigweave.operators.sketching import minhash_agg, nearest, sketch_arrays, union_agg
from sigweave.plans import accuracy
from sigweave.sources import serial
from sigweave.spec import FNV, SIP, WORDS, Hasher, Spec
from sigweave.streaming.sketches import assembled, stream_registers


def sets(spark, *groups):
    return spark.createDataFrame([(i, v) for i, g in enumerate(groups) for v in g], "s int, v bigint")


def sketched(spark, spec, *groups):
    return [r.words for r in spark.createDataFrame([(i, list(g)) for i, g in enumerate(groups)], "s int, v array<bigint>").coalesce(1).select("s", sketch_array(F.col("v"), spec).alias("words")).orderBy("s").collect()]


def column(words):
    return F.array(*(F.lit(w) for w in words))


def value(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_known_sketches(spark):
    spec = Spec(4, "u64", FNV)
    got = minhash_agg(sets(spark, range(1, 9)), ["s"], "v", spec).first().words
    assert got == [2627988722381923618, 1730560887953428743, 2144750672383324165, 1857821694358901839] == sketched(spark, spec, range(1, 9))[0]
    assert sketched(spark, Spec(4), range(1, 9))[0] == [1391788276974331992, 1961282105369266440, 3467162587530892932, 1685941723629783162]


@pytest.mark.parametrize(("spec", "a", "b", "want", "within"), [(Spec(128), range(1, 9), range(5, 13), 1 / 3, 0.01), (Spec(256), range(100), range(50, 150), 1 / 3, 0.1), (Spec(128, "u64", FNV), range(1000), range(1000, 2000), 0, 0.1), (Spec(64), range(100), range(1000, 1100), 0, 0.2)])
def test_accuracy(spark, spec, a, b, want, within):
    s, t = sketched(spark, spec, a, b)
    assert abs(value(spark, x.jaccard(column(s), column(t)))[0] - want) < within


@pytest.mark.parametrize("word", list(WORDS))
def test_laws(spark, word):
    rng = random.Random(word)
    spec = Spec(64, word)
    draw = lambda: [rng.choice([0, 1, 2**63 - 1, -(2**63), -1, rng.randrange(-(2**63), 2**63)]) for _ in range(rng.randint(0, 20))]
    for a, b, c in [([], [0], []), (draw(), draw(), draw())]:
        rows = sketched(spark, spec, a, b, c, a + b, a[::-1] + a, [])
        sa, sb, sc, ab, again, none = map(lambda w: column(w).cast(spec.array), rows)
        u = lambda p, q: x.union(p, q, spec)
        got = value(spark, u(sa, sb) == ab, u(sa, sb) == u(sb, sa), u(u(sa, sb), sc) == u(sa, u(sb, sc)), u(sa, sa) == sa, u(sa, none) == sa, again == sa, x.jaccard(sa, sa) == 1, x.jaccard(sa, sb) == x.jaccard(sb, sa), x.jaccard(sa, sb).between(0, 1), x.is_empty(none, spec), x.is_full(none), x.jaccard(none, none), x.memory_bits(sa, spec))
        assert got == [True] * 10 + [False, 1.0, 64 * WORDS[word].bits]
        members = spark.createDataFrame([(v,) for v in a] or [(0,)], "v bigint").where(F.lit(bool(a)))
        assert members.where(~x.may_contain(sa, hash_stream(F.col("v"), spec), spec)).count() == 0


@pytest.mark.parametrize("hasher", [SIP, FNV, Hasher("sip13", (1, 2)), Hasher("fnv", (7,))])
def test_partitions_and_duplicates_change_nothing(spark, hasher):
    spec = Spec(32, "u64", hasher)
    rows = sets(spark, range(50), range(20, 90), [5], []).unionByName(spark.createDataFrame([(9, None), (None, 3), (None, None), (0, 7), (0, None)], "s int, v bigint"))
    want = {r.s: r.words for r in minhash_agg(rows, ["s"], "v", spec).collect()}
    assert want[9] == [-1] * 32 and want[None] == sketched(spark, spec, [3])[0] and want[0] == sketched(spark, spec, range(50))[0]
    for n in (1, 7):
        assert {r.s: r.words for r in minhash_agg(rows.union(rows).repartition(n), ["s"], "v", spec).collect()} == want
    assert {r.s: r.words for r in minhash_agg(rows, ["s"], "v", spec, rows=6).collect()} == want
    parts = minhash_agg(rows.withColumn("p", F.col("v") % 3), ["s", "p"], "v", spec)
    assert {r.s: r.words for r in union_agg(parts, ["s"], "words", spec).collect()} == want
    total = minhash_agg(rows, [], "v", spec).collect()
    assert [r.words for r in total] == [sketched(spark, spec, range(90))[0]]
    assert minhash_agg(rows.limit(0), [], "v", spec).first().words == [-1] * 32
    assert minhash_agg(rows.limit(0), ["s"], "v", spec).count() == 0


def test_keys(spark):
    a, b, c = (sketched(spark, Spec(16, "u64", Hasher("sip13", k)), range(200))[0] for k in ((1, 2), (1, 2), (3, 4)))
    assert a == b != c
    assert sketched(spark, Spec(16, "u64", Hasher("fnv", (7,))), range(200)) != sketched(spark, Spec(16, "u64", Hasher("fnv", (99,))), range(200))


def test_saturation(spark):
    full, one = sketched(spark, Spec(16, "u8", FNV), range(100000), [1])
    assert value(spark, x.is_full(column(full)), x.is_full(column(one))) == [True, False]


def test_registers(spark):
    w = column([10, 20, 30])
    got = value(spark, x.register(w, 1), x.with_register(w, 2, F.lit(5)), x.words_slice(w, 1, 2), x.map_words(w, lambda v, i: v + i), x.number_of_permutations(w))
    assert got == [20, [10, 20, 5], [20, 30], [10, 21, 32], 3]
    for bad in (x.register(w, 3), x.with_register(w, 3, F.lit(1)), x.jaccard(w, column([1])), x.union(w, column([1]), Spec(3)), x.band_matches(w, column([1]))):
        with pytest.raises(Exception):  # noqa: B017
            value(spark, bad)


def test_arrays_of_sketches(spark):
    spec = Spec(64)
    rows = spark.createDataFrame([(1, c, c * 1000 + i) for c in range(3) for i in range(100)] + [(2, 1, 42)], "a int, c int, v bigint")
    got = {r.a: [list(c.words) for c in r.counters] for r in sketch_arrays(rows, "a", "c", "v", spec, 4).collect()}
    assert got[2] == [[-1] * 64, sketched(spark, spec, [42])[0], [-1] * 64, [-1] * 64]
    for i in range(3):
        for j in range(i):
            assert value(spark, x.jaccard(column(got[1][i]), column(got[1][j])))[0] < 0.2
    array = x.empty_array(spec, 4)
    new = x.with_counter(array, 2, column(got[1][0]))
    assert value(spark, x.counter(new, 2), x.is_empty(x.counter(new, 1), spec), F.size(array)) == [got[1][0], True, 4]
    back = spark.range(1).select(serial.array_from_json(serial.array_to_json(new, spec), spec).alias("b"), new.alias("a")).first()
    assert back.a == back.b


@pytest.mark.parametrize(("bands", "size"), [(16, 16), (8, 8), (5, 5), (0, 0)])
def test_bands(spark, bands, size):
    spec = Spec(128)
    same, other = sketched(spark, spec, range(100), range(100, 200))
    changed = list(same)
    changed[20] = 12345
    rows = spark.createDataFrame([(0, same), (1, other), (2, changed)], "i int, words array<bigint>")
    got = [r.b for r in rows.select("i", band_hashes(F.col("words"), spec, bands).alias("b")).orderBy("i").collect()]
    assert [len(b) for b in got] == [size] * 3
    a, b, c = (F.array(*map(F.lit, g)).cast("array<bigint>") for g in got)
    rows_in_band = 128 // bands if bands else 1
    want = [i for i in range(bands) if i != 20 // rows_in_band]
    assert value(spark, x.band_matches(a, a), x.band_matches(a, b), x.any_band(a, b), x.band_matches(a, c)) == [list(range(bands)), [], False, want]


def test_known_band_hashes(spark):
    rows = spark.createDataFrame([(list(range(100)),)], "v array<bigint>").select(sketch_array(F.col("v"), Spec(128)).alias("w")).select(band_hashes(F.col("w"), Spec(128), 16).alias("b"))
    assert [v % 2**64 for v in rows.first().b[:2]] == [14660776308195936422, 12744006615270527764]


def test_joins(spark):
    spec = Spec(128)
    rows = minhash_agg(sets(spark, range(100), range(100), range(5, 105), range(1000, 1100)), ["s"], "v", spec).union(spark.createDataFrame([(8, [-1] * 128), (9, [-1] * 128)], "s int, words array<bigint>"))
    assert [(r.left_id, r.right_id) for r in sim.similarity_join(rows, "s", spec, 32, 0.7).collect()] == [(0, 2)]
    assert {r.s: r.representative for r in sim.classes(rows, "s").collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 8: 8, 9: 8}
    assert {r.s for r in sim.similar_to(rows.where("s < 4"), rows.where("s = 2"), "s", spec, 32).collect()} == {0, 1, 2}
    scored = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.7), (2, 3, 0.1)], "k int, o int, j double")
    assert {(r.k, r.o) for r in nearest(scored, ["k"], "j", 1).collect()} == {(1, 3), (2, 3)}


@pytest.mark.parametrize("word", list(WORDS))
def test_json(spark, word, tmp_path):
    spec = Spec(8, word)
    rows = spark.createDataFrame([(list(range(50)),), ([],), (None,)], "v array<bigint>").select(sketch_array(F.col("v"), spec).alias("w"))
    out = rows.withColumn("j", serial.to_json(F.col("w"), spec)).withColumn("b", serial.from_json(F.col("j"), spec)).collect()
    assert all(r.w == r.b for r in out) and str(WORDS[word].mask) in out[1].j
    rows.write.parquet(str(tmp_path / "w"))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "w")).collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(Exception):  # noqa: B017
        spark.createDataFrame([('{"words":[1]}',)], "j string").select(serial.from_json(F.col("j"), spec)).collect()


def test_large_sketch_round_trip(spark):
    spec = Spec(4096)
    r = spark.createDataFrame([(list(range(1000)),)], "v array<bigint>").select(sketch_array(F.col("v"), spec).alias("w")).withColumn("b", serial.from_json(serial.to_json(F.col("w"), spec), spec)).first()
    assert len(r.w) == 4096 and r.w == r.b


def test_sql_names(spark):
    register_functions(spark, Spec(4, "u64", FNV), 2)
    r = spark.sql("select minhash_stream(42L) s, minhash_sketch(array(1L, 2L)) k, minhash_bands(minhash_sketch(array(1L))) b, minhash_digest(1) d").first()
    assert [v % 2**64 for v in r.s] == [6107090181004601339, 5004290018017322356, 10580726218994651454, 6349293316951290780] and len(r.k) == 4 and len(r.b) == 2 and r.d % 2**64 == 12478008331234465636
    rows = spark.sql("select t.* from (select minhash_digest(42L) d) x, lateral minhash_rows(x.d) t order by i").collect()
    assert [v.h % 2**64 for v in rows] == [v % 2**64 for v in r.s]


def test_streams(spark, tmp_path):
    spec = Spec(8, "u64", FNV)
    rows = sets(spark, range(30), range(10, 15))
    for n in range(2):  # the second batch repeats the first
        rows.write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_registers(events, ["s"], "v", spec).writeStream.outputMode("complete").format("memory").queryName("registers").start()
    q.processAllAvailable()
    q.stop()
    assert {r.s: r.words for r in assembled(spark.table("registers"), ["s"]).collect()} == {r.s: r.words for r in minhash_agg(rows, ["s"], "v", spec).collect()}


def test_accuracy_study(spark, tmp_path):
    mine, theirs = accuracy.sweep(spark, [10, 500], 2, [32], ["u16"], [10], FNV)
    assert mine.count() == theirs.count() == 4 and "time" in mine.columns
    table = accuracy.summary(accuracy.with_squared_error(mine), ["permutations", "word", "memory", "elements"])
    assert all(r.mse_mean < 0.05 and r.mse_count == 2 for r in table.collect())
    assert [r.elements for r in accuracy.curve(table, "u16", 500).collect()] == [500]
    assert [r.elements for r in accuracy.distinct_values(table, "elements").collect()] == [10, 500]
    out = str(tmp_path / "csv")
    serial.write_results(mine, out)
    read = serial.read_results(spark, out, serial.MINHASH_RESULTS + ", iteration bigint")
    assert read.count() == 4
    assert [r.iteration for r in serial.unfinished(spark.range(4).toDF("iteration"), read, read).orderBy("iteration").collect()] == [2, 3]
