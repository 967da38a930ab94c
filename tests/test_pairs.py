"""Pairs in tiles against pairs one by one, with blocks and parts of a few rows."""

import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sigweave.operators import pairs
from sigweave.operators.sketching import minhash_agg
from sigweave.plans import catalog
from sigweave.spec import FNV, Spec


@pytest.fixture
def small(monkeypatch):
    """Blocks of three to five rows."""
    for name, value in (("SMALL", 3), ("LARGE", 5), ("ELEMENTS", 40), ("STEP", 7), ("OUT", 6)):
        monkeypatch.setattr(pairs, name, value)


def given(spark, kind="bigint"):
    rng = random.Random(5)
    of = {i: (None if i in (3, 4) else i % 2 if i < 30 else 2) for i in range(34)}
    held = {i: {rng.randrange(40) for _ in range(rng.randint(1, 30))} for i in of} | {7: set()}
    rows = [(i, v) for i, g in held.items() for v in [*g, *list(g)[:3]]] + [(7, None), (8, None), (99, 1)]
    df = spark.createDataFrame(rows, "id bigint, v bigint").withColumn("v", F.col("v").cast(kind))
    members = spark.createDataFrame([(i, n) for i, n in of.items()], "id bigint, nation bigint")
    want = {(of[a], a, b): len(held[a] & held[b]) / len(held[a] | held[b]) for a, b in itertools.combinations(of, 2) if of[a] == of[b] is not None}
    return df, members, want


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_exact_pairs(spark, small, kind):
    df, members, want = given(spark, kind)
    rows = pairs.exact_jaccard_pairs(df, members, ["nation"], "id", "v").collect()
    assert len(rows) == len(want) and {tuple(r)[:3]: r.jaccard for r in rows} == want


def test_squared_errors(spark, small):
    df, members, want = given(spark)
    spec = Spec(16, "u64", FNV)
    words = minhash_agg(df, ["id"], "v", spec)
    held = {r.id: r.words for r in words.collect()}
    errors = {n: [(sum(x == y for x, y in zip(held[a], held[b], strict=True)) / 16 - j) ** 2 for (m, a, b), j in want.items() if m == n] for n in (0, 1, 2)}
    got = {r.nation: r for r in pairs.squared_errors(df, members, words, ["nation"], "id", "v", spec).collect()}
    for n, e in errors.items():
        assert got[n].mse_count == len(e) and abs(got[n].mse_mean - statistics.fmean(e)) < 1e-12 and abs(got[n].mse_std - statistics.stdev(e)) < 1e-12


def test_one_pair_has_no_deviation(spark):
    df = spark.createDataFrame([(1, 5), (2, 5)], "id bigint, v bigint")
    members = spark.createDataFrame([(1, 0), (2, 0)], "id bigint, nation bigint")
    spec = Spec(16, "u64", FNV)
    assert [tuple(r) for r in pairs.squared_errors(df, members, minhash_agg(df, ["id"], "v", spec), ["nation"], "id", "v", spec).collect()] == [(0, 0.0, None, 1)]


@pytest.mark.parametrize("name", ["exact_jaccard_pairs", "accuracy_by_nation"])
def test_no_pair_is_compared_row_by_row(spark, sf, name):
    """The pairs of sets are met in tiles; a join of sets on the nation alone took more than 100 s for 2 million pairs."""
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "array_union" not in plan


def test_sketches_of_pairs(spark, small):
    df, members, want = given(spark)
    spec = Spec(16, "u64", FNV)
    n = minhash_agg(df, ["id"], "v", spec).join(members, "id")
    held = {r.id: r.words for r in n.collect()}
    got = pairs.estimates(n, ["nation"], "id", "words", spec).collect()
    assert len(got) == len(want) and {tuple(r)[:3]: r.jaccard for r in got} == {k: sum(x == y for x, y in zip(held[k[1]], held[k[2]], strict=True)) / 16 for k in want}
    rows = pairs.unions(n, ["nation"], "id", "words", spec).collect()
    least = {(*k, i): min(held[k[1]][i], held[k[2]][i], key=lambda v: v % 2**64) for k in want for i in range(16)}
    assert len(rows) == len(least) and {tuple(r)[:4]: r.h for r in rows} == least


@pytest.mark.parametrize("name", ["sketch_union_pairs", "sketch_jaccard_pairs", "band_matches", "hll_jaccard"])
def test_pairs_are_dealt_by_tiles(spark, sf, name):
    """Not by the nation alone, nor by so few tasks as the sketches' bytes would fill."""
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [nation" in plan and "REPARTITION_BY_NUM" in plan and "lo#" in plan
