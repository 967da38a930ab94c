"""Every registered query of the library against its SQL."""

import glob
import os
import random

import duckdb
import numpy as np
import pytest

from sigweave.plans import catalog


@pytest.fixture(scope="module")
def tables(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, sf, tables, name):
    got = catalog.queries()[name](spark, sf)
    rows = [tuple(r) for r in got.select(*sorted(got.columns)).collect()]
    if name not in catalog.oracle_sql():
        assert rows or name == "hll_jaccard"
        return
    want = tables.sql(catalog.oracle_sql()[name])
    order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    assert [want.columns[i] for i in order] == sorted(got.columns)
    assert sorted(map(str, rows)) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def test_word_document_sketches(spark, tmp_path):
    """All pairs of documents follow from the rows, as by comparing each sketch with each."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        base = [f"w{i}x{j}" for j in range(60)]
        rows += [" ".join(base), " ".join(base[::-1]), *(" ".join(base[n:] + [f"other{i}x{n}x{j}" for j in range(n)]) for n in rng.sample(range(3, 10), 3))]
    rows += [rows[0], rows[0].upper(), None]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in catalog.word_document_sketches(spark, str(tmp_path)).collect()]
    words = docs.selectExpr("doc_id", "explode(split(lower(text), '\\\\s+')) as word")
    held = {r.doc_id: np.array(r.words) for r in catalog.minhash_agg(words, ["doc_id"], "word", catalog.WIDE).collect()}
    want = {(a, b): float((held[a] == held[b]).mean()) for a in held for b in held if a < b and (held[a] == held[b]).mean() >= 0.8}
    of = {i: i for i in held} | {b: a for a, b, _, j in got if j == 1}
    between = {(a, b): j for a, b, _, j in got if j < 1}
    assert len(got) == len({r[:2] for r in got})
    found = {(a, b): 1.0 if of[a] == of[b] else between.get((min(of[a], of[b]), max(of[a], of[b]))) for a in held for b in held if a < b}
    assert {k: j for k, j in found.items() if j} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
