"""Operator 2 against a brute-force version, and patience diff against its laws."""

import difflib
import random

import pytest

from sigweave.llm import graph, lines, session

SCHEMA = "doc_id bigint, text string, k string, place int, c0 int, a string, n_lines int"


def anchors(a, b):
    """Places of lines that are unique in both, in the longest common order; of several orders the one that the later lines prefer."""
    pairs = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    best = []
    for k, (_, j) in enumerate(pairs):
        before = [m for m in range(k) if pairs[m][1] < j]
        most = max((best[m][0] for m in before), default=0)
        last = max((m for m in before if best[m][0] == most), default=None)
        best.append((most + 1, last))
    k = max(range(len(pairs)), key=lambda m: (best[m][0], m), default=None)
    out = []
    while k is not None:
        out.append(pairs[k])
        k = best[k][1]
    return out[::-1]


def diff(a, b, i=0, j=0):
    """Paired places of two lists of lines, found by recursion."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(i, j), *diff(a[1:], b[1:], i + 1, j + 1)]
    if a[-1] == b[-1]:
        return [*diff(a[:-1], b[:-1], i, j), (i + len(a) - 1, j + len(b) - 1)]
    found = anchors(a, b)
    if not found:
        return []
    out, x, y = [], 0, 0
    for p, q in [*found, (len(a), len(b))]:
        out += diff(a[x:p], b[y:q], i + x, j + y)
        if p < len(a):
            out.append((i + p, j + q))
        x, y = p + 1, q + 1
    return out


def brute(rows):
    """rows: (doc_id, text), distinct ids. Every document is aligned with the first holder of each of its lines, and of each shortest run of 20 characters, whatever their number."""
    split = {i: (t or "").split("\n") for i, t in rows}
    places = {i: [n for n, x in enumerate(ls) if x.strip(" \t\r\x0b\x0c")] for i, ls in split.items()}
    full = {i: [split[i][n] for n in places[i]] for i in split}
    size = lambda ls: sum(map(len, ls))
    runs = {i: {tuple(x[a:b]) for a in range(len(x)) for b in range(a + 1, len(x) + 1) if b == a + 1 or min(size(x[a : b - 1]), size(x[a + 1 : b])) < 20 <= size(x[a:b])} for i, x in full.items()}
    first = {}
    for i in sorted(runs):
        for r in runs[i]:
            first.setdefault(r, i)
    out = {}
    for i, t in rows:
        gone = set()
        for e in {first[r] for r in runs[i]} - {i}:
            block = []
            for pair in [*diff(full[e], full[i]), None]:
                if block and (pair is None or pair != (block[-1][0] + 1, block[-1][1] + 1)):
                    if size(full[i][q] for _, q in block) >= 20:
                        gone |= {places[i][q] for _, q in block}
                    block = []
                block.append(pair)
        out[i] = (None if t is None else "\n".join(x for n, x in enumerate(split[i]) if n not in gone), len(full[i]), len(gone))
    return out


def check(spark, rows):
    session.checkpoints(spark)
    frame = spark.createDataFrame([(i, t, "en", 1, 2, "x", 9) for i, t in rows], SCHEMA).repartition(3)
    got = lines.dedup_lines(frame)
    assert got.columns == ["doc_id", "text", "k", "place", "c0", "a", "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got.collect()} == brute(rows)


def test_random(spark):
    rng = random.Random(7)
    pool = [f"line number {i} of the pool, long enough" for i in range(60)] + ["x", "", "  ", "common line in very many documents"]
    rows = []
    for i in range(70):
        a = rng.randrange(50)
        rows.append((i, "\n".join(pool[a : a + rng.randint(0, 12)] + [f"own {i} {j}" for j in range(rng.randint(0, 3))] + rng.sample(pool, rng.randint(0, 5)))))
    rows += [(200, None), (201, ""), (202, "\n\n"), (-3, rows[4][1]), (203, rows[5][1])] + [(300 + i, f"common line in very many documents\nown {i}") for i in range(25)] + [(400, "one text without line feeds " * 500), (401, "one text without line feeds " * 500)]
    check(spark, rows)


def test_frequent_passages(spark, monkeypatch):
    session.checkpoints(spark)
    monkeypatch.setattr(graph, "FEW", 5)
    boiler = "a paragraph of the footer that all of them have"
    rows = [(i, f"{boiler}\nown line of document {i}") for i in range(40)]
    rows += [(100 + i, "copied line one of two\ncopied line two of two") for i in range(30)]
    # The short last line of a copied block was first elsewhere, and the long one too.
    rows += [(300, "tail\nown of 300"), (301, "a long enough line before it\nown of 301")] + [(310 + i, f"own {i} of the tail\na long enough line before it\ntail") for i in range(20)]
    # Neither short line reaches MIN_CHARS; each was first in another document than their run.
    rows += [(200, "first half 1\nown of 200"), (201, "second half\nown of 201")] + [(210 + i, f"own {i}\nfirst half 1\nsecond half\nmine {i}") for i in range(20)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == brute(rows)
    assert all(got[i][2] == 1 for i in range(1, 40)) and all(got[100 + i][2] == 2 for i in range(1, 30)) and all(got[210 + i][2] == 2 for i in range(1, 20)) and all(got[310 + i][2] == 2 for i in range(1, 20))


def test_whole_documents(spark, sf):
    session.checkpoints(spark)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got.collect()} == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    session.checkpoints(spark)
    text = "a line that is long enough\nanother line that is long enough"
    got = lines.dedup_lines(spark.createDataFrame([(7, text), (7, text), (None, text), (7, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == [(-1, ""), (7, ""), (7, text), (7, text)]
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_patience(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(12) for _ in range(rng.randint(0, 25))] for _ in range(2))
    got = lines.patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(x < u and y < v for (x, y), (u, v) in zip(got, got[1:]))
    assert lines.patience(a, a) == [(i, i) for i in range(len(a))]
    unique = rng.sample(range(100), 20)
    moved = unique[:5] + [200] + unique[5:]
    assert len(lines.patience(unique, moved)) == 20
    assert sum(n for _, n in lines.blocks(got)) == len(got)
    assert len(lines.patience(unique, unique[3:])) == difflib.SequenceMatcher(None, unique, unique[3:], autojunk=False).find_longest_match().size
