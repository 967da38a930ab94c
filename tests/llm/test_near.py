"""Operator 3 against a brute-force version."""

import random
import re

import numpy as np
import pytest

from sigweave.llm import graph, near, session, words

SCHEMA = "doc_id bigint, text string, lang string, n int, bands string, task int, a int"


def brute_set(text, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))) if ws else frozenset()


def brute(rows, k):
    sets = {i: brute_set(t, k) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def variants(rng, n_bases, n, edits):
    rows, i = [], 0
    for _ in range(n_bases):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, 120))]
        for _ in range(n):
            ws = list(base)
            for _ in range(rng.randint(0, edits)):
                ws[rng.randrange(len(ws))] = f"W{rng.randrange(3000)}"
            rows.append((i, " ".join(ws)))
            i += 1
    return rows


@pytest.mark.parametrize(("bases", "n", "edits"), [(30, 6, 3), (2, 150, 4)])
def test_brute(spark, bases, n, edits, monkeypatch):
    session.checkpoints(spark)
    if n > 100:
        monkeypatch.setattr(near, "BLOCK", 40)
        monkeypatch.setattr(near, "HUBS", 10)
        monkeypatch.setattr(graph, "FEW", 5)
    rows = variants(random.Random(bases), bases, n, edits) + [(9000, ""), (9001, None), (9002, "one"), (9003, "ONE"), (9004, "a b c d"), (9005, "\n")]
    frame = spark.createDataFrame([(i, t, "en", 1, "x", 2, 3) for i, t in rows], SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in near.near_duplicates(frame, 4).collect()}
    assert got == brute(rows, 4)


def test_documents(spark, sf):
    session.checkpoints(spark)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 5)


def test_odd_rows(spark):
    session.checkpoints(spark)
    got = near.near_duplicates(spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "A b c d e f"), (None, "z"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (-1, -1, True), (-1, 5, True), (5, 5, True), (5, 5, True)]
    assert near.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_deduplicated(spark):
    """One row of each group stays, whatever ids repeat; rows without words all stay."""
    session.checkpoints(spark)
    a, b = "a b c d e f g", "q r s t u v w"
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "y"), (9, "m n o p q r", "z"), (9, "m n o p q r", "z"), (None, b, "n"), (None, "only null ids here are a group", "o"), (1, "", "e"), (1, "", "e"), (2, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, k1 string")
    got = near.deduplicated(frame)
    assert got.columns == frame.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [rows[0], rows[2], rows[3], rows[6], rows[7], rows[8], rows[9]]))


def test_bucket_of_strangers(spark, monkeypatch):
    """Texts that share a bucket with others but no link, and links that no centre has."""
    session.checkpoints(spark)
    monkeypatch.setattr(near, "BLOCK", 16)
    monkeypatch.setattr(near, "HUBS", 4)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(30):  # each pair of copies differs from the next by a quarter of its words
        ws = list(base)
        for j in rng.sample(range(60), 9):
            ws[j] = f"x{i}_{j}"
        rows += [(2 * i, " ".join(ws)), (2 * i + 1, " ".join([*ws, "end"]))]
    got = {r.doc_id: tuple(r)[1:] for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()}
    assert got == brute(rows, 1)


def test_sketches_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    for size in (3, 40, 600):
        x, y = a[:size], a[size // 3 : size + size // 3]
        s = near.sketches(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        assert not (s == near._EMPTY).any()
        true = len(set(x) & set(y)) / len(set(x) | set(y))
        assert abs((s[0] == s[1]).mean() - true) < 0.16


def test_components(spark):
    session.checkpoints(spark)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)] + [(200, i) for i in range(201, 260)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((90, 95, 100), 90), **dict.fromkeys(range(200, 260), 200)}


def test_components_tasks(spark, monkeypatch):
    """The tasks of all turns, each of which writes files, follow from the edges and not from the shuffle partitions; many tasks give the same components."""
    session.checkpoints(spark)
    edges = [(i, i + 1) for i in range(0, 40)] + [(200, i) for i in range(201, 260)]
    frame = spark.createDataFrame(edges, "a long, b long").coalesce(1)
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    tracker, found, tasks = spark.sparkContext.statusTracker(), [], []
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for each in (graph.EACH, 9):
            monkeypatch.setattr(graph, "EACH", each)
            spark.sparkContext.setJobGroup(f"components of {each}", "")
            found.append(dict(map(tuple, graph.components(frame).collect())))
            stages = {s for j in tracker.getJobIdsForGroup(f"components of {each}") for s in tracker.getJobInfo(j).stageIds}
            tasks.append(sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s))))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[0] == found[1] == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(200, 260), 200)}
    assert tasks[0] < 1000 and tasks[0] < tasks[1]


def test_short_sets():
    h, at = words.hashes([b"a b", b"", b"a b c d e f", b"q"])
    g, to = words.shingles(h, at, 4)
    assert np.diff(to).tolist() == [1, 0, 3, 1]
