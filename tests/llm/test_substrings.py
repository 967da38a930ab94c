"""Operator 7 against a brute-force version."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sigweave.llm import graph, session, substrings

SCHEMA = "doc_id bigint, text string, lang string, place int, k string, `__key` bigint"


def brute(rows, window=20):
    """rows: (doc_id, text), distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for p in range(len(ws) - window + 1):
            key = tuple(ws[p : p + window])
            if key in seen:
                gone.update(range(p, p + window))
            seen.add(key)
        out[i] = (len(ws), len(gone), " ".join(w for p, w in enumerate(ws) if p not in gone))
    return out


def check(spark, rows, parts=3):
    session.checkpoints(spark)
    frame = spark.createDataFrame([(i, t, "en", 1, "n", 5) for i, t in rows], SCHEMA).repartition(parts)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(frame).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("group", [1, 12, 4096])
def test_random(spark, group, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", group)
    monkeypatch.setattr(substrings, "CHUNK", 7 * group)
    monkeypatch.setattr(graph, "FEW", group)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 90))] for _ in range(8)]
    rows = []
    for i in range(80):
        ws = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))]
            a = rng.randint(0, 10)
            ws += p[a : len(p) - rng.randint(0, 5)]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(ws)))
    rows += [(100, "x " * 60), (101, "x " * 25), (102, "a b " * 40), (103, ""), (104, None), (105, rows[3][1]), (-5, rows[4][1]), (106, "é\x1cé " * 21), (107, " ".join(vocabulary) * 20)]
    check(spark, rows)


def test_documents(spark, sf):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])


def test_repeated_rows_and_null_ids(spark):
    session.checkpoints(spark)
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(7, text), (7, text), (None, text), (9, "short"), (9, None)]
    got = sorted(map(tuple, substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(7, 30, 0, text), (7, 30, 0, text), (None, 30, 30, ""), (9, 1, 0, "short"), (9, 0, 0, "")], key=str)
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_common_prefix(spark, monkeypatch):
    """One passage in very many documents, and texts that part after 8, 19, 20 and 21 words."""
    monkeypatch.setattr(substrings, "GROUP", 10)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([f"own{i}", *base, f"end{i}"])) for i in range(60)]
    rows += [(100 + n, " ".join([*base[:n], *(f"x{n}_{j}" for j in range(40))])) for n in (8, 19, 20, 21)]
    check(spark, rows)


def test_nodes():
    """Windows are told apart by their words: equal words, and no others, have one node, in the order of their words."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(20 + rng.randint(0, 14))) for _ in range(200)] + ["a " * 33 + "a"]
    n = np.array([len(t.split()) - 19 for t in texts])
    node, row, turn = substrings._nodes(pa.array(texts), n)
    windows = [tuple(texts[r].split()[t : t + 20]) for r, t in zip(row, turn, strict=True)]
    by = {w: c for w, c in zip(windows, node, strict=True)}
    assert all(by[w] == c for w, c in zip(windows, node, strict=True)) and len(set(by.values())) == len(by)
