"""Operator 4: the decoder, held-out accuracy, and odd rows."""

import random
import zlib
from collections import Counter

import numpy as np

from sigweave.llm import queries, session, toxicity


def decoder(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return toxicity.Decoder(toxicity.language_model({r.trigram: r.n for r in toxicity.count_trigrams(docs).collect()}))


def test_trigrams(spark):
    rows = spark.createDataFrame([("ab é",), (None,), ("",), ("AB",)], "text string")
    got = {r.trigram: r.n for r in toxicity.count_trigrams(rows).collect()}
    a, b, n = toxicity.code("a"), toxicity.code("b"), toxicity.CLASSES
    assert got[a * n * n + b * n] == 2 and sum(got.values()) > 4
    model = toxicity.language_model(got)
    assert np.allclose(np.exp(model).sum(2), 1, atol=1e-4)


def test_viterbi_is_the_best_path(spark, sf):
    d, rng = decoder(spark, sf), random.Random(1)

    def cost(text):
        x = y = 0
        s = 0.0
        for c in text + " ":
            k = toxicity.code(c)
            s += float(d.model[x, y, k])
            x, y = y, k
        return s

    for _ in range(60):
        token = "".join(rng.choice("idot103@$.!e") for _ in range(rng.randint(1, 7)))
        paths = [("", 0.0)]
        for options in d.lattice(token):
            paths = [(t + o, c + x) for t, c in paths for o, x in options]
        best = max(c + cost(t) for t, c in paths)
        said = d.decode(token)
        assert abs(max(c for t, c in paths if t == said) + cost(said) - best) < 1e-3


def test_disguises(spark, sf):
    d = decoder(spark, sf)
    for token, word in {"1d10t": "idiot", "id!ot": "idiot", "iiidiooottt": "idiot", "i.d.i.o.t": "idiot", "m0r0n": "moron", "l0ser!!": "loser", "cl0wn,": "clown", "tr@sh": "trash"}.items():
        assert d.words(token)[0] == word
    assert d.words("Plain,") == ["plain"] and d.words("of%%%") == ["of"] and d.words("123") == []
    assert toxicity.spaced("you i d i o t now a b".split()) == ["idiot"]


def test_disguised_first_letters(spark, sf):
    d = decoder(spark, sf)
    for token, word in {"!diot": "idiot", "(lown": "clown", "|diot,": "idiot", "$tupid": "stupid", "+rash!": "trash", "|oser": "loser", "\"!d!ot!\"": "idiot"}.items():
        assert word in d.words(token), (token, d.words(token))
    assert "word" in d.words("(word") and d.words("...") == [] and d.words("\"Plain\"") == ["plain"] and "" not in d.words("!!!")


def test_signs_for_all_letters():
    counts = Counter()
    for a, b, c in zip("\0\0ass\0", "\0ass\0", "ass\0"):
        n = [0 if x == "\0" else toxicity.code(x) for x in (a, b, c)]
        counts[(n[0] * toxicity.CLASSES + n[1]) * toxicity.CLASSES + n[2]] += 1000
    d = toxicity.Decoder(toxicity.language_model(counts))
    assert d.words("@$$") == d.words("@$$!!") == d.words("@55") == ["ass"] and d.words("455") == []


def test_spaced_rows(spark, sf):
    d = decoder(spark, sf)
    assert toxicity.spaced("a f o o l and x y z or p q".split()) == ["afool", "xyz"]
    for row, word in {"aclown": "clown", "idiot": "idiot", "aidiot": "idiot", "!d!ot": "idiot"}.items():
        assert word in d.row(row), (row, d.row(row))
    hits = toxicity._Hits(d, None)
    assert "clown" in toxicity.shown("you are a c l o w n today", hits) and "mad" in toxicity.shown("so m a d", hits)


def test_held_out(spark):
    session.checkpoints(spark)
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert sum(p for p, y in held if not y) <= 0.01 * len(held)
    assert sum(p for p, y in held if y) >= 0.6 * sum(y for _, y in held)


def test_odd_rows(spark):
    session.checkpoints(spark)
    schema, label = "doc_id bigint, text string, score string, toxic int", "doc_id bigint, toxic int, text string"
    rows = spark.createDataFrame([(i, f"you nasty{i % 2} thing {i}", "s", 9) for i in range(60)] + [(100, None, None, None), (101, "", "s", 1), (None, "a", "s", 1), (5, "nasty1", "s", 1), (102, "x" * 30000 + " n4sty1", "s", 1)], schema)
    told = spark.createDataFrame([(i, i % 2, "t") for i in range(60)] + [(None, 1, "t"), (3, None, "t"), (4, 7, "t"), (5, 1, "t")], label)
    model = toxicity.fit(rows, told)
    got = toxicity.score(rows, model).collect()
    assert len(got) == 65 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.filter_clean(rows, model).columns == rows.columns
    for labels in (told.limit(0), told.where("toxic = 1")):
        assert len({r.score for r in toxicity.score(rows, toxicity.fit(rows, labels)).collect()}) == 1
    empty = rows.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, told)).count() == 0
