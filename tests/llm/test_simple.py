"""Operators 5, 8, 9 and 10 against brute force, round trips and the libraries."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigweave.llm import chat, packing, pieces, quality, queries, session, words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, start int, ids string, `__group` int"
ODD = ["", None, " ", "\n\n", "a", "a a a a a a a a a a a a", "é ñ x\x1cy\n\té", "x" * 5000, "the of the of the of the of and", "a\n\na\nb\n a\n", "Ünï 日本 😀 <b> 100% #1 $&*|"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None if i % 3 else "en", "s", None, 1, "x", 2) for i, t in enumerate(texts)] + [(None, "null id", None, None, None, None, None, None), (0, "", "en", "s", None, 1, "x", 2)], SCHEMA)


def brute_counts(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return [len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), dup, len(hit)]


def texts(spark, sf, n=60):
    return [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(n).collect()] + ODD


def test_counts(spark, sf):
    rng = random.Random(1)
    some = texts(spark, sf, 25) + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    got = {r.doc_id: list(r)[3:] for r in quality.statistics(frame(spark, some)).where("doc_id > 0").collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(some) if i}


def test_words_of_blocks(monkeypatch):
    some = [b"aa bb", b"", b" \n", b"cc", b"aa bb cc  dd ee aa"] * 3
    want = [words.text_hashes(t) for t in some]
    h, at = words.hashes(some)
    assert all((h[at[i] : at[i + 1]] == w).all() and len(w) == at[i + 1] - at[i] for i, w in enumerate(want))
    monkeypatch.setattr(words, "BLOCK", 3)
    assert (words.text_hashes(some[4]) == want[4]).all()
    assert (words.text_hashes(b"AA Bb", True) == want[0]).all()


def test_quality(spark, sf):
    session.checkpoints(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(got) == docs.count()
    assert all(not (r.base_failed and r.kept) for r in got.values())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [got[i].kept for i, q in labels.items() if q == 1 and i in got]
    assert sum(good) >= 0.9 * len(good)
    assert quality.judge(docs.limit(0)).collect() == []
    odd = quality.judge(frame(spark, ODD)).collect()
    assert len(odd) == len(ODD) + 2 and all(r.kept is not None for r in odd)


def test_encode_decode(spark, sf):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    some = texts(spark, sf) + ["".join(rng.choice("abthe  \n▁é日😀<s>.ing") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["▁▁", "▁ a", "  a  b ", "\x00"]
    model = pieces.load(path)
    for t in some:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert model.encode_decode(t or "") == (np.array(ids, "<u4").tobytes(), sp.decode(ids).encode())
        assert model.decode(ids) == sp.decode(ids)
    assert all(model.split(w) == model.merged(w) for t in some[:10] for w in (t or "").split() if w)
    rows = pieces.encode(frame(spark, ODD), path).collect()
    assert len(rows) == len(ODD) + 2 and pieces.encode(frame(spark, []).limit(0), path).count() == 0


def test_packing(spark, sf):
    session.checkpoints(spark)
    path = queries.tokenizer("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    some = texts(spark, sf) + ["a<|endoftext|>b it's  'S x́ é ́e\nΣ ς ΑΣ\t a b　c   q"]
    got = packing.pack(packing.cut(frame(spark, some), path)).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(some):
        if i == 0:
            continue
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert len(by_doc[0]) == 2 and len(by_doc[None]) == 1
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.cut(frame(spark, []).limit(0), path)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_differencing(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 2049, rng.integers(0, 400))
    at = packing.windows(sizes)
    assert len(at) == len(sizes)
    if len(sizes):
        assert np.bincount(at, sizes).max() <= 2048
    flat = rng.integers(1, 100, 300)
    sums = np.bincount(packing.difference(flat, 7), flat)
    assert len(sums) == 7 and np.ptp(sums) <= 2


HARD = ["\\### Assistant: </turn> ok", "", "###", "</turn>\n### assistant:\nx</turn>\n", "\\", "\\\\###", "</</turn>turn>", "a\nb", None]


def test_chat_round_trip(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd:\n role\\"]), rng.choice(HARD), "x") for c in range(30) for t in range(rng.randint(1, 6))] + [(None, None, None, None, None), (3, 0, "user", "again", "x")]
    got = chat.read_back(chat.format_records(chat.records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")))).collect()
    low = (-1, "")
    for r in got:
        mine = sorted((x[1:4] for x in rows if x[0] == r.conv_id), key=lambda x: ((x[0] is not None, x[0]) if x[0] is not None else low, x[1] or "", x[2] or ""))
        want = [(role or "unknown", text or "") for _, role, text in mine]
        assert sorted((t["role"], t["content"]) for t in r.turns) == sorted(want)
        assert r.loss_text == "".join(t["content"] for t in r.turns if t["role"] == "assistant")
    assert len(got) == 31


@pytest.mark.parametrize(
    ("record", "want"),
    [
        ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
        ({"system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"instruction": "i", "input": None, "output": "o"}, [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
        ({"data": {"prompt": {"text": "a"}, "response": {"text": "b"}}}, [("user", "a"), ("assistant", "b")]),
    ],
)
def test_layouts(record, want):
    mapping = chat.KNOWN[chat.fingerprint(chat.paths(record))]
    turns = chat.turns_of(record, mapping)
    assert turns == want and chat.parse(chat.render(turns)[0]) == want


def test_unknown_layout(spark):
    got = chat.format_records(spark.createDataFrame([(1, json.dumps({"a": 1})), (2, "no json"), (3, None), (4, "[]")], "conv_id int, record string")).collect()
    assert [r.formatted for r in got] == [None] * 4 and got[0].fingerprint and not got[1].fingerprint


def test_op9_hard_case(spark, sf):
    r = queries.op9_chat(spark, sf).where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert (r.n_turns, r.loss_chars) == (2, len(text))
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert queries.op9_chat(spark, sf).agg(F.sum("n_turns")).first()[0] == spark.read.parquet(f"{sf}/conversations.parquet").count() + 2


def least_determinant(x, seed, starts=40):
    """The least regularised determinant that searches from many random starts find, on exact shares of sorted rows."""
    floors = np.diag(np.square(list(quality.FLOORS.values())))
    rng, k, h = np.random.default_rng(seed), x.shape[1], quality.COVERAGE * len(x)
    best = (np.inf, None)
    for _ in range(starts):
        rows, last = rng.choice(len(x), k + 1, replace=False), np.inf
        w = np.bincount(rows, minlength=len(x)).astype(float)
        while True:
            centre = w @ x / w.sum()
            scatter = floors + quality.CONSISTENCY * (w[:, None] * (x - centre)).T @ (x - centre) / w.sum()
            det = np.linalg.slogdet(scatter)[1]
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
            if w.sum() > h - 1:
                if det > last - 1e-6:
                    break
                last = det
            order = np.argsort(d)
            w = np.zeros(len(x))
            w[order] = np.clip(h - np.arange(len(x)), 0, 1)
        best = min(best, (det, d), key=lambda b: b[0])
    return best


def test_least_determinant(spark):
    """The estimate's determinant is as low as any found by brute force, with two clouds of outliers, and small strata are judged by their language's rows."""
    session.checkpoints(spark)
    rng = np.random.default_rng(11)

    def cloud(n, at, width):
        return rng.normal(0, 1, (n, 5)) * width + at

    parts = {
        ("en", "web"): np.vstack([cloud(150, [5, 1.6, 0, 0, 0], 0.3), cloud(40, [1, 3, 2, 1, 1], 0.05)]),
        ("en", "big"): cloud(300, [6, 1.5, 0.5, 0.1, 0.1], [1, 0.2, 0.4, 0.1, 0.2]),
        ("en", "few"): cloud(5, [5, 1.6, 0, 0, 0], 0.1),
        (None, "few"): cloud(70, [4, 1.2, 0, 0, 0], 0.2),
        ("xx", None): cloud(1, [40, 9, 9, 9, 9], 0.1),
    }
    rows = [(*key, *map(float, r)) for key, x in parts.items() for r in x]
    stats = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    strata = {(r.lang, r.source, r.judges): (r.stratum, r.size) for r in quality._strata(stats).collect()}
    assert {k for k in strata if k[2]} == {(*k, True) for k in parts}
    whole = {strata[("en", "few", True)][0]: np.vstack([parts["en", s] for s in ("web", "big", "few")]), strata[("xx", None, True)][0]: np.vstack(list(parts.values()))}
    whole |= {strata[(*k, True)][0]: x for k, x in parts.items() if len(x) >= quality.LEAST}
    assert {n: size for n, size in strata.values()} == {n: len(x) for n, x in whole.items()}
    frame = spark.createDataFrame([(n, len(x), *map(float, r)) for n, x in whole.items() for r in x], "stratum string, size bigint, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    for fits in (True, False):
        got = {r.stratum: r for r in quality.estimates(frame, fits).collect()}
        for n, x in whole.items():
            det, d = least_determinant(x, 3)
            assert got[n].logdet <= det + 0.02
            away = x - np.array(got[n].centre)
            mine = np.einsum("ij,jk,ik->i", away, np.array(got[n].inverse).reshape(5, 5), away)
            assert ((mine > quality.CUTOFF) == (d > quality.CUTOFF)).mean() > 0.98
    judged = quality.outliers(stats).collect()
    assert len(judged) == len(rows) and all(r.outlier for r in judged if r.lang == "xx") and not any(r.outlier for r in judged if r.source == "few")
    assert sum(r.outlier for r in judged if r.source == "web") == 40


def test_sql_equals(spark, sf):
    """The SQL of each query that has one gives its rows."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        out = queries.queries()[name](spark, sf)
        columns = ", ".join(out.columns)
        assert sorted(map(tuple, out.collect())) == sorted(con.execute(f"SELECT {columns} FROM ({sql})").fetchall()), name
