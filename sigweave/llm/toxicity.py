"""Toxicity: a noisy-channel decoder for disguised words, and a linear score of the restored text.

A token with signs or digits for letters, with dots or dashes between them, or with
stretched letters becomes a lattice: each place has the letters that it may stand for, each
at a channel cost. So does a row of three or more single characters, which may be words spaced out: each
place may also begin a word. Both the restored and the written reading count. Digits alone are a number. Viterbi
search under a character trigram model picks the likeliest reading. The model counts the trigrams of all
texts; there are as many sums as trigrams of the 64 classes of characters, at any input size.

The score is logistic in how often the restored words show learned word beginnings (4 to 6
letters) and whole words. These are learned from labelled rows, of which a sample of at most SAMPLE by a
hash of the id is used; FEATURES bounds the model. Restoring a token is cached, in bounded caches.

Null text is as empty; a text without a learned feature gets the base score. Null ids take no
part in learning; labels without 0 or 1 neither; of several labels of an id the largest
counts. With no labelled row of both kinds every score is the share of label 1 (0.5 without labels). Equal
texts get equal scores. An empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, FEATURES, CACHED = 8000, 600, 400_000
CLASSES = 64  # of characters: 0 for none, 26 and 32 for letters, 63 for other letters
THRESHOLD = 0.7
_ALONE = math.log(0.05)  # a letter is a word of its own if so many of the words that it begins end after it

_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[0xDF:0x100] = np.arange(27, 27 + 33)
_CLASS[0xF7] = 0
_OTHER = 63
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i", "¥": "y", "ß": "ß"}
_SIGN = re.escape("".join(c for c in SIGNS if not c.isalnum()))
_PLAIN = re.compile(rf"[^\w{_SIGN}]*([^\W\d_]+)[^\w{_SIGN}*]*").fullmatch
_STRETCHED = re.compile(r"(\w)\1\1").search
_LETTER = re.compile(rf"[^\W\d_]|[{_SIGN}]").search  # or a sign for one
_WORD = re.compile(r"[^\W\d_]+").findall


def code(c: str) -> int:
    o = ord(c)
    return int(_CLASS[o]) if o < 256 else (_OTHER if c.isalpha() else 0)


@lru_cache(1)
def _all_classes() -> np.ndarray:
    """code() of each code point."""
    out = np.fromiter((_OTHER if chr(i).isalpha() else 0 for i in range(0x110000)), np.uint8, 0x110000)
    out[:256] = _CLASS
    return out


def count_trigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(trigram, n) of the character classes of all texts, two blanks before each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                joined = "  ".join(["", *(t for t in b.column(0).slice(at, 200).to_pylist() if t), ""])
                for i in range(0, len(joined), 1 << 20):
                    x = _all_classes()[np.frombuffer(joined[max(0, i - 2) : i + (1 << 20)].lower().encode("utf-32-le", "replace"), np.uint32)].astype(np.int64)
                    if len(x) > 2:
                        before = np.where(x[1:-1] == 0, 0, x[:-2])  # what lies before a blank doesn't matter
                        total += np.bincount((before * CLASSES + x[1:-1]) * CLASSES + x[2:], minlength=CLASSES**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["trigram", "n"])

    return docs.select(docs[text_col]).mapInArrow(run, "trigram int, n bigint").groupBy("trigram").agg(F.sum("n").alias("n"))


def language_model(counts: dict[int, int], strength: float = 20.0) -> np.ndarray:
    """log P(c | a, b) of character classes, each order smoothed by the one below."""
    n = np.zeros(CLASSES**3)
    n[list(counts)] = list(counts.values())
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    one = (n.sum((0, 1)) + 0.5) / (n.sum() + 0.5 * CLASSES)
    two = n.sum(0)
    two = (two + strength * one) / (two.sum(1, keepdims=True) + strength)
    three = (n + strength * two[None]) / (n.sum(2, keepdims=True) + strength)
    return np.log(three).astype(np.float32)


class Decoder:
    """Restores tokens under a language model."""

    def __init__(self, model: np.ndarray):
        self.model = model

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each place the strings that it may stand for, with their channel costs."""
        out: list[list[tuple[str, float]]] = []
        runs = [(m.group(1), len(m.group())) for m in re.finditer(r"(.)\1*", token.lower(), re.S)]
        last = max((i for i, (c, _) in enumerate(runs) if c.isalpha()), default=None)
        if last is None:  # signs for all letters: what ends a sentence may be left out, no others
            last = max((i for i, (c, _) in enumerate(runs) if c in SIGNS and c != "!"), default=-1)
        for i, (c, n) in enumerate(runs):
            if c.isalpha():
                one = [(c, 0.0)] if n == 1 else [(c, -0.3 if n > 2 else -6.0), (c * 2, 0.0 if n == 2 else -1.2)]
            elif c in SIGNS:
                dropped = -1.0 * n if i > last else -15.0
                one = [(x * k, -0.7 - 0.7 * (k > 1)) for x in SIGNS[c] for k in ((1, 2) if n > 1 else (1,))] + [("", dropped)]
            elif c == "*" and 0 <= i - 1 and i < last:
                one = [(x, -2.0) for x in "aeiou"] + [("", -1.0)]
            else:
                one = [("", -0.2)]
            out.append(one)
        return out

    def decode(self, token: str, breaks: bool = False) -> str:
        """The likeliest reading, by Viterbi search over states of two characters; with breaks, a blank may precede each place."""
        model = self.model
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for at, options in enumerate(self.lattice(token)):
            if breaks and at:
                options = [*options, *((" " + text, cost) for text, cost in options if text)]
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, said) in best.items():
                for text, cost in options:
                    x, y, s = a, b, score + cost
                    for c in text:
                        k = code(c)
                        s += float(model[x, y, k])
                        x, y = (y, k) if c != " " else (0, 0)
                    if (x, y) not in new or new[x, y][0] < s:
                        new[x, y] = s, said + text
            best = new
        return max((s + float(model[a, b, 0]), said) for (a, b), (s, said) in best.items())[1]

    def words(self, token: str) -> list[str]:
        """The words of a token, restored, in lower case."""
        if (m := _PLAIN(token)) and not _STRETCHED(token):
            return [m[1].lower()]
        if not _LETTER(token):
            return []
        said = self.decode(token)
        plain = _WORD(token.lower())
        return [said] if plain == [said] else [x for x in (said, *plain) if x]

    def row(self, letters: str) -> list[str]:
        """The words of a row of single characters: as one word, without words of one letter at its ends, and cut where words are likeliest to begin."""
        whole = self.words(letters)
        ends = [len(letters) > 3 and self.model[0, code(c.lower()), 0] > _ALONE for c in (letters[0], letters[-1])]
        inner = {letters[i : len(letters) - j] for i in range(1 + ends[0]) for j in range(1 + ends[1])} - {letters}
        cut = self.decode(letters, True).split() if whole else []
        return list(dict.fromkeys([*whole, *(w for x in sorted(inner) for w in self.words(x)), *cut]))


def spaced(tokens: list[str]) -> list[str]:
    """Rows of three or more single characters, joined."""
    out, row = [], []
    for t in [*tokens, "  "]:
        if len(t) == 1:
            row.append(t)
        else:
            if len(row) > 2:
                out.append("".join(row))
            row = []
    return out


def features(word: str) -> list[str]:
    """What may be learned of a word."""
    return [word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) >= n)]


class _Hits(dict):
    """Learned features' numbers of a token; None for most."""

    def __init__(self, decoder: Decoder, known: dict[str, int] | None):
        self.decoder, self.known = decoder, known

    def of(self, token: str, row: bool = False) -> list:
        found = [f for w in (self.decoder.row(token) if row else self.decoder.words(token)) for f in features(w)]
        return found if self.known is None else [self.known[f] for f in found if f in self.known]

    def __missing__(self, token: str):
        found = self.of(token) or None
        if len(token) == 1:
            found = [*(found or []), None]  # says that the text has single characters
        if len(token) <= 64:
            self[token] = found
        return found


def shown(text: str, hits: _Hits) -> list:
    """All features of a text, with repetitions."""
    tokens = text.split()
    found = [f for x in map(hits.__getitem__, tokens) if x for f in x]
    if found.count(None) > 2:
        for t in spaced(tokens):
            found += hits.of(t, True)
    if len(hits) > CACHED:
        hits.clear()
    return [f for f in found if f is not None]


def _value(n: np.ndarray | int):
    return np.minimum(np.log2(1.0 + n), 2.0)


class Model:
    """A fitted score: the decoder's language model, and weights of features."""

    def __init__(self, language: np.ndarray, known: list[str], weights: np.ndarray, bias: float):
        self.language, self.known, self.weights, self.bias = language, known, weights, bias

    def scorer(self):
        hits = _Hits(Decoder(self.language), {f: i for i, f in enumerate(self.known)})

        def score(text: str) -> float:
            z = self.bias + sum(float(self.weights[i] * _value(n)) for i, n in sorted(Counter(shown(text, hits)).items()))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 1500, ridge: float = 3e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent; the step follows from the largest curvature."""
    x = np.hstack([x, np.ones((len(y), 1))]).astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(30):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    rate = np.float32(1 / (0.25 * np.linalg.norm(x @ v) ** 2 / len(y) + ridge))
    w = before = np.zeros(x.shape[1], np.float32)
    for i in range(steps):
        z = w + np.float32(i / (i + 3)) * (w - before)
        before = w
        e = 1 / (1 + np.exp(-np.clip(x @ z, -30, 30))) - y.astype(np.float32)
        w = z - rate * (x.T @ e / len(y) + np.float32(ridge) * z)
    return w[:-1].astype(float), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """docs: all texts, for the language model; labels: (id, toxic), the rows that may be learned from."""
    language = language_model({r.trigram: r.n for r in count_trigrams(docs, text_col).collect()})
    told = labels.select(labels[id_col].alias("__id"), labels["toxic"].cast("int").alias("toxic")).where("toxic in (0, 1) and __id is not null").groupBy("__id").agg(F.max("toxic").alias("toxic"))
    chosen = told.orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(sample)
    rows = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text")).join(chosen, "__id").select("__id", "toxic", "__text").checkpoint()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits(Decoder(language), None)
        for b in batches:
            by = Counter(), Counter()
            for toxic, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                by[toxic].update(set(shown(text or "", hits)))
            found = sorted(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([by[k][f] for f in found], pa.int64()) for k in (1, 0))], names=["feature", "bad", "good"])

    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        share = bad / (bad + good) if bad + good else 0.5
        return Model(language, [], np.zeros(0), math.log((share + 1e-3) / (1 - share + 1e-3)))
    counts = rows.mapInArrow(count, "feature string, bad bigint, good bigint").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log(((F.col("bad") + 0.5) / bad) / ((F.col("good") + 0.5) / good))
    best = counts.where(F.col("bad") >= 3).withColumn("odds", odds).where(F.col("odds") > math.log(6)).orderBy(F.desc(F.col("bad") * F.col("odds")), "feature").limit(most)
    known = sorted(r.feature for r in best.collect())
    index = {f: i for i, f in enumerate(known)}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits(Decoder(language), index)
        for b in batches:
            got = [Counter(shown(t or "", hits)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([list(g) for g in got], pa.list_(pa.int32())), pa.array([list(g.values()) for g in got], pa.list_(pa.int32()))], names=["toxic", "at", "n"])

    seen = rows.mapInArrow(describe, "toxic int, at array<int>, n array<int>").collect()
    x, y = np.zeros((len(seen), len(known)), np.float64), np.array([r.toxic for r in seen], float)
    for i, r in enumerate(seen):
        x[i, r["at"]] = _value(np.array(r["n"], float))
    order = np.lexsort((*x.T, y)) if len(known) else np.arange(len(y))  # by all columns, so that sums don't depend on the order of rows
    w, b = _logistic(x[order], y[order])
    return Model(language, known, w, b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.scorer()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f(t or "") for t in part.column(1).to_pylist()], pa.float64())], names=[id_col, "score"])

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"`{id_col}` {kind}, score double")


def filter_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores under the threshold, with all their columns."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.scorer()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield part.filter(pa.array([f(t or "") < threshold for t in part.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learnable(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels outside the held-out third."""
    return labels.where(~held_out(labels[id_col]))


def held_out(id_: F.Column) -> F.Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 3 == 1, F.lit(False))
