"""Ids of whole columns against the library."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest

from sigweave.llm import queries, wordpieces

ODD = [
    "", "it's IT'S don't we'll WE'RE 've x'm ''s \"'s 's a'sb 'rest i'd 'l 'll", "ÀÉÿß × ÷ ñandú Ñ 'ß", "日本語 text …dots naïve é", "<|endoftext|> x<|startoftext|>y <|",
    "a\tb\nc  d\r\n e\x0b\x0cf \x1c \x00 \x7f", "12345 3.14 $%^ a1b2", "x" * 5000 + " " + "é" * 40, "'", "s", "'s", " 's ", "a'", "Ünïcödé Æ œ Œ ł Ł İstanbul", " nbsp  em ªºµ", "''s '’s", "l'll'll", "t'st",
]


@pytest.fixture(scope="module")
def tokenizer():
    return wordpieces.load(queries.tokenizer("word_bpe_49k.json"))


def check(tokenizer, texts):
    got = tokenizer.encode(pa.array(texts, pa.string())).to_pylist()
    assert len(got) == len(texts)
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == tokenizer.tokenizer.encode(t, add_special_tokens=False).ids, t[:100]


def test_odd(tokenizer):
    assert tokenizer.followed
    for texts in (ODD, ODD[::-1], [], [""], ["", ""], ["a", "", "", "b"]):
        check(tokenizer, texts)


@pytest.mark.parametrize("letters", ["ab 'srtlvemdES\nÉé×1<|.-…日\t", "abcdefghijklmnopqrstuvwxyz", "é'S LL"])
def test_random(tokenizer, letters):
    rng = random.Random(letters)
    check(tokenizer, ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) + " " + "a" * rng.randrange(40) for _ in range(2000)])


def test_slices(tokenizer):
    column = pa.array(["one two", None, "three's a crowd", "", "four"]).fill_null("")
    assert tokenizer.encode(column.slice(2, 3)).to_pylist() == tokenizer.encode(pa.array(["three's a crowd", "", "four"])).to_pylist()


def test_other_file(tokenizer, tmp_path):
    """A file with another normalizer is left to the library."""
    with open(queries.tokenizer("word_bpe_49k.json"), encoding="utf-8") as f:
        told = json.load(f)
    told["normalizer"] = {"type": "NFC"}
    (tmp_path / "other.json").write_text(json.dumps(told), encoding="utf-8")
    other = wordpieces.WordTokenizer(str(tmp_path / "other.json"))
    assert not other.followed
    check(other, ["It's Upper", "", "é"])
