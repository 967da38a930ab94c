"""Ids of texts under a byte-level BPE that lower-cases, drops white space and marks word ends, for whole columns at a time.

The texts of a block are lower-cased, split as the tokenizer's pattern splits them, and put
into a dictionary of distinct tokens, all on bytes. Distinct tokens are merged together, row by row of a
matrix: each round makes the best ranked merge of every token. A word with characters for which
the tokenizer's normalizer has tables (all but ASCII and the letters of Latin-1), and a token of more than WIDE bytes,
go to the library; so do all texts if the tokenizer's file asks for another normalizer or pattern.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from sigweave.llm import words

WIDE, ROWS = 32, 1 << 14
#: The normalizer and the pattern that are followed here.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LETTER, _DIGIT, _SIGN, _OTHER, _SPACE = range(5)
_NONE = np.iinfo(np.int32).max


def _kinds() -> np.ndarray:
    """The kind of each byte; of those from 0x80 only 0xC3 and what may follow it are known."""
    out = np.full(256, _OTHER, np.uint8)
    out[0x21:0x7F] = _SIGN
    out[0x30:0x3A] = _DIGIT
    out[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
    out[[0x20, *range(0x09, 0x0E)]] = _SPACE
    return out


_KIND = _kinds()


def _printed() -> list[str]:
    """The character that a byte-level vocabulary has for each byte: printable ones stand for themselves, the others go on from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    out = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [out[b] for b in range(256)]


class _Ranks:
    """Ranks of pairs of ids, in a table with open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, _NONE, np.int32)
        todo = np.arange(len(keys))
        at = self._place(keys)
        while len(todo):
            free = self.keys[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            winner = np.flatnonzero(free)[first]
            self.keys[slot], self.ranks[slot] = keys[todo[winner]], todo[winner]
            left = np.ones(len(todo), bool)
            left[winner] = False
            todo, at = todo[left], (at[left] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; _NONE if it is no merge."""
        keys = (a.astype(np.int64) << 32) | b
        at = self._place(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.ranks[at], _NONE)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            at = (at[todo] + 1) & self.mask if len(at) == len(keys) else (at + 1) & self.mask
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (there >= 0)
            todo, at = todo[on], at[on]
            if not len(todo):
                break
        return out


class WordTokenizer:
    """A tokenizer's file, followed."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        split, model = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}], told["model"]
        self.followed = (
            told.get("normalizer") == _NORMALIZER
            and [s.get("type") for s in split] == ["Split", "ByteLevel"]
            and (split[0]["pattern"], split[0]["behavior"], split[0]["invert"]) == ({"Regex": _PATTERN}, "Removed", True)
            and not split[1]["add_prefix_space"]
            and not split[1]["use_regex"]
            and all(t["content"].startswith("<|") for t in told["added_tokens"])
            and (model["type"], model["end_of_word_suffix"]) == ("BPE", "</w>")
            and not (model["dropout"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"])
        )
        if self.followed:
            ids, self.printed = model["vocab"], _printed()
            pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.ranks = _Ranks(np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64))
            self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
            self.inner = np.array([ids[c] for c in self.printed], np.int32)
            self.last = np.array([ids[c + "</w>"] for c in self.printed], np.int32)

    def _rounds(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ids after all merges, and how many of each row count; ids beyond a row's size are any."""
        n, wide = ids.shape
        out, done_size = ids.copy(), sizes.copy()
        row = np.arange(n)
        place = np.arange(wide)
        rank = np.where(place[None, 1:] < sizes[:, None], self.ranks.of(ids[:, :-1].reshape(-1), ids[:, 1:].reshape(-1)).reshape(n, wide - 1), _NONE)
        while True:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rank)), at]
            live = best != _NONE
            if not live.all():
                gone = ~live
                out[row[gone], : ids.shape[1]], done_size[row[gone]] = ids[gone], sizes[gone]
                row, ids, rank, sizes, at, best = row[live], ids[live], rank[live], sizes[live], at[live], best[live]
            if not len(row):
                return out, done_size
            sizes = sizes - 1
            wide = max(2, int(sizes.max()))
            each = np.arange(len(row))
            new = self.merged[best]
            # What lies behind the merged pair moves up by one.
            moved = place[None, :wide] + (place[None, :wide] > at[:, None])
            ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1))), moved, axis=1)
            ids[each, np.minimum(at, wide - 1)] = new
            moved = place[None, : wide - 1] + (place[None, : wide - 1] >= at[:, None])
            rank = np.take_along_axis(np.pad(rank, ((0, 0), (0, 2)), constant_values=_NONE), moved, axis=1)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.ranks.of(ids[left, at[left] - 1], new[left])
            right = np.flatnonzero(at < sizes - 1)
            rank[right, at[right]] = self.ranks.of(new[right], ids[right, at[right] + 1])
            end = np.flatnonzero((at >= sizes - 1) & (at < wide - 1))
            rank[end, at[end]] = _NONE

    def merge(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct tokens of up to WIDE bytes each, which lie at data[at[i] : at[i + 1]], and n+1 offsets of the tokens in them."""
        sizes = np.diff(at)
        order = np.argsort(sizes, kind="stable")
        got, counts = [], np.zeros(len(sizes), np.int64)
        for low in range(0, len(order), ROWS):
            some = order[low : low + ROWS]
            n, wide = sizes[some], max(2, int(sizes[some[-1]]))
            place = np.arange(wide)
            there = place[None, :] < n[:, None]
            bytes_ = data[np.where(there, at[some][:, None] + place[None, :], 0)]
            ids = self.inner[bytes_]
            each = np.arange(len(some))
            ids[each, n - 1] = self.last[bytes_[each, n - 1]]
            ids, left = self._rounds(ids, n)
            counts[some] = left
            got.append(ids[place[None, :] < left[:, None]])
        flat = np.concatenate(got) if got else np.empty(0, np.int32)
        # From the order of sizes back to the order of tokens.
        begin = np.zeros(len(sizes), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        offsets = np.concatenate([[0], np.cumsum(counts)])
        return flat[np.repeat(begin - offsets[:-1], counts) + np.arange(offsets[-1])], offsets

    def _by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _tokens(self, found: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of distinct tokens."""
        data, at = words.span_of(found)
        raw, size = np.frombuffer(data, np.uint8), np.diff(at)
        short = np.flatnonzero(size <= WIDE)
        few = found.take(pa.array(short)) if len(short) < len(found) else found
        data, at = words.span_of(few)
        raw = np.frombuffer(data, np.uint8)
        ids, offsets = self.merge(raw, at)
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(few), [None, pa.py_buffer(offsets * 4), pa.py_buffer(ids.astype("<u4"))])
        if len(short) == len(found):
            return out
        long = np.flatnonzero(size > WIDE)
        other = []
        for t in found.take(pa.array(long)).to_pylist():
            text = "".join([self.printed[b] for b in t.encode()])
            other.append(np.array([x.id for x in self.tokenizer.model.tokenize(text)], "<u4").tobytes())
        back = np.empty(len(found), np.int64)
        back[short], back[long] = np.arange(len(short)), len(short) + np.arange(len(long))
        return pa.concat_arrays([out, pa.array(other, pa.large_binary())]).take(pa.array(back))

    def encode(self, texts: pa.Array) -> pa.LargeBinaryArray:
        """Ids of each text of a column without nulls as little-endian unsigned 32-bit integers."""
        if not self.followed:
            return pa.array(self._by_library(texts.to_pylist()), pa.large_binary())
        data, offsets = words.span_of(texts)
        raw = np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
        offsets = offsets - offsets[0]
        # The row that each byte's token begins matters only where rows meet; empty rows begin nothing.
        begins = np.zeros(len(raw) + 1, bool)
        begins[offsets] = True
        begins = begins[:-1]
        kind = _KIND[raw]
        text = raw + ((raw - np.uint8(65) < 26) * np.uint8(32))
        lead = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)) if len(raw) else np.empty(0, np.int64)
        kind[lead] = kind[lead + 1] = _LETTER
        after = raw[lead + 1]
        text[lead + 1] = after + ((after < 0x9F) * np.uint8(32))
        space = kind == _SPACE
        first = np.empty(len(raw), bool)  # of a word
        first[:1] = True
        np.logical_or(begins[1:], space[:-1], out=first[1:])
        first &= ~space
        # A word with other characters, or with the start of a special token, is a token of its own, unchanged.
        odd = np.concatenate([np.flatnonzero(kind == _OTHER), np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))])
        head = np.flatnonzero(first)
        at_odd = np.unique(np.searchsorted(head, odd, "right") - 1)
        start = np.empty(len(raw), bool)  # of a token
        start[:1] = True
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        start |= first
        quote = np.flatnonzero((raw == 39) & start)
        self._contractions(text, kind, first, start, quote)
        if len(at_odd):
            ends = np.append(head[1:], len(raw))[at_odd]
            lengths = ends - head[at_odd]
            inside = np.repeat(head[at_odd] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            text[inside] = raw[inside]
            start[inside] = first[inside]
        kept = ~space
        start = start[kept]
        where = np.flatnonzero(start)
        text = text[kept]
        row_at = np.concatenate([[0], np.cumsum(kept)])[offsets] if len(raw) else offsets
        found = pa.LargeStringArray.from_buffers(len(where), pa.py_buffer(np.append(where, len(text)).astype(np.int64)), pa.py_buffer(text)).dictionary_encode()
        which = np.asarray(found.indices).astype(np.int64)
        ids = self._tokens(found.dictionary)
        if len(at_odd):
            odd_token = np.searchsorted(where, np.cumsum(kept)[head[at_odd]] - 1)
            strings = [found.dictionary[int(i)].as_py() for i in which[odd_token]]
            distinct = list(dict.fromkeys(strings))
            number = {s: len(ids) + i for i, s in enumerate(distinct)}
            which[odd_token] = [number[s] for s in strings]
            ids = pa.concat_arrays([ids, pa.array(self._by_library(distinct), pa.large_binary())])
        return words.put_together(ids, which, np.searchsorted(where, row_at))

    @staticmethod
    def _contractions(text: np.ndarray, kind: np.ndarray, first: np.ndarray, start: np.ndarray, quote: np.ndarray) -> None:
        """A quote at a token's start takes what the pattern lets it take, and what follows begins a token."""
        n = len(text)
        if not len(quote):
            return
        ok = lambda i: (i < n) & ~first[np.minimum(i, n - 1)] & (kind[np.minimum(i, n - 1)] == _LETTER)
        one, two = quote + 1, quote + 2
        a, b = text[np.minimum(one, n - 1)], text[np.minimum(two, n - 1)]
        single = ok(one) & np.isin(a, np.frombuffer(b"stmd", np.uint8))
        double = ok(one) & ok(two) & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        start[one[single | double]] = False
        for size, taken in ((2, single), (3, double)):
            nxt = quote[taken] + size
            nxt = nxt[nxt < n]
            start[nxt] = True


@lru_cache(2)
def load(path: str) -> WordTokenizer:
    """One for each worker process and file."""
    return WordTokenizer(path)
