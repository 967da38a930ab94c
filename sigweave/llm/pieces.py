"""SentencePiece BPE encoding and decoding, by backtracking over longest matches.

Pieces are tried longest first (Aho-Corasick automata over the vocabulary give the matches
at a place). A piece may follow another if re-merging the two by the model's scores gives the
two again; a sequence whose neighbours all fit is the one that the merges give. Where no piece
fits, the position is set in a bitfield of failed positions and the last piece gives way to a
shorter one. Each position fails once at most, so the time is linear in the text.

No piece of a BPE model goes over a word's start, so that a block's distinct words are encoded one by one and
a bounded cache serves those met before. Texts are decoded from their ids, by a table of what each id stands for.

Null text is as empty; empty text gives the begin and end ids only and decodes to empty
text. Other columns, duplicates and null ids pass through.
"""

from __future__ import annotations

import functools
import heapq
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sigweave.llm import words

SPACE = "▁"
CACHED = 400_000


class PieceModel:
    """A BPE model with byte fallback and the identity normalizer."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not (n.add_dummy_prefix and n.escape_whitespaces):
            raise ValueError("only BPE models with an identity normalizer and a dummy prefix are handled")
        self.bos = next(i for i, p in enumerate(m.pieces) if p.piece == "<s>")
        self.eos = next(i for i, p in enumerate(m.pieces) if p.piece == "</s>")
        self.byte = [0] * 256
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.text: list[bytes] = []
        for i, p in enumerate(m.pieces):
            self.text.append(p.piece.replace(SPACE, " ").encode())
            if p.type == 1:
                self.score[p.piece], self.id[p.piece] = p.score, i
            elif p.type == 6:
                self.byte[int(p.piece[1:-1], 16)] = i
                self.text[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type in (2, 3):
                self.text[i] = b""
            else:
                raise ValueError(f"piece of kind {p.type}")
        if any(SPACE in p.strip(SPACE) or p.endswith(SPACE) and p.strip(SPACE) for p in self.id):
            raise ValueError("a piece goes over a word's start")
        self.units = words.Recent(CACHED)
        self._fits: dict[tuple[str, str], bool] = {}
        # A piece's rank is the turn at which merging makes it; its halves are what it is made of.
        self.rank = {p: r for r, p in enumerate(sorted(self.score, key=lambda p: -self.score[p]))}
        self.halves: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for p, r in self.rank.items():
            for i in range(1, len(p)):
                a, b = p[:i], p[i:]
                if (len(a) == 1 or a in self.halves) and (len(b) == 1 or b in self.halves) and self._stays(a, b, r):
                    self.halves[p] = a, b
                    self.automaton.add_word(p, len(p))
                    break
        self.automaton.make_automaton()
        self.longest = ahocorasick.Automaton()
        for p in self.score:
            if len(p) == 1 or p in self.halves:
                self.longest.add_word(p, p)
        self.longest.make_automaton()
        # A line feed that no longer piece holds stands alone, so that words also end there.
        self.lone_line_feed = not any("\n" in p for p in self.halves)
        # What each id decodes to, and after these what it decodes to as a text's first, where a space goes.
        first = [t if i in self._byte_ids else t.removeprefix(b" ") for i, t in enumerate(self.text)]
        self.table = pa.array(self.text + first, pa.large_binary())

    def _turn(self, p: str) -> int:
        """When merging makes a piece; characters are there from the start."""
        return self.rank[p] if p in self.halves else -1

    def _stays(self, a: str, b: str, until: int) -> bool:
        """Whether merging a + b by the pieces ranked before `until` leaves a and b side by side.

        The merges next to the border are undone, the last first. Before each, what then met
        at the border must not have had an earlier turn of its own; of equal pieces the left
        one is merged first.
        """
        rank = self.rank
        while True:
            if (r := rank.get(a + b)) is not None and r < until:
                return False
            x, y = self._turn(a), self._turn(b)
            if x < 0 and y < 0:
                return True
            if x > y:
                until, a = x, self.halves[a][1]
            else:
                until, b = y + 1, self.halves[b][0]

    def merged(self, s: str) -> list[str]:
        """The pieces that merging itself gives, best score first and leftmost among equals; what split() must equal."""
        parts: list[str] = list(s)
        left, right = list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 <= j and (score := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-score, i, j, len(parts[i]) + len(parts[j])))

        for i in range(len(s) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not parts[i] or not parts[j] or right[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p]

    def fits(self, a: str, b: str) -> bool:
        """Whether merging a + b gives a and b."""
        if (ok := self._fits.get((a, b))) is None:
            if len(self._fits) > CACHED:
                self._fits.clear()
            ok = self._fits[a, b] = self._stays(a, b, len(self.rank))
        return ok

    def matches(self, s: str) -> list[list[int]]:
        """Lengths of the pieces at each place, longest last; a single character always counts."""
        found: list[list[int]] = [[1] for _ in s]
        for end, size in self.automaton.iter(s):
            found[end + 1 - size].append(size)
        return found

    def split(self, s: str) -> list[str]:
        """The pieces of a word. Mostly they are the longest matches, one after the other; where these don't fit, others are tried."""
        taken = [p for _, p in self.longest.iter_long(s)]
        known = self._fits.get
        for pair in zip(taken, taken[1:]):
            if not (known(pair) or self.fits(*pair)):
                return self.tried(s)
        return taken if sum(map(len, taken)) == len(s) else self.tried(s)

    def tried(self, s: str) -> list[str]:
        """The pieces of a word; a place is set in `failed` if no pieces lead on from it to the end."""
        found, failed = self.matches(s), bytearray(len(s) // 8 + 1)
        taken: list[tuple[int, int]] = []  # where a piece starts, and which of the matches there it is
        at, choice = 0, len(found[0]) - 1
        while at < len(s):
            last = s[taken[-1][0] : at] if taken else ""
            sizes = found[at]
            while choice >= 0:
                end = at + sizes[choice]
                if not failed[end >> 3] >> (end & 7) & 1 and (not last or self.fits(last, s[at:end])):
                    taken.append((at, choice))
                    at = end
                    choice = len(found[at]) - 1 if at < len(s) else 0
                    break
                choice -= 1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at, choice = taken.pop()
                choice -= 1
        ends = [i for i, _ in taken[1:]] + [at]
        return [s[i:j] for (i, _), j in zip(taken, ends, strict=True)]

    def word(self, w: str) -> bytes:
        """Ids of a word as little-endian 32-bit integers; blanks may stand for word marks."""
        found = self.split(w.replace(" ", SPACE))
        try:
            ids = [self.id[p] for p in found]
        except KeyError:
            ids = []
            for p in found:
                if (i := self.id.get(p)) is not None:
                    ids.append(i)
                else:
                    ids += [self.byte[b] for b in p.encode()]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_column(self, texts: pa.Array) -> pa.LargeBinaryArray:
        """Ids with begin and end of each text of a column without nulls, as little-endian 32-bit integers."""
        texts = pc.replace_substring(texts.cast(pa.large_string()), SPACE, " ")
        data, at = words.span_of(pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))))
        first, end = int(at[0]), int(at[-1])
        raw, at = np.frombuffer(data, np.uint8, end - first, first), at - first
        space = raw == 0x20
        begins = np.zeros(len(raw) + 1, bool)
        begins[1:-1] = space[1:] & ~space[:-1]
        if self.lone_line_feed:
            feed = np.flatnonzero(raw == 10)
            begins[feed] = begins[feed + 1] = True
        begins[at] = True
        starts = np.flatnonzero(begins[:-1])
        found, which = words.units(data, starts + first, end)
        new = self.units.missing(found)
        self.units.young.update(zip(new, map(self.word, new), strict=True))
        held = [*map(self.units.young.__getitem__, found), struct.pack("<I", self.bos), struct.pack("<I", self.eos)]
        self.units.forget(new)
        rows, n = np.searchsorted(starts, at), len(texts)
        ends = rows + 2 * np.arange(n + 1)
        all_ = np.full(len(which) + 2 * n, len(found), np.int64)  # begin ids but for what follows
        all_[ends[1:] - 1] = len(found) + 1
        all_[np.arange(len(which)) + 2 * np.searchsorted(rows, np.arange(len(which)), "right") - 1] = which
        return words.put_together(held, all_, ends)

    def decode_column(self, ids: pa.LargeBinaryArray) -> pa.LargeStringArray:
        """The text of each row of ids of encode_column."""
        _, at, data = ids.buffers()
        at = np.frombuffer(at, np.int64, len(ids) + 1) // 4 if len(ids) else np.zeros(1, np.int64)
        flat = np.frombuffer(data, "<u4", int(at[-1])).astype(np.int64)
        second = at[:-1] + 1  # behind the begin id
        flat[second] += len(self.text)
        return words.put_together(self.table, flat, at).cast(pa.large_string())

    def encode_decode(self, text: str) -> tuple[bytes, bytes]:
        """Ids with begin and end, as little-endian 32-bit integers, and the text that they decode to."""
        ids = self.encode_column(pa.array([text], pa.large_string()))
        return ids[0].as_py(), self.decode_column(ids)[0].as_py().encode()

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: the first space goes, control ids give nothing, broken bytes U+FFFD each."""
        out: list[bytes] = []
        first = True
        for i in ids:
            t = self.text[i]
            if first and t:
                t, first = t.removeprefix(b" ") if i not in self._byte_ids else t, False
            out.append(t)
        return b"".join(out).decode("utf-8", "replace")

    @functools.cached_property
    def _byte_ids(self) -> set[int]:
        return set(self.byte)


@functools.lru_cache(2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) of each row: ids are binary, little-endian unsigned 32-bit integers, with begin and end."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for b in batches:
            texts = b.column(1).fill_null("")
            for first, last in words.slices(words.span_of(texts)[1]):
                ids = model.encode_column(texts.slice(first, last - first))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), ids.cast(pa.binary()), model.decode_column(ids).cast(pa.string())], names=[id_col, "ids", "decoded"])

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, schema)
