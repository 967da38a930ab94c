"""Near-duplicate groups: similarity sketches, banding, and exact verification.

A document's set is its distinct runs of k words, A-Z in lower case. Its sketch of SIZE
coordinates is filled in rounds: each round hashes every element to a value and a place, the
lower round's value staying; from round SIZE on, round i puts all elements at place i - SIZE,
so that every coordinate fills. A document of many words needs a round or two. BANDS hashes
of ROWS coordinates each bring together pairs that may be similar: a pair at the threshold of 0.8
meets nowhere with a chance of (1 - 0.8**4)**32 = 5e-8.

Documents with equal sets are one class, and only classes go on. All members of a band's bucket
are tied to its least one, and the components of these ties are groups of candidates; links are
confirmed on full sets within a group. A group of at most BLOCK classes is compared as one; a
larger one by blocks of BLOCK, first against HUBS of its classes, and then what
these did not bring together against all. Each comparison gives a tie for each class at most, not a row
for each pair, and the components of these ties are the result.

Null text and text without words: an empty set, linked with nothing. Null ids: such a row
belongs to its class; a component of null ids only has a null id and its rows are kept.
Repeated rows and ids are members of their classes like others. An empty table gives an empty
result. near_duplicates carries no other columns; deduplicated carries all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.llm import graph, words

SIZE, BANDS, ROWS, BLOCK, HUBS = 128, 32, 4, 256, 64
_U = np.uint64
_EMPTY = ~_U(0)


def sketches(g: np.ndarray, at: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Sketch of each text's set, given distinct hashes and offsets; rows of `size` values, a power of two up to 128."""
    n, own = len(at) - 1, words.owners(at)
    out = np.full(n * size, _EMPTY)
    for i in range(2 * size):
        h = words.mix(g ^ words.mix(np.array([i + 1], np.uint64))[0])
        place = own * size + ((h & _U(size - 1)).astype(np.int64) if i < size else i - size)
        np.minimum.at(out, place, (h >> _U(8)) | _U(i << 56))
        lacking = (out.reshape(n, size) == _EMPTY).any(axis=1)
        stay = lacking[own]
        g, own = g[stay], own[stay]
        if not len(g):
            break
    return out.reshape(n, size)


def bands(s: np.ndarray) -> np.ndarray:
    """BANDS bucket names of each sketch."""
    x = words.mix(s.reshape(len(s), BANDS, ROWS))
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(s), BANDS))
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            h = words.mix(h * _U(0x9E3779B97F4A7C15) + x[:, :, r])
    return h


def sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the runs of k words of each text of a block, ascending, and offsets."""
    return words.unique_within(*words.shingles(*words.hashes(texts, lower=True), k))


def _described(docs: DataFrame, k: int) -> DataFrame:
    """(key, key2, id, n, s1, s2, bands) of (key, key2, id, text): size and two sums that name the set, and its buckets."""
    kind = docs.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 2000):
                part = b.slice(first, 2000)
                texts = words.encoded(part.column(3))
                for i, j in words.blocks(texts):
                    g, at = sets(texts[i:j], k)
                    n = np.diff(at)
                    total = np.zeros((2, len(g) + 1), np.uint64)
                    with np.errstate(over="ignore"):
                        np.cumsum(words.mix(g), out=total[0, 1:])
                        np.cumsum(words.mix(g ^ _U(0x5851F42D4C957F2D)), out=total[1, 1:])
                        named = (total[:, at[1:]] - total[:, at[:-1]]).view(np.int64)
                    full = np.flatnonzero(n > 0)
                    keys = bands(sketches(g, np.concatenate([[0], np.cumsum(n[full])]))) if len(full) else np.empty((0, BANDS), np.uint64)
                    lists = words.lists(keys.reshape(-1).view(np.int64), np.concatenate([[0], np.cumsum((n > 0) * BANDS)]), pa.int64())
                    yield pa.RecordBatch.from_arrays([*(part.column(c).slice(i, j - i) for c in range(3)), pa.array(n), pa.array(named[0]), pa.array(named[1]), lists], names=["__key", "__key2", "__id", "n", "s1", "s2", "bands"])

    return docs.select("__key", "__key2", "__id", "__text").mapInArrow(run, f"__key bigint, __key2 bigint, __id {kind}, n bigint, s1 bigint, s2 bigint, bands array<bigint>")


def linked(texts: list[bytes], k: int, percent: int) -> np.ndarray:
    """Least index of the component of each of a bounded number of texts, by links on full sets."""
    g = [sets([t], k)[0] for t in texts]
    n, m = np.array([len(x) for x in g]), len(texts)
    values, own = np.concatenate(g), np.repeat(np.arange(m), n)
    order = np.argsort(values, kind="stable")
    values, own = values[order], own[order]
    new = np.r_[True, values[1:] != values[:-1]] if len(values) else np.empty(0, bool)
    code = np.cumsum(new) - 1
    often = np.bincount(code)[code] > 1 if len(code) else new
    code, own = np.unique(code[often], return_inverse=True)[1], own[often]
    common = np.zeros((m, m), np.float32)
    width = 8192
    for low in range(0, int(code.max()) + 1 if len(code) else 0, width):
        part = (code >= low) & (code < low + width)
        has = np.zeros((m, width), np.float32)
        has[own[part], code[part] - low] = 1
        common += has @ has.T
    common = common.astype(np.int64)
    link = (100 * common >= percent * (n[:, None] + n[None, :] - common)) & (n[:, None] > 0) & (n[None, :] > 0)
    label = np.full(m, -1)
    for i in range(m):
        if label[i] < 0:
            todo = [i]
            label[i] = i
            while todo:
                near = np.flatnonzero(link[todo.pop()] & (label < 0))
                label[near] = i
                todo += near.tolist()
    return label


def _compared(tasks: DataFrame, k: int, percent: int) -> DataFrame:
    """Ties (a, b) among the rows (key, text) of each task (task, part), a bounded number."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("__key").sort_values("__key")
        key = frame["__key"].to_numpy()
        label = linked([(t or "").encode() for t in frame["__text"]], k, percent)
        moved = label != np.arange(len(key))
        return pd.DataFrame({"a": key[moved], "b": key[label[moved]]})

    return tasks.groupBy("task", "part").applyInPandas(run, "a bigint, b bigint")


def _ties(reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Ties (a, b) between the keys of class representatives; their components are those of the links."""
    buckets = reps.select("__key", F.explode("bands").alias("bucket"))
    low = buckets.groupBy("bucket").agg(F.min("__key").alias("low"), F.count("*").alias("size")).where("size > 1").select("bucket", "low")
    stars = buckets.join(low, "bucket").where("__key <> low").select(F.col("__key").alias("a"), F.col("low").alias("b")).distinct()
    member = graph.components(stars).select(F.col("node").alias("__key"), F.col("component").alias("task"))
    total = member.count()
    size = member.groupBy("task").agg(F.count("*").alias("size"))
    held = graph.meet(member, size, "task", "size", total).join(docs.select("__key", "__text").dropDuplicates(["__key"]), "__key").checkpoint()
    found = _compared(held.where(F.col("size") <= BLOCK).withColumn("part", F.lit(0)), k, percent)
    large = held.where(F.col("size") > BLOCK)
    if large.isEmpty():
        return found
    blocks = F.ceil(F.col("size") / (BLOCK - HUBS)).cast("int")
    large = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("__key"), F.col("blocks")).cast("int"))
    hub = large.where(F.pmod(F.xxhash64(F.lit(1), "__key"), F.col("size")) < HUBS)  # about HUBS of each group
    columns = ["task", "part", "__key", "__text"]
    everywhere = hub.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first = _compared(large.withColumn("part", F.col("block")).select(columns).union(everywhere.select(columns)), k, percent).checkpoint()
    joined = graph.components(first)
    placed = large.join(joined, large["__key"] == joined["node"], "left").withColumn("component", F.coalesce("component", "__key")).drop("node")
    most = placed.groupBy("task", "component").agg(F.count("*").alias("n")).groupBy("task").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.sum("n").alias("n"))
    rest = graph.meet(placed, most, "task", "n", total).drop("n").where("component <> most")
    lots = rest.groupBy("task").agg(F.ceil(F.count("*") / (BLOCK // 2)).cast("int").alias("lots"), F.first("size").alias("n"))
    rest = graph.meet(rest, lots, "task", "n", total).drop("n").withColumn("lot", F.pmod(F.xxhash64("__key", F.lit(2)), F.col("lots")).cast("int"))
    # Each lot of what is left meets each block of its group.
    mine = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("part", F.col("lot") * F.col("blocks") + F.col("other"))
    all_ = graph.meet(large, lots, "task", "n", total).drop("n").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).withColumn("part", F.col("lot") * F.col("blocks") + F.col("block"))
    return found.union(first).union(_compared(mine.select(columns).union(all_.select(columns)), k, percent))


def _named(docs: DataFrame, id_col: str, text_col: str) -> tuple[F.Column, F.Column]:
    """Two hashes of 64 bits, which are equal for rows of equal id and text."""
    return F.xxhash64(docs[id_col], docs[text_col]), F.xxhash64(F.lit(1), docs[id_col], docs[text_col])


def _grouped(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(key, key2, id, n, component, component_id) of each row: the component is null of an empty set."""
    key, key2 = _named(docs, id_col, text_col)
    rows = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"), key.alias("__key"), key2.alias("__key2"))
    described = _described(rows, k)
    named = ["n", "s1", "s2"]
    classes = described.where("n > 0").groupBy(*named).agg(F.min("__key").alias("__key"), F.min("__id").alias("least"), F.first("bands").alias("bands")).checkpoint()
    placed = graph.components(_ties(classes, rows, k, percent))
    together = classes.join(placed, classes["__key"] == placed["node"], "left").withColumn("component", F.coalesce("component", "__key")).drop("node")
    least = together.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = together.join(least, "component").select(*(F.col(c).alias(f"__{c}") for c in named), "component", "component_id")
    # A class of one row needs no answer from elsewhere, but costs no more to look up than to tell apart.
    return described.select("__key", "__key2", "__id", *named).join(of_class, F.expr("n = __n and s1 = __s1 and s2 = __s2"), "left").select("__key", "__key2", "__id", "n", "component", "component_id")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row: links have percent / 100 of their union in common, or more."""
    out = _grouped(docs, k, percent, id_col, text_col)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("__id"))
    return out.select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("__id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of near-duplicates, the one with the least id, and all rows without words; all columns.

    Rows are told apart by id and text: of rows that share an id but not a group each group's own stays. Null ids come last. Of rows equal in id
    and text, which are one document listed more than once, any one stays.
    """
    found = _grouped(docs, k, percent, id_col, text_col).where("n > 0")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__key", "__key2")).alias("best"))
    chosen = best.select(F.col("best.__key").alias("b1"), F.col("best.__key2").alias("b2"))
    worded = docs[text_col].rlike("[^\\x20\\x09-\\x0D]")
    own = [f"c{i}" for i in range(len(docs.columns))]
    key, key2 = _named(docs, id_col, text_col)
    plain = docs.where(worded).select(key.alias("k1"), key2.alias("k2"), *(docs[c].alias(o) for c, o in zip(docs.columns, own, strict=True)))
    kept = plain.join(chosen, F.expr("k1 = b1 and k2 = b2"), "left_semi").dropDuplicates(["k1", "k2"]).select(*own).toDF(*docs.columns)
    return kept.union(docs.where(~F.coalesce(worded, F.lit(False))))
