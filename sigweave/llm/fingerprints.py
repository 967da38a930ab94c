"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

The sketch of a text is every hash of its runs of K words that lies below a fixed
fraction of the hashes' range. The fraction is the same for all documents, so that a sketch's size follows
its document's, sketches of parts merge to the sketch of the whole by union, and the
share of the smaller sketch that the larger holds estimates containment, also between very
unequal documents. Where nothing lies below the fraction the least hash alone stands for the text, as a negative
number; a merge drops it as soon as either side has a hash below the fraction, so that merging stays exact. So only a text
without words has an empty sketch. A text of fewer than K words is one run.

Null text is as empty. Two empty sketches have likeness 1, an empty and another 0. Very
long texts and repeated rows need no care; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, FRACTION_BITS = 5, 2
#: Documents of a bucket in which neighbours are looked up, quantiles that bound buckets, and buckets (24 bytes each) up to which their table is broadcast.
BUCKET, QUANTILES, BROADCAST = 1000, 256, 200_000
_LEAST = -(1 << 63)


def let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.transform(F.array(value), f)[0]


def retained(hashes: Column, fraction_bits: int = FRACTION_BITS) -> Column:
    """The distinct hashes below the fraction, ascending; where there is none, -1 - the least hash."""
    low = F.array_sort(F.array_distinct(F.filter(hashes, lambda v: v < (1 << (63 - fraction_bits)))))
    return F.when((F.size(low) == 0) & (F.size(hashes) > 0), F.array(-1 - F.array_min(hashes))).otherwise(low)


def sketch(text: Column, k: int = K, fraction_bits: int = FRACTION_BITS) -> Column:
    """Ascending hashes, of 63 bits each, that lie in the lowest 2 ** -fraction_bits of their range."""

    def runs(h: Column) -> Column:
        n = F.size(h)
        each = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(h, i + j) for j in range(k))), 1))
        return F.when(n >= k, each).when(n > 0, F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(h.cast("array<string>"), " ")), 1))).otherwise(F.array().cast("array<bigint>"))

    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return let(let(F.transform(words, lambda w: F.xxhash64(w)), runs), lambda h: retained(h, fraction_bits))


def likeness(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the larger holds."""
    least = F.least(F.size(a), F.size(b))
    empty = F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)
    return F.when(least == 0, empty).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(least, F.lit(1)))


def merge(a: Column, b: Column) -> Column:
    """Sketch of the shingles of both: what retained() gives of the hashes of both."""

    def of(u: Column) -> Column:
        low = F.filter(u, lambda v: v >= 0)
        return F.when((F.size(low) == 0) & (F.size(u) > 0), F.array(F.array_max(u))).otherwise(low)

    return let(F.array_sort(F.array_union(a, b)), of)


def as_string(s: Column) -> Column:
    return F.lower(F.array_join(F.transform(s, lambda v: F.lpad(F.hex(v), 16, "0")), ""))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, sketch, next_text, next_sketch): each row and the one after it, by descending id; the first comes after the last.

    Null ids come last; equal ids are ordered by text. Rows are put into ranges of ids of about
    BUCKET rows, bounded by quantiles and, for more ranges than these, by even steps
    between quantiles; each range also gets a copy of the first row of the one below.
    """
    rows = docs.select(docs[id_col].alias("__id"), F.coalesce(docs[text_col], F.lit("")).alias("__text")).withColumn("__ord", F.coalesce(F.col("__id").cast("long"), F.lit(_LEAST)))
    n, cuts = rows.agg(F.count("*"), F.percentile_approx("__ord", [i / QUANTILES for i in range(QUANTILES + 1)], 10000)).first()
    parts = max(1, -(-n // BUCKET))
    bounds = sorted(set(cuts or []))[:: max(1, QUANTILES // parts)]
    steps = max(1, -(-parts // QUANTILES))
    if bounds:
        at = F.greatest(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("__ord"))), F.lit(1))
        low = F.element_at(F.array(*map(F.lit, bounds)), at)
        high = F.element_at(F.array(*map(F.lit, [*bounds[1:], bounds[-1] + 1])), at)
        step = F.least(F.lit(steps - 1), F.floor((F.col("__ord").cast("double") - low.cast("double")) / F.greatest(high.cast("double") - low.cast("double"), F.lit(1.0)) * steps)) if steps > 1 else F.lit(0)
        bucket = at.cast("long") * steps + step.cast("long")
    else:
        bucket = F.lit(0).cast("long")
    rows = rows.withColumn("__bucket", bucket)
    # One row a range: its highest id, and the range that needs a copy of that row. The range after the last
    # between two quantiles is the first after the next quantile, of which there are QUANTILES at most.
    between = F.floor(F.col("__bucket") / steps)
    tops = rows.groupBy("__bucket").agg(F.max("__ord").alias("top")).withColumn("__quantile", between)
    first = tops.groupBy("__quantile").agg(F.min("__bucket").alias("first"))
    turn = Window.orderBy("__quantile")
    first = first.select(F.col("__quantile").alias("__q"), F.coalesce(F.lead("first").over(turn), F.first("first").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    above = F.coalesce(F.lead("__bucket").over(Window.partitionBy("__quantile").orderBy("__bucket")), F.col("next"))
    tops = tops.join(F.broadcast(first), F.col("__quantile") == F.col("__q")).select(F.col("__bucket").alias("from"), "top", above.alias("to"))
    tops = F.broadcast(tops) if len(bounds) * steps <= BROADCAST else tops
    copies = rows.join(tops, (rows["__bucket"] == tops["from"]) & (rows["__ord"] == tops["top"])).groupBy("to", "top").agg(F.min("__text").alias("__text"))
    copies = copies.select(F.lit(None).cast(rows.schema["__id"].dataType).alias("__id"), "__text", F.col("top").alias("__ord"), F.col("to").alias("__bucket"), F.lit(True).alias("__copy"))
    # Dealt out before the sketches are made, so that these don't go through the shuffle.
    both = rows.withColumn("__copy", F.lit(False)).unionByName(copies).repartition("__bucket").withColumn("sketch", sketch(F.col("__text")))
    order = Window.partitionBy("__bucket").orderBy("__copy", F.desc("__ord"), "__text")
    out = both.withColumns({"next_text": F.lead("__text").over(order), "next_sketch": F.lead("sketch").over(order)}).where("not __copy")
    return out.select(F.col("__id").alias(id_col), F.col("__text").alias("text"), "sketch", "next_text", "next_sketch")


def edited(docs: DataFrame) -> DataFrame:
    """Adds to with_next() rows n_chars, edited_text and edited_sketch: the last half of the code points gives way to the next text's first as many."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = docs.withColumn("n_chars", n.cast("long")).withColumn("edited_text", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    return rows.withColumn("edited_sketch", sketch(F.col("edited_text")))
