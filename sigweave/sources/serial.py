"""Sketches as JSON and Parquet, and the tables of accuracy results as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.spec import Spec

_WRAP = "18446744073709551616"
MINHASH_RESULTS = "elements bigint, permutations int, word string, memory bigint, approximation double, ground_truth double, time bigint"
HLL_RESULTS = "elements bigint, precision int, bits int, memory bigint, approximation double, ground_truth double, time bigint"


def _unsigned(sketch: Column, spec: Spec) -> Column:
    if spec.kind.bits < 64:
        return sketch
    return F.transform(sketch, lambda w: w.cast("decimal(20,0)") + F.when(w < 0, F.lit(_WRAP).cast("decimal(20,0)")).otherwise(F.lit(0)))


def _raw(values: Column, spec: Spec) -> Column:
    def one(w: Column) -> Column:
        if spec.kind.bits < 64:
            return w.cast(spec.kind.storage)
        wide = w.cast("decimal(21,0)")
        return (wide - F.when(wide >= F.lit(str(1 << 63)).cast("decimal(21,0)"), F.lit(_WRAP).cast("decimal(21,0)")).otherwise(F.lit(0))).cast("bigint")

    return F.when(F.size(values) == spec.permutations, F.transform(values, one)).otherwise(F.raise_error(F.lit("a sketch of another size")).cast("void"))


def to_json(sketch: Column, spec: Spec) -> Column:
    """{"words": [...]} with unsigned integers; null of null."""
    return F.when(sketch.isNotNull(), F.to_json(F.struct(_unsigned(sketch, spec).alias("words"))))


def from_json(text: Column, spec: Spec) -> Column:
    """The sketch of to_json(); null of null, and an error for another number of registers."""
    values = F.from_json(text, "words array<decimal(20,0)>")["words"]
    return F.when(text.isNotNull(), _raw(values, spec))


def array_to_json(counters: Column, spec: Spec) -> Column:
    """{"counters": [{"words": [...]}, ...]}; null of null."""
    return F.when(counters.isNotNull(), F.to_json(F.struct(F.transform(counters, lambda c: F.struct(_unsigned(c["words"], spec).alias("words"))).alias("counters"))))


def array_from_json(text: Column, spec: Spec) -> Column:
    read = F.from_json(text, "counters array<struct<words: array<decimal(20,0)>>>")["counters"]
    return F.transform(read, lambda c: F.struct(_raw(c["words"], spec).alias("words")))


def write_results(df: DataFrame, path: str) -> None:
    """CSV with a header, in a folder for each iteration; only the iterations of df are written anew."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("iteration").csv(path)


def read_results(spark: SparkSession, path: str, schema: str = MINHASH_RESULTS) -> DataFrame:
    """CSV results, also compressed ones."""
    return spark.read.csv(path, header=True, schema=schema)


def unfinished(iterations: DataFrame, *results: DataFrame) -> DataFrame:
    """The iterations that some of the result tables lack."""
    done = iterations
    for r in results:
        done = done.join(r.select("iteration").distinct(), "iteration", "left_semi")
    return iterations.join(done, "iteration", "left_anti")
