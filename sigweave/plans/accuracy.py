"""The accuracy study: sketches of generated sets against exact similarity, and its summaries."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.functions import kernels as k
from sigweave.functions.expressions import jaccard
from sigweave.operators.sketching import minhash_agg
from sigweave.spec import SIP, WORDS, Hasher, Spec

SIZES = (10, 100, 1_000, 10_000, 100_000, 1_000_000, 10_000_000, 100_000_000)
PERMUTATIONS = tuple(2**i for i in range(1, 14))
_SALT = {"a": 4567, "b": 47325567}


def generate_sets(spark: SparkSession, sizes: list[int], iterations: int) -> DataFrame:
    """(elements, iteration, side, value): two sets for each size and iteration, of as many generator steps modulo the size, distinct.

    A set is made by one task, in blocks; sets are spread over tasks.
    """
    cases = spark.createDataFrame([(n, i, s) for n in sizes for i in range(iterations) for s in _SALT], "elements bigint, iteration bigint, side string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, i, side in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = int(k.splitmix(np.array([_SALT[side] * (n + 1) * (i + 1) & k.M64], np.uint64))[0])
                for at in range(0, n, 1 << 16):
                    out = []
                    for _ in range(min(1 << 16, n - at)):
                        x ^= x << 13 & k.M64
                        x ^= x >> 7
                        x ^= x << 17 & k.M64
                        out.append(x % n)
                    m = len(out)
                    yield pa.RecordBatch.from_arrays([pa.array([n] * m), pa.array([i] * m), pa.array([side] * m), pa.array(out, pa.int64())], names=["elements", "iteration", "side", "value"])

    made = cases.repartition(len(sizes) * iterations * 2, "elements", "iteration", "side").mapInArrow(run, "elements bigint, iteration bigint, side string, value bigint")
    return made.distinct()


def exact(sets: DataFrame) -> DataFrame:
    """(elements, iteration, ground_truth)"""
    by = sets.groupBy("elements", "iteration", "value").agg(F.count("*").alias("sides"))
    return by.groupBy("elements", "iteration").agg((F.count_if(F.col("sides") == 2) / F.count("*")).alias("ground_truth"))


def _paired(sketches: DataFrame, estimate: Column) -> DataFrame:
    a, b = (sketches.where(F.col("side") == s).select("elements", "iteration", F.col("words").alias(s)) for s in _SALT)
    return a.join(b, ["elements", "iteration"]).select("elements", "iteration", estimate.alias("approximation"))


def minhash_results(sets: DataFrame, spec: Spec) -> DataFrame:
    """Rows of results for one configuration, without the time."""
    held = minhash_agg(sets, ["elements", "iteration", "side"], "value", spec)
    out = _paired(held, jaccard(F.col("a"), F.col("b"))).join(exact(sets), ["elements", "iteration"])
    return out.select("elements", "iteration", F.lit(spec.permutations).alias("permutations"), F.lit(spec.word).alias("word"), F.lit(spec.permutations * spec.kind.bits).cast("long").alias("memory"), "approximation", "ground_truth")


def hll_results(sets: DataFrame, precision: int) -> DataFrame:
    """The same by HyperLogLog: estimates of both sides and of their union. Spark's sketches have one register width."""
    held = sets.groupBy("elements", "iteration", "side").agg(F.hll_sketch_agg("value", precision).alias("words"))
    both = F.hll_sketch_estimate(F.hll_union("a", "b"))
    common = F.hll_sketch_estimate("a") + F.hll_sketch_estimate("b") - both
    out = _paired(held, F.greatest(F.lit(0.0), common / F.greatest(both, F.lit(1)))).join(exact(sets), ["elements", "iteration"])
    return out.select("elements", "iteration", F.lit(precision).alias("precision"), F.lit(6).alias("bits"), F.lit(6 << precision).cast("long").alias("memory"), "approximation", "ground_truth")


def timed(df: DataFrame) -> DataFrame:
    """df with the microseconds that making it took, in all; it is made once."""
    began = time.perf_counter()
    held = df.cache()
    held.count()
    return held.withColumn("time", F.lit(int((time.perf_counter() - began) * 1e6)).cast("long"))


def sweep(spark: SparkSession, sizes: list[int], iterations: int, permutations: list[int] | None = None, words: list[str] | None = None, precisions: list[int] | None = None, hasher: Hasher = SIP) -> tuple[DataFrame, DataFrame]:
    """All configurations over generated sets: results of sketches and of HyperLogLog."""
    sets = generate_sets(spark, sizes, iterations).cache()
    specs = [Spec(p, w, hasher) for w in (words or [w for w in WORDS if w != "usize"]) for p in (permutations or PERMUTATIONS)]
    mine = [timed(minhash_results(sets, s)) for s in specs]
    theirs = [timed(hll_results(sets, p)) for p in (precisions or range(4, 17))]
    return tuple(_all(x) for x in (mine, theirs))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def with_squared_error(results: DataFrame) -> DataFrame:
    return results.withColumn("mse", F.pow(F.col("approximation") - F.col("ground_truth"), 2))


def summary(results: DataFrame, keys: list[str], values: tuple[str, ...] = ("mse", "time")) -> DataFrame:
    """Mean, sample standard deviation and count of each value by keys, and the product of mean error and mean time."""
    out = results.groupBy(*keys).agg(*(f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("count", F.count))))
    return out.withColumn("mse_time", F.col("mse_mean") * F.col("time_mean")) if set(values) >= {"mse", "time"} else out


def curve(table: DataFrame, word: str, elements: int, by: str = "memory") -> DataFrame:
    """One line of a figure: a word type and set size, timed, in order of memory or mean time."""
    return table.where((F.col("word") == word) & (F.col("elements") == elements) & (F.col("time_mean") > 0)).orderBy(by)


def distinct_values(table: DataFrame, column: str) -> DataFrame:
    return table.select(column).distinct().orderBy(column)
