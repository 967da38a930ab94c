"""Candidate pairs and similarity joins over sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.functions.expressions import band_matches, is_empty, jaccard
from sigweave.functions.hashing import band_hashes
from sigweave.spec import Spec


def classes(df: DataFrame, id_col: str, sketch: str = "words") -> DataFrame:
    """(id, representative): rows of equal sketches are one class, named by its least id."""
    low = df.groupBy(sketch).agg(F.min(id_col).alias("representative"))
    return df.select(id_col, sketch).join(low, sketch).select(id_col, "representative")


def _representatives(df: DataFrame, id_col: str, sketch: str, spec: Spec) -> DataFrame:
    """One row for each sketch that isn't empty; empty ones agree in all bands and would all be pairs."""
    return df.where(~is_empty(F.col(sketch), spec)).groupBy(F.col(sketch).alias("words")).agg(F.min(id_col).alias("id"))


def candidate_pairs(df: DataFrame, id_col: str, spec: Spec, bands: int, sketch: str = "words") -> DataFrame:
    """(left_id, right_id, matches): pairs of class representatives, left < right, that agree in a band at the same place, and in how many.

    Copies are joined to their class by `classes`, so that a group of equal sketches gives no pairs.
    """
    rows = _representatives(df, id_col, sketch, spec).select("id", F.posexplode(band_hashes(F.col("words"), spec, bands)).alias("band", "hash"))
    left, right = rows.withColumnRenamed("id", "left_id"), rows.withColumnRenamed("id", "right_id")
    met = left.join(right, ["band", "hash"]).where("left_id < right_id")
    return met.groupBy("left_id", "right_id").agg(F.count("*").alias("matches"))


def similarity_join(df: DataFrame, id_col: str, spec: Spec, bands: int, threshold: float, sketch: str = "words") -> DataFrame:
    """(left_id, right_id, matches, jaccard): the candidate pairs whose estimate is at least the threshold."""
    words = _representatives(df, id_col, sketch, spec)
    # Registers that differ lie in no more bands than they are; the others agree.
    least = bands - sum(1 for n in range(1, spec.permutations + 1) if (spec.permutations - n) / spec.permutations >= threshold)
    pairs = candidate_pairs(df, id_col, spec, bands, sketch).where(F.col("matches") >= least)
    both = pairs.join(words.toDF("a", "left_id"), "left_id").join(words.toDF("b", "right_id"), "right_id")
    return both.withColumn("jaccard", jaccard(F.col("a"), F.col("b"))).where(F.col("jaccard") >= threshold).select("left_id", "right_id", "matches", "jaccard")


def similar_to(queries: DataFrame, df: DataFrame, id_col: str, spec: Spec, bands: int, sketch: str = "words") -> DataFrame:
    """The rows of `queries` with a candidate in df: a semi-join on (band, hash)."""
    keyed = lambda x: x.select(id_col, F.posexplode(band_hashes(F.col(sketch), spec, bands)).alias("band", "hash"))
    found = keyed(queries).join(keyed(df).select("band", "hash"), ["band", "hash"], "left_semi").select(id_col).distinct()
    return queries.join(found, id_col, "left_semi")


def pairwise_jaccard(left: DataFrame, right: DataFrame, on: list[str], id_col: str, sketch: str = "words") -> DataFrame:
    """(on, left_id, right_id, jaccard) of all pairs, left < right, that agree in the columns `on`, which must keep groups small."""
    a = left.select(*on, F.col(id_col).alias("left_id"), F.col(sketch).alias("a"))
    b = right.select(*on, F.col(id_col).alias("right_id"), F.col(sketch).alias("b"))
    return a.join(b, on).where("left_id < right_id").select(*on, "left_id", "right_id", jaccard(F.col("a"), F.col("b")).alias("jaccard"))


__all__ = ["band_matches", "candidate_pairs", "classes", "pairwise_jaccard", "similar_to", "similarity_join"]
