"""A corpus pipeline: each stage calls one operator and hands documents on to the next.

Null text, empty text, repeated rows, null ids and empty tables are as each operator's module
says. A stage keeps all columns of `documents` and no others, but for the last, which returns pieces of
sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.llm import lines, near, packing, pii, queries as q, session, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _as_documents(frame: DataFrame) -> DataFrame:
    """The columns of documents, with the number of characters of the text as it is now."""
    return frame.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold; labels of the held-out third are not learned from."""
    session.checkpoints(spark)
    model = toxicity.fit(docs, toxicity.learnable(q.table(spark, sf_dir, "labels")))
    return toxicity.filter_clean(docs, model).select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later ones without the blocks of lines that they share with earlier ones."""
    session.checkpoints(spark)
    return _as_documents(lines.dedup_lines(docs.select(*COLUMNS)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id; a text without words is in no group."""
    session.checkpoints(spark)
    return near.deduplicated(docs.select(*COLUMNS), k=5, percent=80).select(*COLUMNS)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced."""
    return _as_documents(pii.pseudonymise(docs.select(*COLUMNS), q.KEY))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    session.checkpoints(spark)
    return packing.pack(packing.cut(docs, q.tokenizer("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("pii", pseudonymise),
    ("packing", pack),
]
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the checkpoint folder and read again; a stage's documents are removed when the next stage's are written."""
    session.checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, last = q.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        here = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if last:
            _remove(spark, last)
        last = here
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
