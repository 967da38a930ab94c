"""The queries of this subpackage: each applies one operator to its whole table.

An operator returns texts, spans or sketches; a query derives the digest columns from them
with SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.llm import chat, fingerprints, lines, near, oracle, packing, pieces, pii, quality, session, substrings, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def sha(column: str) -> F.Column:
    """Lowercase hex SHA-256 of a string's UTF-8 or of bytes."""
    return F.sha2(F.col(column).cast("binary"), 256)


#: The key of the queries' pseudonyms; an owner of data takes a secret one.
KEY = "an example key, known to all"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(table(spark, sf_dir, "documents"), KEY)
    return out.select("doc_id", "n_private", "text")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.edited(fingerprints.with_next(table(spark, sf_dir, "documents")))
    f = fingerprints
    return out.select(
        "doc_id", "n_chars", sha("edited_text").alias("edited_sha256"), f.as_string(F.col("sketch")).alias("fingerprint"), f.as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        f.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), f.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.checkpoints(spark)
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", sha("text").alias("text_sha256"), "text")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.checkpoints(spark)
    return near.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.checkpoints(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.checkpoints(spark)
    return packing.pack(packing.cut(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.checkpoints(spark)
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", sha("kept").alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.checkpoints(spark)
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    out = chat.read_back(chat.format_records(chat.records(rows.unionByName(hard))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), sha("loss_text").alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), sha("ids").alias("ids_sha256"), sha("decoded").alias("decoded_sha256"))


def queries() -> dict[str, Query]:
    return {
        "op1_pii": op1_pii,
        "op2_line_dedup": op2_line_dedup,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_toxicity": op4_toxicity,
        "op5_packing": op5_packing,
        "op6_fingerprints": op6_fingerprints,
        "op7_substrings": op7_substrings,
        "op8_quality": op8_quality,
        "op9_chat": op9_chat,
        "op10_sentencepiece": op10_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
