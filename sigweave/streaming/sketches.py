"""Sketches over streams: running register-wise minima. Replayed and late rows change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.functions.expressions import _ordered
from sigweave.functions.hashing import hash_stream
from sigweave.spec import Spec


def stream_registers(events: DataFrame, keys: list[str], value: str, spec: Spec, time_col: str | None = None, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """(keys[, window], i, h) of a streaming table: each group's registers, by event-time windows if a time column is named."""
    if time_col:
        events = events.withWatermark(time_col, watermark)
        by = [*keys, F.window(time_col, window).alias("window")]
    else:
        by = list(keys)
    rows = events.where(F.col(value).isNotNull()).select(*by, F.posexplode(hash_stream(F.col(value), spec)).alias("i", "h"))
    names = [*keys, *(["window"] if time_col else []), "i"]
    return rows.groupBy(*names).agg(F.min(_ordered(F.col("h"), spec.kind)).alias("h")).withColumn("h", _ordered(F.col("h"), spec.kind))


def assembled(registers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, words) of a table that a stream of registers has written."""
    return registers.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]).alias("words"))
