"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from laneflow.session import materialise

__all__ = ["materialise", "small_batches", "table", "utf8", "fresh", "forgettable", "release"]

# Rows and bytes in one Arrow batch.  Texts may be very long, and rows may hold
# trees or indexes, so a batch of the default size could outgrow a Python worker.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_FORGET: list[Callable[[], None]] = []


def forgettable(make: Callable) -> Callable:
    """``functools.cache`` for what may be large: :func:`release` empties it."""
    kept = cache(make)
    _FORGET.append(kept.cache_clear)
    return kept


def release() -> None:
    """Give memory that this Python worker has freed back to the machine, and what other operators remember in it.

    Workers live on after their stage, idle or at work for the next one, and would hold it.
    """
    for forget in _FORGET:
        forget()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.pythonapi, "malloc_trim", None):
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | Column) -> Column:
    """The UTF-8 bytes of a text column, none for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit("")).cast("binary")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that start with the given ones and clash with none of ``df``."""
    taken, made = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        made.append(name)
    return made
