"""Row-order building blocks that never put one whole key into one task.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task, so a
key that holds a third of the table stalls the job.  Here rows get an exact
position per key in two levels (time chunks, then within a chunk), positions
are cut into blocks of fixed size, and windows run per ``(key, block)``.  Rows
near a block edge are copied into the neighbouring block (a halo), so bounded
frames stay exact.  Unbounded frames use one summary row per block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from laneflow.functions.columns import bin_number, interval_seconds

BLOCK_ROWS = 4096
POS = "__pos"
BLOCK = "__block"


def with_position(
    df: DataFrame,
    order: str,
    keys: list[str] | None = None,
    tiebreak: list[str] | None = None,
    chunk: str = "1d",
    out: str = POS,
    total: str | None = None,
) -> DataFrame:
    """Exact zero-based row position per key (or over the whole table) by time.

    Rows are numbered inside ``(key, time chunk)``; chunk sizes are prefix-summed
    over the far smaller chunk table, which also gives the key's row count
    (``total``) without a join on the key alone.
    """
    keys = list(keys or [])
    chunked = df.withColumn("__chunk", bin_number(order, interval_seconds(chunk)))
    group = [*keys, "__chunk"]
    sizes = chunked.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("__n").over(Window.partitionBy(*keys)).alias(total)] if total else []
    offsets = sizes.select(*group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"), *whole)
    inside = Window.partitionBy(*group).orderBy(order, *(tiebreak or []))
    numbered = chunked.withColumn("__rn", F.row_number().over(inside) - 1)
    placed = numbered.join(offsets, group)
    return placed.withColumn(out, F.col("__offset") + F.col("__rn")).drop("__chunk", "__rn", "__offset")


def blocked_window(
    df: DataFrame,
    columns: Callable[[Window], dict[str, Column]],
    before: int,
    after: int,
    keys: list[str],
    pos: str = POS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add window columns whose frames reach at most ``before`` rows back and ``after`` ahead.

    ``columns`` receives the ordered window and returns the expressions.
    """
    block_rows = max(block_rows, before + after + 1)
    p = F.col(pos)
    targets = F.sequence(
        F.greatest(F.floor((p - after) / block_rows), F.lit(0)), F.floor((p + before) / block_rows)
    )
    spread = df.withColumn(BLOCK, F.explode(targets))
    window = Window.partitionBy(*keys, BLOCK).orderBy(pos)
    computed = spread.withColumns(columns(window))
    return computed.where(F.floor(p / block_rows) == F.col(BLOCK)).drop(BLOCK)


def prefix_by_block(summary: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Exclusive running totals over the blocks of each key."""
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__carry_{c}") for c in sums]
    return summary.select(*keys, BLOCK, *carried)


def running_sums(
    df: DataFrame, sums: list[str], keys: list[str], pos: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Inclusive running totals per key in ``pos`` order, as ``__run_<name>``."""
    blocked = df.withColumn(BLOCK, F.floor(F.col(pos) / block_rows))
    totals = blocked.groupBy(*keys, BLOCK).agg(*[F.sum(c).alias(c) for c in sums])
    carries = prefix_by_block(totals, keys, sums)
    window = Window.partitionBy(*keys, BLOCK).orderBy(pos)
    window = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = blocked.join(carries, [*keys, BLOCK])
    runs = {f"__run_{c}": F.sum(c).over(window) + F.col(f"__carry_{c}") for c in sums}
    return joined.withColumns(runs).drop(BLOCK, *[f"__carry_{c}" for c in sums])
