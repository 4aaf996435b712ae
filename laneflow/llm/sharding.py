"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a pseudo-random draw u in (0, 1); the record goes to
the shard with the smallest -ln(u) / weight.  A shard's share is its weight's
share, and the draws of the other shards do not change when one is added or
removed: only the rows that the new shard wins (or the old one held) move.

The draw comes from the key and the shard's name alone, so the assignment is a
projection: no shuffle, no state, the same on every run and every executor.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from laneflow.llm.common import fresh, materialise

# Rows of one (shard, block) window, on average.
BLOCK_ROWS = 100_000
# Longest run of equal rows expanded from one row.
RUN = 10_000


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key.  Ties go to the smaller shard.

    A null key is a key like any other.  Weights must be positive.
    """
    if not weights or min(weights.values()) <= 0:
        raise ValueError("rendezvous hashing needs at least one shard, and positive weights")
    # 52 bits of the hash, moved off 0 and 1.  Adding the shard to the key's hash and hashing again
    # keeps the text or key from being read once per shard.
    own = F.xxhash64(key)
    costs = []
    for shard, weight in sorted(weights.items()):
        draw = (F.shiftrightunsigned(F.xxhash64(own, F.lit(int(shard))), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
        costs.append(F.struct((-F.log(draw) / F.lit(float(weight))).alias("cost"), F.lit(int(shard)).alias("shard")))
    best = costs[0] if len(costs) == 1 else F.least(*costs)
    return best["shard"].cast("int")


def assign_shards(df: DataFrame, key: str, weights: Mapping[int, float], name: str = "shard") -> DataFrame:
    """All columns of ``df`` and the shard of each row.

    Equal keys share a shard, null keys too.  An existing column ``name`` is
    replaced.  An empty table stays empty.
    """
    return df.withColumn(name, rendezvous(F.col(f"`{key}`"), weights))


def number_slots(df: DataFrame, shard: str = "shard", order: str | None = None, name: str = "slot", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    ``df`` should be narrow and of orderable columns: equal rows are counted
    before the shuffle and expanded after numbering, so that a row repeated very
    often is no hot key.  Distinct rows are spread over (shard, block) windows
    by their hash; a block's first slot is the running sum of the counts of the
    blocks before it.  Within a block rows stand in the order of ``order``, then
    of all columns.  An existing column ``name`` is replaced.
    """
    df = df.drop(name)
    columns = df.columns
    block, copies, before, first, run = fresh(df, "__block", "__copies", "__before", "__first", "__run")
    quoted = [F.col(f"`{c}`") for c in columns]
    counted = materialise(df.groupBy(*quoted).agg(F.count(F.lit(1)).alias(copies)), "slots")
    n_blocks = max(1, -(-counted.count() // block_rows))
    blocked = counted.withColumn(block, F.pmod(F.xxhash64(*quoted), F.lit(n_blocks)))
    key = [F.col(f"`{shard}`"), F.col(block)]

    sizes = blocked.groupBy(*key).agg(F.sum(copies).alias(before))
    running = Window.partitionBy(F.col(f"`{shard}`")).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn(before, F.coalesce(F.sum(before).over(running), F.lit(0))).select(
        F.col(f"`{shard}`").alias("__s"), F.col(block).alias("__b"), before
    )
    inner = Window.partitionBy(*key).orderBy(*([F.col(f"`{order}`")] if order else []), *quoted).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        blocked.withColumn(first, F.coalesce(F.sum(copies).over(inner), F.lit(0)))
        .join(starts, F.col(f"`{shard}`").eqNullSafe(F.col("__s")) & (F.col(block) == F.col("__b")))
        .withColumn(first, F.col(first) + F.col(before))
    )
    # Two steps, so that no array is longer than the root of what one row stands for.
    runs = placed.withColumn(run, F.explode(F.sequence(F.lit(0), F.floor((F.col(copies) - 1) / RUN))))
    last = F.least(F.col(copies) - 1, F.col(run) * RUN + RUN - 1)
    return runs.select(*quoted, F.explode(F.sequence(F.col(first) + F.col(run) * RUN, F.col(first) + last)).alias(name))
