"""Exact ranks and quantiles without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from laneflow.session import materialise

SPLITS = 256
# Rows of a group that one task may sort.
GROUP_ROWS = 100_000


def _slice(value: str) -> Column:
    """How many of the sorted ``__edges`` lie below the value, by bisection; there are fewer than 2 ** 16."""
    steps = F.array(*[F.lit(1 << i) for i in range(15, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("__edges", at + step - 1) < F.col(value), at + step).otherwise(at))


def _value_counts(df: DataFrame, value: str, keys: list[str], splits: int) -> DataFrame:
    """Distinct values with counts, cumulative counts and a balanced range slice per key.

    Slice edges are approximate quantiles (a mergeable sketch, combined map-side),
    so no slice holds more than about ``1/splits`` of a key's rows.  The hot key
    is therefore spread over many ``(key, slice)`` tasks; equal values share a
    slice and are already collapsed into one row with a count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__cnt"))
    probabilities = [i / splits for i in range(1, splits)]
    edges = df.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx(value, probabilities, splits * 20)).alias("__edges")
    )
    sliced = counts.join(edges, keys) if keys else counts.withColumn("__edges", edges.scalar())
    sliced = sliced.withColumn("__slice", _slice(value)).drop("__edges")
    sizes = sliced.groupBy(*keys, "__slice").agg(F.sum("__cnt").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__slice", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys, "__slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.join(offsets, [*keys, "__slice"])
        .withColumn("__upto", F.col("__offset") + F.sum("__cnt").over(inside))
        .drop("__slice", "__offset")
    )


def average_rank(df: DataFrame, value: str, out: str, splits: int = SPLITS) -> DataFrame:
    """Average rank (ties share their mean position) over the whole table."""
    ranked = _value_counts(df, value, [], splits)
    ranked = ranked.select(value, (F.col("__upto") - (F.col("__cnt") - 1) / 2.0).alias(out))
    return df.join(ranked, value, "left")


def _line(lo: Column, hi: Column, rank: Column) -> Column:
    return lo + (hi - lo) * (rank - F.floor(rank))


def distributed_quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], splits: int = SPLITS
) -> DataFrame:
    """Exact linear-interpolated quantiles per key by distributed selection.

    Slices of a key's values are counted map-side; only the values of the slices that hold a wanted
    rank travel, about ``1/splits`` of the rows for each.
    """
    rows = df.where(F.col(value).isNotNull())
    shares = [i / splits for i in range(1, splits)]
    edges = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, shares, splits * 20)).alias("__edges"))
    # Small tables, written so that Spark sees their size and needn't shuffle the rows to join them.
    edges = materialise(edges, "edges")
    sliced = rows.join(edges, keys) if keys else rows.withColumn("__edges", edges.select("__edges").scalar())
    sliced = sliced.select(*keys, value, _slice(value).alias("__slice"))
    sizes = sliced.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy(*keys)
    offset = F.coalesce(F.sum("__n").over(every.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"__offset": offset, "__total": F.sum("__n").over(every)})
    ranks = {n: (F.col("__total") - 1) * F.lit(float(p)) for n, p in probabilities.items()}
    targets = [side(rank) for rank in ranks.values() for side in (F.floor, F.ceil)]
    wanted = F.array_max(F.array(*[(F.col("__offset") <= t) & (t < F.col("__offset") + F.col("__n")) for t in targets]))
    wanted = materialise(sizes.where(wanted).drop("__n"), "slices")
    counts = sliced.join(wanted.select(*keys, "__slice"), [*keys, "__slice"], "left_semi")
    counts = counts.groupBy(*keys, "__slice", value).agg(F.count(F.lit(1)).alias("__cnt")).join(wanted, [*keys, "__slice"])
    upto = F.sum("__cnt").over(Window.partitionBy(*keys, "__slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("__upto", F.col("__offset") + upto)
    at = lambda t: F.max(F.when((F.col("__upto") - F.col("__cnt") <= t) & (t < F.col("__upto")), F.col(value)))
    picks = []
    for name, rank in ranks.items():
        picks += [at(F.floor(rank)).alias(f"{name}_lo"), at(F.ceil(rank)).alias(f"{name}_hi")]
    picked = placed.groupBy(*keys).agg(*picks, F.max("__total").alias("__total"))
    return picked.select(*keys, *[_line(F.col(f"{n}_lo"), F.col(f"{n}_hi"), r).alias(n) for n, r in ranks.items()])


def _sorted_quantiles(df: DataFrame, key: str, value: str, probabilities: dict[str, float]) -> DataFrame:
    """The same where each group is small enough for one task to sort."""
    group = Window.partitionBy(key)
    rows = df.withColumns({
        "__rn": F.row_number().over(group.orderBy(value)) - 1,
        "__total": F.count(F.lit(1)).over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    ranks = {n: (F.col("__total") - 1) * F.lit(float(p)) for n, p in probabilities.items()}
    picks = []
    for name, rank in ranks.items():
        picks += [F.max(F.when(F.col("__rn") == t, F.col(value))).alias(f"{name}_{s}") for s, t in (("lo", F.floor(rank)), ("hi", F.ceil(rank)))]
    picked = rows.groupBy(key).agg(*picks, F.max("__total").alias("__total"))
    return picked.select(key, *[_line(F.col(f"{n}_lo"), F.col(f"{n}_hi"), r).alias(n) for n, r in ranks.items()])


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per key, NULL keys included, whatever the size of a group.

    Groups that a task can sort are sorted; the values of larger ones are selected over many tasks.
    Keys and values are written once, since several passes read them, and so is the result.
    """
    if not keys:
        return distributed_quantiles(df, [], value, probabilities)
    # As fields of a struct, NULL keys are equal to each other in joins.
    packed = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("__key"), F.col(value).alias("__value"))
    packed = materialise(packed, "values")
    large = materialise(packed.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > GROUP_ROWS).select("__key"), "large")
    if large.isEmpty():
        parts = _sorted_quantiles(packed, "__key", "__value", probabilities)
    else:
        small = _sorted_quantiles(packed.join(large, "__key", "left_anti"), "__key", "__value", probabilities)
        parts = small.unionByName(distributed_quantiles(packed.join(large, "__key", "left_semi"), ["__key"], "__value", probabilities))
    return materialise(parts, "quantiles").select("__key.*", *probabilities)
