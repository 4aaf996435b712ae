"""Lags, masks, sequences, splits and other ordered operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from laneflow import schemas
from laneflow.operators.ordering import BLOCK_ROWS, POS, blocked_window, running_sums, with_position

KEY, TIME = "tmc_code", "time_bin"


def _positioned(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df if POS in df.columns else with_position(df, order, keys)


def add_lags(
    df: DataFrame, value: str = "travel_time_seconds", lags: tuple[int, ...] = (1, 2, 3), key: str = KEY,
    order: str = TIME, drop_missing: bool = True, prefix: str = "lag", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Row-based lags within a segment; rows that miss any lag are dropped."""
    names = {k: f"{prefix}{k}" for k in lags}
    lagged = blocked_window(
        _positioned(df, [key], order),
        lambda w: {names[k]: F.lag(value, k).over(w) for k in lags},
        before=max(lags), after=0, keys=[key], block_rows=block_rows,
    )
    return lagged.dropna(subset=list(names.values())) if drop_missing else lagged


def latest_per_key(df: DataFrame, key: str, order: str, tiebreak: list[str] | None = None) -> DataFrame:
    """The newest row per key, NULL dates oldest; equal dates fall to the highest tiebreak.

    One map-side combined aggregate, no sort: a hot key reduces to one row per
    partition before the shuffle.
    """
    ties = tiebreak or [c for c in df.columns if c not in (key, order)]
    rank = F.struct(F.col(order).isNotNull(), F.col(order), *ties)
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), rank).alias("row")).select("row.*")


def buffer_mask(
    df: DataFrame, flag: Column, reach: int, out: str, key: str = KEY, order: str = TIME,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """True on rows within ±``reach`` rows of a flagged row of the same segment."""
    marked = _positioned(df, [key], order).withColumn("__flag", F.coalesce(flag, F.lit(False)).cast("int"))
    return blocked_window(
        marked, lambda w: {out: F.max("__flag").over(w.rowsBetween(-reach, reach)) == 1},
        before=reach, after=reach, keys=[key], block_rows=block_rows,
    ).drop("__flag")


def sliding_sequences(
    df: DataFrame, features: list[str], target: str, length: int = 24, stride: int = 1, key: str = KEY,
    order: str = TIME, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Input rows ``[s, s+length)`` as a nested array with the label at ``s+length``.

    One output row per label; segments with at most ``length`` rows give none.
    """
    step = F.array(*[F.col(f).cast("double") for f in features])
    rows = _positioned(df, [key], order).withColumn("__step", step)
    built = blocked_window(
        rows, lambda w: {"x": F.collect_list("__step").over(w.rowsBetween(-length, -1))},
        before=length, after=0, keys=[key], block_rows=block_rows,
    )
    labels = built.where((F.col(POS) >= length) & ((F.col(POS) - length) % stride == 0))
    return labels.select(key, order, F.col("x"), F.col(target).alias("y"))


def chronological_split_per_key(
    df: DataFrame, fraction: float = 0.2, key: str = KEY, order: str = TIME, out: str = "split"
) -> DataFrame:
    """Last ``max(1, int(n * fraction))`` rows of each segment are ``test``, the rest ``train``."""
    placed = with_position(df.drop(POS), order, [key], total="__n")
    held = F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(fraction)))
    split = F.when(F.col(POS) >= F.col("__n") - held, "test").otherwise("train")
    return placed.withColumn(out, split).drop(POS, "__n")


def time_cutoff(df: DataFrame, ratio: float = 0.2, time_col: str = TIME) -> Column:
    """First test bin: bins from ``int(n * (1 - ratio))`` on, as a scalar over the distinct bins."""
    bins = with_position(df.select(time_col).distinct(), time_col)
    # The same product is truncated as on the driver, in double arithmetic.
    cut = F.floor((F.max(POS) + 1) * F.lit(1 - ratio))
    first_test = bins.agg(cut).scalar()
    return bins.where(F.col(POS) == first_test).agg(F.max(time_col)).scalar()


def chronological_split(df: DataFrame, ratio: float = 0.2, time_col: str = TIME, out: str = "split") -> DataFrame:
    cutoff = time_cutoff(df, ratio, time_col)
    after = F.coalesce(F.col(time_col) >= cutoff, F.lit(False))
    return df.withColumn(out, F.when(after, "test").otherwise("train"))


def best_per_group(df: DataFrame, group: list[str], metric: str, tiebreak: list[str] | None = None) -> DataFrame:
    """The row with the smallest metric per group (NULL metrics never win)."""
    rank = F.struct(F.col(metric), *(tiebreak or []))
    scored = df.where(F.col(metric).isNotNull())
    best = F.min_by(F.struct(*df.columns), rank).alias("row")
    return (scored.groupBy(*group).agg(best) if group else scored.agg(best)).select("row.*")


def chain_edges(df: DataFrame, group: str, pos: str, node: str, check: bool = True) -> DataFrame:
    """Edges from each node to the next one of its chain, with zero-based node ids."""
    if check:
        short = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where("n < 2").limit(1).collect()
        if short:
            raise ValueError(f"{group} {short[0][0]!r} has fewer than 2 nodes and forms no edge")
    ordered = with_chain_position(df, group, pos, node)
    edges = blocked_window(
        ordered, lambda w: {"dst": F.lead(node).over(w)}, before=0, after=1, keys=[group],
    )
    return edges.where(F.col("dst").isNotNull()).select(
        group, F.col(node).alias("src"), "dst", F.col(POS).alias("src_id"), (F.col(POS) + 1).alias("dst_id")
    )


def with_chain_position(df: DataFrame, group: str, pos: str, tiebreak: str, out: str = POS) -> DataFrame:
    """Zero-based place along the chain of a segment dimension (one row per segment)."""
    window = Window.partitionBy(group).orderBy(pos, tiebreak)
    return df.withColumn(out, (F.row_number().over(window) - 1).cast("bigint"))


def cumulative_length(df: DataFrame, group: str, pos: str = POS, miles: str = "miles") -> DataFrame:
    """Running miles along a chain; unknown lengths count 0.01."""
    filled = df.withColumn("__m", F.coalesce(F.col(miles), F.lit(0.01)))
    return running_sums(filled, ["__m"], [group], pos).withColumnRenamed("__run___m", "cumulative_miles").drop("__m")


def every_nth_frame(df: DataFrame, time_col: str = "hour", step: int = 1, cap: int | None = None) -> DataFrame:
    """Distinct times in order, each ``step``-th one, at most ``cap``."""
    frames = with_position(df.select(time_col).distinct(), time_col).where(F.col(POS) % step == 0)
    if cap is not None:
        frames = frames.where(F.col(POS) < cap * step)
    return frames.select(time_col)


def shift_circular(df: DataFrame, value: str, lags: list[int], order: str = TIME, out: str = "shifted") -> DataFrame:
    """Whole-table circular shifts: one row per (lag, row) carrying the value from ``lag`` rows earlier."""
    placed = with_position(df, order)
    total = df.agg(F.count(F.lit(1))).scalar()
    source = placed.select(F.col(POS).alias("__from"), F.col(value).alias(out))
    source = source.withColumn("lag", F.explode(F.array(*[F.lit(int(k)) for k in lags])))
    source = source.select("lag", F.pmod(F.col("__from") + F.col("lag"), total).alias(POS), out)
    return source.join(placed, POS).drop(POS)


def shift_plain(
    df: DataFrame, value: str, lags: list[int], key: str = KEY, order: str = TIME, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Per-segment shifts without wrap-around, one column ``shift_<lag>`` per lag (``m`` for minus)."""
    names = {k: f"shift_{'m' if k < 0 else ''}{abs(k)}" for k in lags}
    return blocked_window(
        _positioned(df, [key], order), lambda w: {n: F.lag(value, k).over(w) for k, n in names.items()},
        before=max(0, *lags), after=max(0, *[-k for k in lags]), keys=[key], block_rows=block_rows,
    )


def align_predictions(spine: DataFrame, predictions: DataFrame, key: str = KEY, order: str = TIME) -> DataFrame:
    """Predictions on the full timeline; steps without one are NULL."""
    return spine.select(key, order).join(predictions, [key, order], "left")


def add_seasonal_difference(
    df: DataFrame, value: str, period: int = 24, out: str | None = None, key: str = KEY, order: str = TIME,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    name = out or f"{value}_sdiff{period}"
    return blocked_window(
        _positioned(df, [key], order), lambda w: {name: F.col(value) - F.lag(value, period).over(w)},
        before=period, after=0, keys=[key], block_rows=block_rows,
    )


def tail_validation_split(
    df: DataFrame, fraction: float = 0.2, order: str = TIME, out: str = "part"
) -> DataFrame:
    """Last ``max(1, int(fraction * n))`` rows of the whole training table are ``validation``."""
    placed = with_position(df.drop(POS), order, tiebreak=schemas.present(df, [KEY]), total="__n")
    held = F.greatest(F.lit(1), F.floor(F.lit(fraction) * F.col("__n")))
    return placed.withColumn(out, F.when(F.col(POS) >= F.col("__n") - held, "validation").otherwise("train")).drop(POS, "__n")


def overlap_validation_split(
    df: DataFrame, length: int, fraction: float = 0.1, time_col: str = TIME
) -> tuple[DataFrame, DataFrame]:
    """Train bins before the cut, and validation bins that start ``length`` bins earlier (their warm-up)."""
    bins = with_position(df.select(time_col).distinct(), time_col)
    cut = bins.agg(F.floor((F.max(POS) + 1) * F.lit(1 - fraction))).scalar()
    placed = df.drop(POS).join(bins, time_col)
    return placed.where(F.col(POS) < cut).drop(POS), placed.where(F.col(POS) >= cut - length).drop(POS)
