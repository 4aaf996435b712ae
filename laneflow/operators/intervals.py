"""Interval joins: event windows, overlap counts on a grid, active counts per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from laneflow.functions.columns import bin_number, ensure_utc, interval_seconds
from laneflow.functions.fixed_values import EVENT_CATEGORIES
from laneflow.operators.ordering import BLOCK, BLOCK_ROWS
from laneflow.schemas import as_column


def event_window_rules(df: DataFrame, start: str = "event_start", end: str = "event_end") -> DataFrame:
    """Type-dependent event window.

    Planned work runs from StartDate to PlannedEndDate, incidents from Reported to
    LastUpdated, a missing end equals the start, and other types (or a missing
    start) have no window and are dropped.
    """
    absent = F.lit(None).cast("timestamp")
    stamp = {
        c: ensure_utc(c) if c in df.columns else absent
        for c in ("StartDate", "PlannedEndDate", "Reported", "LastUpdated")
    }
    kind = F.lower(F.trim(F.col("EventType")))
    planned, incident = kind.isin("closures", "roadwork"), kind == "accidentsandincidents"
    begin = F.when(planned, stamp["StartDate"]).when(incident, stamp["Reported"])
    finish = F.when(planned, stamp["PlannedEndDate"]).when(incident, stamp["LastUpdated"])
    windowed = df.withColumns({start: begin, end: F.coalesce(finish, begin)})
    return windowed.where(F.col(start).isNotNull())


def interval_overlap_counts(
    grid: DataFrame,
    events: DataFrame,
    interval: str = "1h",
    grid_key: str = "tmc_code",
    event_key: str = "near_tmc",
    start: str = "event_start",
    end: str = "event_end",
    category: str = "cat_event_type",
    categories: list[str] = EVENT_CATEGORIES,
    fallback: str = "cat_unplanned",
    times: DataFrame | None = None,
) -> DataFrame:
    """Events overlapping each ``(segment, time_bin)`` cell: the grid plus one count per category.

    ``times`` may be any cheaper table with the grid's first and last ``time_bin``.

    Overlap is strict: bin start < event end and bin end > event start.  Every
    interval becomes two step changes, +1 at its first overlapped bin and -1 after
    its last; the counts are running totals along the grid.  Intervals are clamped to
    the grid's time range and cut at block borders, so that each ``(segment, block)``
    is summed on its own, and steps are summed per segment and bin before they meet
    the grid.  Cost is events + cells, whatever the event length.
    """
    width = interval_seconds(interval)
    number = bin_number("time_bin", width)
    ends = grid if times is None else times
    lowest, highest = ends.agg(F.min(number)).scalar(), ends.agg(F.max(number)).scalar()
    # Last bin that starts strictly before the end.
    last = bin_number(F.timestamp_micros(F.unix_micros(F.col(end)) - 1), width)
    group = F.when(F.col(category).isin(categories), F.col(category)).otherwise(fallback)
    spans = events.where(F.col(event_key).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
    spans = spans.select(F.col(event_key).alias(grid_key), bin_number(start, width).alias("f"), last.alias("l"), group.alias("c"))
    spans = spans.where(F.col("f") <= F.col("l")).withColumns({"f": F.greatest("f", lowest), "l": F.least("l", highest)})
    blocks = F.explode(F.sequence(F.floor(F.col("f") / BLOCK_ROWS), F.floor(F.col("l") / BLOCK_ROWS))).alias(BLOCK)
    pieces = spans.where(F.col("f") <= F.col("l")).select(grid_key, "c", "f", "l", blocks)
    begin = F.greatest(F.col("f"), F.col(BLOCK) * BLOCK_ROWS)
    both = F.array(F.struct(begin.alias("bin"), F.lit(1).alias("step")), F.struct((F.col("l") + 1).alias("bin"), F.lit(-1).alias("step")))
    steps = pieces.select(grid_key, BLOCK, "c", F.explode(both).alias("s"))
    # A step behind its block never meets a cell there.
    steps = steps.where(F.col("s.bin") < (F.col(BLOCK) + 1) * BLOCK_ROWS)
    names = [f"evt_{c}" for c in categories]
    changes = steps.groupBy(grid_key, BLOCK, F.col("s.bin").alias("__bin")).agg(*[
        F.sum(F.when(F.col("c") == c, F.col("s.step")).otherwise(0)).alias(n) for c, n in zip(categories, names)
    ])
    cells = grid.withColumns({"__bin": number, "__cell": F.lit(1)}).withColumn(BLOCK, F.floor(F.col("__bin") / BLOCK_ROWS))
    both_kinds = cells.unionByName(changes.withColumn("__cell", F.lit(0)), allowMissingColumns=True)
    window = Window.partitionBy(grid_key, BLOCK).orderBy("__bin", "__cell").rowsBetween(Window.unboundedPreceding, 0)
    counted = both_kinds.withColumns({n: F.coalesce(F.sum(n).over(window), F.lit(0)).cast("int") for n in names})
    return counted.where("__cell = 1").select(*grid.columns, *names)


def date_spine(spark: SparkSession, start: str | Column, end: str | Column, out: str = "date") -> DataFrame:
    low = F.to_date(F.lit(start)) if isinstance(start, str) else start
    high = F.to_date(F.lit(end)) if isinstance(end, str) else end
    return spark.range(1).select(F.explode(F.sequence(low, high)).alias(out))


def epoch_spine(spark: SparkSession, start: int, end: int, step: int = 86_400) -> DataFrame:
    """Epoch steps from ``start`` until the first value at or past ``end``."""
    last = start if end <= start else start + -(-(end - start) // step) * step
    return spark.range(start, last + 1, step).select(F.col("id").alias("date"))


def daily_active_ids(
    df: DataFrame, start: str, end: str, id_col: str = "id", start_col: str | Column = "start_date",
    end_col: str | Column = "end_date",
) -> DataFrame:
    """Distinct ids active on each date of the closed range, dates without any kept at zero.

    Equal day ranges are collapsed first and clamped to the spine, so one row
    expands to at most the number of dates asked for; duplicates per date vanish
    in a second hash aggregation over ``(id, date)``, which also spreads a hot id.
    """
    spark = df.sparkSession
    low, high = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    ranges = df.select(
        F.col(id_col).alias("id"),
        F.greatest(F.to_date(as_column(start_col)), low).alias("a"),
        F.least(F.to_date(as_column(end_col)), high).alias("b"),
        F.to_date(as_column(start_col)).alias("s"), F.to_date(as_column(end_col)).alias("e"),
    )
    ranges = ranges.where(F.col("s").isNotNull() & F.col("e").isNotNull() & (F.col("a") <= F.col("b")))
    days = ranges.select("id", "a", "b").distinct().select("id", F.explode(F.sequence("a", "b")).alias("date"))
    counts = days.distinct().groupBy("date").agg(F.count("id").alias("event_count"))
    spine = date_spine(spark, start, end)
    return spine.join(counts, "date", "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)))


def epoch_active_ids(
    df: DataFrame, start: int, end: int, id_col: str = "ID", start_col: str = "StartDate",
    end_col: str = "PlannedEndDate", step: int = 86_400,
) -> DataFrame:
    """As :func:`daily_active_ids` on epoch seconds sampled every ``step`` from ``start``."""
    spine = epoch_spine(df.sparkSession, start, end, step)
    steps = 0 if end <= start else -(-(end - start) // step)
    first = F.greatest(F.ceil((F.col(start_col) - start) / step), F.lit(0))
    last = F.least(F.floor((F.col(end_col) - start) / step), F.lit(steps))
    complete = df.where(F.col(start_col).isNotNull() & F.col(end_col).isNotNull())
    ranges = complete.select(F.col(id_col).alias("id"), first.alias("a"), last.alias("b"))
    ranges = ranges.where(F.col("a") <= F.col("b")).distinct()
    at = F.explode(F.sequence("a", "b")).alias("n")
    counts = (
        ranges.select("id", at).distinct().groupBy((F.col("n") * step + start).alias("date"))
        .agg(F.count("id").alias("event_count"))
    )
    return spine.join(counts, "date", "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)))
