"""Time grid: binning, densification, gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from laneflow import schemas
from laneflow.functions.columns import ensure_utc, floor_time, interval_seconds
from laneflow.operators.ordering import BLOCK, BLOCK_ROWS, POS, with_position
from laneflow.session import materialise

# Rows of the gap filling per task, about.
TASK_ROWS = 2_000_000
MEASURES = ["speed", "travel_time_seconds", "reference_speed"]


def bin_readings(
    df: DataFrame, interval: str = "1h", time_col: str = "measurement_tstamp", key: str = "tmc_code",
    source_tz: str = "UTC",
) -> DataFrame:
    """Mean of the measures per ``(segment, time_bin)``; other columns keep their earliest value.

    Partial means are combined map-side, so a busy segment costs no extra shuffle.
    """
    schemas.require_columns(df, [time_col, key])
    slim = df.drop(*schemas.READING_EXTRAS)
    stamp = ensure_utc(time_col, source_tz)
    binned = slim.withColumn("time_bin", floor_time(stamp, interval))
    binned = binned.where(F.col("time_bin").isNotNull() & F.col(key).isNotNull())
    measures = schemas.present(binned, MEASURES)
    others = [c for c in binned.columns if c not in {*measures, time_col, key, "time_bin"}]
    # The earliest non-null value, ties by value: the same on every run.
    firsts = [
        F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(time_col), F.col(c)))).getField(c).alias(c) for c in others
    ]
    return binned.groupBy(key, "time_bin").agg(*[F.avg(c).alias(c) for c in measures], *firsts)


def hourly_stats(df: DataFrame, time_col: str = "measurement_tstamp", key: str = "tmc_code") -> DataFrame:
    """Mean, exact median, min, max and count of speed per segment and hour.

    The median's state holds one counter per distinct speed of the cell and is
    merged map-side.
    """
    return df.groupBy(key, F.date_trunc("hour", F.col(time_col)).alias("hour")).agg(
        F.avg("speed").alias("speed_mean"), F.percentile("speed", 0.5).alias("speed_median"),
        F.min("speed").alias("speed_min"), F.max("speed").alias("speed_max"), F.count("speed").alias("count"),
    )


def merge_partial_stats(partials: DataFrame, key: str = "tmc_code") -> DataFrame:
    """Combine already aggregated files: mean of means, mean of medians, min, max, total count."""
    return partials.groupBy(key, "hour").agg(
        F.avg("speed_mean").alias("speed_mean"), F.avg("speed_median").alias("speed_median"),
        F.min("speed_min").alias("speed_min"), F.max("speed_max").alias("speed_max"), F.sum("count").alias("count"),
    )


def time_spine(df: DataFrame, grid: str = "observed", interval: str = "1h", time_col: str = "time_bin") -> DataFrame:
    """Bins in order with their position: the observed ones, or every bin between the first and last."""
    if grid == "observed":
        return with_position(df.select(time_col).distinct(), time_col)
    if grid != "regular":
        raise ValueError("grid must be 'observed' or 'regular'")
    ends = df.agg(F.min(time_col).alias("a"), F.max(time_col).alias("b"))
    step = F.expr(f"INTERVAL {interval_seconds(interval)} SECOND")
    return ends.where("a IS NOT NULL").select(F.posexplode(F.sequence("a", "b", step)).alias(POS, time_col))


def densify_grid(
    df: DataFrame, key: str = "tmc_code", time_col: str = "time_bin", grid: str = "observed", interval: str = "1h",
    spine: DataFrame | None = None,
) -> DataFrame:
    """Every segment at every bin, missing cells NULL; adds the bin position as ``__pos``.

    Only the rows of ``df`` and one row per ``(segment, block)`` of positions travel; the empty
    cells up to a block's next row are written out where they meet.
    """
    spine = time_spine(df, grid, interval, time_col) if spine is None else spine
    spine = spine.select(time_col, F.col(POS).cast("bigint").alias(POS))
    bins = spine.agg(F.coalesce(F.max(POS) + 1, F.lit(0).cast("bigint"))).scalar()
    others = [c for c in df.columns if c not in (key, time_col, POS)]
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((bins - 1) / BLOCK_ROWS)))
    starts = df.select(key).distinct().where(bins > 0).select(key, blocks.alias(BLOCK))
    starts = starts.select(key, BLOCK, (F.col(BLOCK) * BLOCK_ROWS).alias(POS), F.lit(False).alias("__found"))
    found = df.drop(POS).where(F.col(key).isNotNull()).join(spine, time_col)
    found = found.select(key, F.floor(F.col(POS) / BLOCK_ROWS).alias(BLOCK), POS, F.lit(True).alias("__found"), *others)
    order = Window.partitionBy(key, BLOCK).orderBy(POS, "__found")
    rows = starts.unionByName(found, allowMissingColumns=True).withColumn("__next", F.lead(POS).over(order))
    last = F.coalesce("__next", F.least((F.col(BLOCK) + 1) * BLOCK_ROWS, bins)) - 1
    # The start of a block has a cell of its own only if no row lies there.
    rows = rows.withColumn("__last", F.when(F.col("__found"), F.greatest(last, F.col(POS))).otherwise(last)).where(F.col("__last") >= F.col(POS))
    cells = rows.select("*", F.explode(F.sequence(F.col(POS), F.col("__last"))).alias("__at"))
    here = F.col("__found") & (F.col("__at") == F.col(POS))
    cells = cells.select(key, F.col("__at").alias(POS), *[F.when(here, F.col(c)).alias(c) for c in others])
    return cells.join(spine, POS).select(key, time_col, POS, *others)


def interpolate_linear(
    df: DataFrame, columns: list[str], key: str = "tmc_code", pos: str = POS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Position-linear gap filling per segment; leading and trailing gaps take the nearest value.

    Windows run per ``(segment, block)``.  What lies beyond a block comes from two rows of its own: the
    last known value before it and the first after it.
    """
    blocked = df.where(F.col(key).isNotNull() & F.col(pos).isNotNull()).withColumn(BLOCK, F.floor(F.col(pos) / block_rows))
    group = [key, BLOCK]

    def known(c: str):
        return F.when(F.col(c).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(c).cast("double").alias("v")))

    valued = blocked.where(F.coalesce(*columns).isNotNull()) if len({df.schema[c].dataType for c in columns}) == 1 else blocked
    edges = valued.groupBy(*group).agg(
        *[F.min(known(c)).alias(f"__first_{c}") for c in columns],
        *[F.max(known(c)).alias(f"__last_{c}") for c in columns],
    )
    edges = blocked.select(*group).distinct().join(edges, group, "left")
    earlier = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(key).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carries = materialise(edges.select(
        *group,
        *[F.last(f"__last_{c}", ignorenulls=True).over(earlier).alias(f"__before_{c}") for c in columns],
        *[F.last(f"__first_{c}", ignorenulls=True).over(later).alias(f"__after_{c}") for c in columns],
    ), "carries")
    # Tasks of about as many rows whatever the size of the table.
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), carries.count() * block_rows // TASK_ROWS)
    sides = [
        carries.select(*group, F.lit(at).alias("__side"), *[F.col(f"{name}_{c}").alias(f"__k_{c}") for c in columns])
        for at, name in ((-1, "__before"), (1, "__after"))
    ]
    rows = blocked.withColumns({"__side": F.lit(0), **{f"__k_{c}": known(c) for c in columns}})
    rows = rows.unionByName(sides[0], allowMissingColumns=True).unionByName(sides[1], allowMissingColumns=True).repartition(parts, *group)
    so_far = (Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy(*group).orderBy("__side", pos).rowsBetween(*so_far)
    down = Window.partitionBy(*group).orderBy(F.desc("__side"), F.desc(pos)).rowsBetween(*so_far)
    sided = rows.withColumns({f"__l_{c}": F.last(f"__k_{c}", True).over(up) for c in columns})
    sided = sided.withColumns({f"__r_{c}": F.last(f"__k_{c}", True).over(down) for c in columns}).where("__side = 0")

    def filled(c: str):
        l, r = F.col(f"__l_{c}"), F.col(f"__r_{c}")
        line = l.v + (r.v - l.v) * (F.col(pos) - l.p) / (r.p - l.p)
        return (
            F.when(F.col(c).isNotNull(), F.col(c).cast("double")).when(l.isNull(), r.v).when(r.isNull(), l.v)
            .otherwise(line)
        )

    scratch = [f"__{side}_{c}" for c in columns for side in ("k", "l", "r")]
    return sided.withColumns({c: filled(c) for c in columns}).drop(BLOCK, "__side", *scratch)


def event_hour_rollup(df: DataFrame, counts: list[str], key: str = "tmc_code") -> DataFrame:
    """Feature-table event counts summed per segment and hour."""
    return df.groupBy(key, F.date_trunc("hour", "time_bin").alias("time_bin")).agg(*[F.sum(c).alias(c) for c in counts])
