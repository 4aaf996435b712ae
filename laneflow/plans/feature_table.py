"""The hourly segment × time feature table, from raw events, segments and readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from laneflow.functions import columns as C
from laneflow.operators import filters, grid, intervals, joins, spatial, windows
from laneflow.operators.ordering import BLOCK, BLOCK_ROWS, POS, blocked_window
from laneflow.session import materialise

# Known readings per task of the sweep, at least.
TASK_READINGS = 200_000


def corridor_events(events: DataFrame, bbox=None, road_pattern: str | None = None) -> DataFrame:
    """Located, road-matched events with direction and two-level category."""
    kept = filters.filter_bbox(events, bbox) if bbox else events
    kept = filters.filter_road_pattern(kept, road_pattern) if road_pattern else kept
    return filters.map_category(filters.drop_optional_columns(filters.infer_direction(kept)))


def corridor_segments(segments: DataFrame, bbox=None, road: str | None = None) -> DataFrame:
    """Segments of the corridor, newest version each, with manual tags."""
    kept = filters.filter_segments_bbox(segments, bbox, road)
    return joins.add_manual_tags(windows.latest_per_key(kept, "tmc", "active_start_date"))


def dense_features(
    binned: DataFrame, windowed: DataFrame, segments: DataFrame, interval: str = "1h", grid_kind: str = "observed",
    lags: tuple[int, ...] = (1, 2, 3), block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Grid, event counts, gap filling and lags in one shuffle; with attributes, calendar and targets.

    ``binned`` must be cheap to read more than once (written, not recomputed).

    Only what changes along the grid travels: known readings, event steps (+1 where an
    event begins to overlap, -1 after it ends), the first position of each block with
    the segment's attributes, and the nearest readings outside the block.  They meet by
    ``(segment, block)``, a block being ``block_rows`` grid positions plus the few
    before it that lags look at.  Between two of these positions all cells lie on the
    same line between the same two readings and have the same event counts, so sorted
    windows run over the positions where something changes, and the cells themselves
    are written out afterwards, row by row, without a sort.  No block holds more
    than a few rows per position, whatever the number of events or readings of a
    segment.
    """
    measures = [c for c in grid.MEASURES if c in binned.columns]
    categories = [f"evt_{c}" for c in intervals.EVENT_CATEGORIES]
    reach = max(lags)
    spine = materialise(grid.time_spine(binned, grid_kind, interval), "spine")
    bins = spine.agg(F.count(F.lit(1))).first()[0]
    if bins == 0:
        raise ValueError("no readings to build a grid from")
    starts = _block_starts(binned, segments, bins, reach, block_rows)
    attributes = [c for c in starts.columns if c not in ("tmc_code", BLOCK, POS)]
    starts = starts.select("tmc_code", BLOCK, POS, F.struct(*attributes).alias("__static"))
    known = _known_rows(binned, spine, measures, bins, reach, block_rows)
    steps = _event_steps(windowed, spine, interval, bins, reach, block_rows)
    rows = starts.unionByName(known, allowMissingColumns=True).unionByName(steps, allowMissingColumns=True)

    group = ["tmc_code", BLOCK]
    # Tasks of about as many rows whatever the size of the table.
    parts = max(int(binned.sparkSession.conf.get("spark.sql.shuffle.partitions")), binned.count() // TASK_READINGS)
    changes = rows.repartition(parts, *group).groupBy(*group, POS).agg(
        F.max("__static").alias("__static"), *[F.max(f"__k_{c}").alias(f"__k_{c}") for c in measures],
        *[F.sum(f"__d_{c}").alias(f"__d_{c}") for c in categories],
    )
    down = Window.partitionBy(*group).orderBy(F.desc(POS)).rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(*group).orderBy(POS)
    up = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = changes.withColumns({f"__r_{c}": F.last(f"__k_{c}", True).over(down) for c in measures})
    swept = swept.withColumns({
        **{f"__l_{c}": F.last(f"__k_{c}", True).over(up) for c in measures},
        **{c: F.coalesce(F.sum(f"__d_{c}").over(up), F.lit(0)).cast("int") for c in categories},
        "__static": F.last("__static", True).over(up), "__next": F.lead(POS).over(order),
    })

    def at(pos: Column, left: Column, right: Column) -> Column:
        line = left.v + (right.v - left.v) * (pos - left.p) / (right.p - left.p)
        return F.when(left.isNull(), right.v).when(right.isNull() | (left.p == pos), left.v).otherwise(line)

    # Travel time just before the stretch: on the nearest earlier stretch that begins there or before.
    lagged = "travel_time_seconds"
    stretch = F.struct(F.col(POS).alias("p"), F.col(f"__l_{lagged}").alias("l"), F.col(f"__r_{lagged}").alias("r"))
    swept = swept.withColumns({f"__s{m}": F.lag(stretch, m).over(order) for m in range(1, reach + 1)})
    low = F.greatest(F.col(BLOCK) * block_rows - reach, _long(0))
    high = F.least((F.col(BLOCK) + 1) * block_rows, _long(bins))

    def before(k: int) -> Column:
        pos, value = F.col(POS) - k, None
        for m in range(1, k + 1):
            s = F.col(f"__s{m}")
            hit = (s.p <= pos) & (s.p >= low)
            value = F.when(hit, at(pos, s.l, s.r)) if value is None else value.when(hit, at(pos, s.l, s.r))
        return value

    swept = swept.withColumns({f"__b{k}": before(k) for k in range(1, reach + 1)}).drop(*[f"__s{m}" for m in range(1, reach + 1)])
    swept = swept.where((F.col(POS) >= low) & (F.col(POS) < high)).withColumn("__next", F.least(F.col("__next"), high))
    own = F.greatest(F.col(POS), F.col(BLOCK) * block_rows)
    # Every cell of a stretch lies on one line, worked out before the cells are.
    lines = {}
    for c in measures:
        l, r = F.col(f"__l_{c}"), F.col(f"__r_{c}")
        lines |= {f"__v_{c}": F.coalesce(l.v, r.v), f"__p_{c}": l.p, f"__rise_{c}": r.v - l.v, f"__run_{c}": r.p - l.p}
    kept = [POS, *[f"__b{k}" for k in range(1, reach + 1)], *categories, "__static"]
    stretches = swept.where(F.col("__next") > own).select("tmc_code", *kept, own.alias("__own"), "__next", *[e.alias(n) for n, e in lines.items()])
    cells = stretches.withColumn("__at", F.explode(F.sequence("__own", F.col("__next") - 1)))
    pos = F.col("__at")

    def on_line(c: str, pos: Column) -> Column:
        v, p, rise = F.col(f"__v_{c}"), F.col(f"__p_{c}"), F.col(f"__rise_{c}")
        return F.when(rise.isNull() | (p == pos), v).otherwise(v + rise * (pos - p) / F.col(f"__run_{c}"))

    def lag(k: int) -> Column:
        value = F.when(pos - k >= F.col(POS), on_line(lagged, pos - k))
        for j in range(1, k + 1):
            value = value.when(pos - k == F.col(POS) - j, F.col(f"__b{j}"))
        return value

    whole = cells.select(
        "tmc_code", pos.alias(POS), *[on_line(c, pos).alias(c) for c in measures], *categories,
        *[lag(k).alias(f"lag{k}") for k in lags], *[F.col("__static")[c].alias(c) for c in attributes],
    )
    # The calendar is worked out once per bin.
    calendar = C.cyclic_features("time_bin")
    days = spine.withColumn(POS, F.col(POS).cast("bigint")).withColumns(calendar)
    whole = whole.dropna(subset=[f"lag{k}" for k in lags]).join(days, POS)
    described = whole.select(
        "tmc_code", "time_bin", *measures, *categories, *[f"lag{k}" for k in lags], C.evt_total(categories).alias("evt_total"), *attributes, *calendar
    )
    return described.withColumns({**C.per_mile(lags), "speed_ratio": C.speed_ratio()})


def _block_starts(binned: DataFrame, segments: DataFrame, bins: int, reach: int, block_rows: int) -> DataFrame:
    """The first position of each block of each segment (``reach`` before it, where there are as many), with the segment's attributes."""
    blocks = joins.attach_segment_attributes(binned.select("tmc_code").distinct(), segments)
    blocks = blocks.select("*", _all_blocks(bins, block_rows).alias(BLOCK))
    return blocks.withColumn(POS, F.greatest(F.col(BLOCK) * block_rows - reach, _long(0)))


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _all_blocks(bins: int, block_rows: int) -> Column:
    return F.explode(F.sequence(_long(0), _long((bins - 1) // block_rows)))


def _known_rows(binned: DataFrame, spine: DataFrame, measures: list[str], bins: int, reach: int, block_rows: int) -> DataFrame:
    """Readings at their position, and the nearest readings outside each block."""
    placed = binned.join(spine, "time_bin")
    values = {
        f"__k_{c}": F.when(F.col(c).isNotNull(), F.struct(F.col(POS).alias("p"), F.col(c).cast("double").alias("v"))) for c in measures
    }
    placed = placed.select("tmc_code", POS, *[e.alias(n) for n, e in values.items()])
    p, last = F.col(POS), (bins - 1) // block_rows
    targets = F.sequence(F.floor(p / block_rows), F.least(F.floor((p + reach) / block_rows), F.lit(last)))
    own = placed.withColumn(BLOCK, F.explode(targets))
    if last == 0:
        return own
    # Last reading of each stretch that ends where a block's repeated rows begin, first reading of each block.
    ends = placed.groupBy("tmc_code", F.floor((p + reach) / block_rows).alias("b")).agg(*[F.max(n).alias(n) for n in values])
    heads = placed.groupBy("tmc_code", F.floor(p / block_rows).alias("b")).agg(*[F.min(n).alias(n) for n in values])
    blocks = placed.select("tmc_code").distinct().select("tmc_code", _all_blocks(bins, block_rows).alias("b"))
    edge = []
    for summary, order, at in ((ends, F.col("b"), _long(-1)), (heads, F.desc("b"), _long(bins))):
        outside = Window.partitionBy("tmc_code").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        carried = blocks.join(summary, ["tmc_code", "b"], "left")
        edge.append(carried.select(
            "tmc_code", at.alias(POS), *[F.last(n, True).over(outside).alias(n) for n in values], F.col("b").alias(BLOCK)
        ))
    return own.unionByName(edge[0]).unionByName(edge[1])


def _event_steps(windowed: DataFrame, spine: DataFrame, interval: str, bins: int, reach: int, block_rows: int) -> DataFrame:
    """Step changes of the event counts at grid positions, summed per segment, block and position."""
    width = C.interval_seconds(interval)
    numbered = spine.select(POS, C.bin_number("time_bin", width).alias("bin"))
    # Position of the first grid bin at or after any bin number in the grid's range.
    gaps = blocked_window(numbered, lambda w: {"__prev": F.lag("bin").over(w)}, before=1, after=0, keys=[])
    first_at = gaps.select(F.explode(F.sequence(F.coalesce(F.col("__prev") + 1, F.col("bin")), F.col("bin"))).alias("bin"), POS)
    lowest = spine.agg(F.min(C.bin_number("time_bin", width))).first()[0]

    known = F.col("cat_event_type").isin(intervals.EVENT_CATEGORIES)
    spans = windowed.where(F.col("near_tmc").isNotNull() & F.col("event_start").isNotNull() & F.col("event_end").isNotNull())
    spans = spans.select(
        F.col("near_tmc").alias("tmc_code"), F.when(known, F.col("cat_event_type")).otherwise("cat_unplanned").alias("c"),
        C.bin_number("event_start", width).alias("f"),
        (C.bin_number(F.timestamp_micros(F.unix_micros("event_end") - 1), width) + 1).alias("t"),
    ).where(F.col("f") < F.col("t"))
    spans = spans.groupBy("tmc_code", "c", "f", "t").agg(F.count(F.lit(1)).alias("n"))
    for side, out in (("f", "p0"), ("t", "p1")):
        at = first_at.select(F.col("bin").alias(f"__{side}"), F.col(POS).alias(out))
        spans = spans.join(at, F.greatest(F.col(side), F.lit(lowest)) == F.col(f"__{side}"), "left").drop(f"__{side}")
        spans = spans.withColumn(out, F.coalesce(out, F.lit(bins)))
    # Bins between the two may all be missing from the grid.
    spans = spans.where(F.col("p0") < F.col("p1"))
    touched = F.sequence(
        F.floor(F.col("p0") / block_rows), F.least(F.floor((F.col("p1") - 1 + reach) / block_rows), F.lit((bins - 1) // block_rows))
    )
    pieces = spans.withColumn(BLOCK, F.explode(touched))
    begin = F.greatest(F.col("p0"), F.col(BLOCK) * block_rows - reach)
    both = F.array(F.struct(begin.alias("p"), F.col("n").alias("d")), F.struct(F.col("p1").alias("p"), (-F.col("n")).alias("d")))
    steps = pieces.select("tmc_code", BLOCK, "c", F.explode(both).alias("s"))
    # Steps after the block's end never meet a cell.
    steps = steps.where(F.col("s.p") < (F.col(BLOCK) + 1) * block_rows)
    sums = [F.sum(F.when(F.col("c") == c, F.col("s.d"))).alias(f"__d_evt_{c}") for c in intervals.EVENT_CATEGORIES]
    return steps.groupBy("tmc_code", BLOCK, F.col("s.p").alias(POS)).agg(*sums)


def build_feature_table(
    events: DataFrame,
    segments: DataFrame,
    readings: DataFrame,
    start=None,
    end=None,
    interval: str = "1h",
    bbox=None,
    road: str | None = None,
    grid_kind: str = "observed",
    event_id: str = "ID",
) -> DataFrame:
    """End-to-end feature table.

    ``road`` is a regular expression for events and an exact name for segments.
    The binned readings, far smaller than the raw ones, are written once, since the
    grid, the known values and the time spine all come from them.
    """
    # The dimension is read by four steps; written, its true size lets Spark decide on broadcasts.
    placed = materialise(corridor_segments(segments, bbox, road), "segments")
    # Filtered events are read three times by the nearest join, the raw feed only once.
    near = materialise(corridor_events(events, bbox, road), "events")
    located = spatial.nearest_segment_join(near, placed, event_id)
    windowed = intervals.event_window_rules(located)
    kept = filters.filter_keys_timerange(readings, placed.select(F.col("tmc").alias("tmc_code")), start, end)
    binned = materialise(grid.bin_readings(kept, interval), "binned")
    return dense_features(binned, windowed, placed, interval, grid_kind)
