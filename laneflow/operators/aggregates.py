"""Speed profiles, event counts, shares, durations and impact aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from laneflow.functions import columns as C
from laneflow.functions.fixed_values import MONTHS, SEASONS, SPEED_BANDS, WEEKDAYS
from laneflow.operators.filters import INCIDENT
from laneflow.operators.ranking import grouped_quantiles
from laneflow.schemas import as_column


def _named_spine(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"position int, {name} string")


# --- speed profiles -------------------------------------------------------


def with_calendar(hourly: DataFrame) -> DataFrame:
    """Hourly statistics plus calendar, rush and season columns."""
    dated = hourly.withColumns(C.calendar_features("hour"))
    return dated.withColumns({**C.rush_flags(), "season": C.season("month")})


def daily_trend(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("date").agg(F.avg("speed_mean").alias("speed_mean"))


def _spread_by(
    hourly: DataFrame, name: str, order: list[str], value: str = "speed_mean"
) -> DataFrame:
    stats = hourly.groupBy(name).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    medians = grouped_quantiles(hourly, [name], value, {"median": 0.5})
    spine = _named_spine(hourly.sparkSession, name, order)
    return spine.join(stats, name, "left").join(medians, name, "left").select("position", name, "mean", "median", "std")


def monthly_stats(hourly: DataFrame) -> DataFrame:
    """Mean, exact median and sample deviation per month, all twelve months in order."""
    return _spread_by(hourly, "month_name", MONTHS)


def seasonal_stats(hourly: DataFrame) -> DataFrame:
    return _spread_by(hourly, "season", SEASONS)


def _by_season(hourly: DataFrame, columns: dict[str, Column]) -> DataFrame:
    means = hourly.groupBy("season").agg(*[F.avg(F.when(c, F.col("speed_mean"))).alias(n) for n, c in columns.items()])
    return _named_spine(hourly.sparkSession, "season", SEASONS).join(means, "season", "left")


def rush_by_season(hourly: DataFrame) -> DataFrame:
    morning, evening = F.col("is_morning_rush"), F.col("is_evening_rush")
    return _by_season(hourly, {"morning_rush": morning, "evening_rush": evening, "non_rush": ~(morning | evening)})


def weekend_vs_weekday(hourly: DataFrame) -> DataFrame:
    split = _by_season(hourly, {"weekday": ~F.col("is_weekend"), "weekend": F.col("is_weekend")})
    diff = F.col("weekend") - F.col("weekday")
    return split.withColumns({"speed_diff": diff, "percent_diff": F.try_divide(diff, F.col("weekday")) * 100})


def group_speed_summary(hourly: DataFrame, by: str, min_count: int | None = None) -> DataFrame:
    """Mean, sample deviation and count by road or direction, fastest first."""
    stats = hourly.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.avg("speed_mean").alias("mean"), F.stddev_samp("speed_mean").alias("std"), F.count("speed_mean").alias("count")
    )
    kept = stats if min_count is None else stats.where(F.col("count") > min_count)
    return kept.orderBy(F.desc("mean"), by)


def peak_offpeak_drop(hourly: DataFrame) -> DataFrame:
    """Peak minus off-peak mean speed per segment (negative is a slowdown)."""
    peak = F.col("is_peak")
    drop = F.avg(F.when(peak, F.col("speed_mean"))) - F.avg(F.when(~peak, F.col("speed_mean")))
    keyed = hourly.where(F.col("tmc").isNotNull() & F.col("road").isNotNull() & F.col("direction").isNotNull())
    return keyed.groupBy("tmc", "road", "direction").agg(drop.alias("peak_speed_drop"))


def segment_day_average(hourly: DataFrame, date: str | None = None) -> DataFrame:
    """Mean speed per segment (of one date) with its attributes and strict speed band."""
    rows = hourly if date is None else hourly.where(F.col("date") == F.to_date(F.lit(date)))
    attributes = ["road", "direction", "start_latitude", "start_longitude", "end_latitude", "end_longitude"]
    picked = rows.where(F.col("tmc").isNotNull()).groupBy("tmc").agg(
        F.avg("speed_mean").alias("speed_mean"),
        *[F.min_by(F.col(a), F.when(F.col(a).isNotNull(), F.col("hour"))).alias(a) for a in attributes],
    )
    return picked.withColumn("speed_category", C.speed_band("speed_mean"))


def speed_category_distribution(day: DataFrame) -> DataFrame:
    """Segments per speed band, slowest band first."""
    counts = day.where(F.col("speed_category").isNotNull()).groupBy("speed_category").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.array_position(F.lit(SPEED_BANDS), F.col("speed_category")))


def week_profile_pivot(hourly: DataFrame) -> DataFrame:
    """Weekday × hour mean speed per ISO week, all seven days of each week, hours as columns."""
    hours = list(range(24))
    cells = hourly.groupBy("year_week", "day_of_week").pivot("hour_of_day", hours).agg(F.avg("speed_mean"))
    weeks = hourly.select("year_week").distinct()
    days = F.posexplode(F.array(*[F.lit(d) for d in WEEKDAYS])).alias("day_position", "day_of_week")
    full = weeks.select("year_week", days).join(cells, ["year_week", "day_of_week"], "left")
    return full.select("year_week", "day_position", "day_of_week", *[F.col(str(h)).alias(f"h{h:02d}") for h in hours])


def speed_range(hourly: DataFrame) -> DataFrame:
    return hourly.agg(F.min("speed_mean").alias("global_min"), F.max("speed_mean").alias("global_max"))


def profile_by_calendar(hourly: DataFrame, by: str) -> DataFrame:
    """Mean speed by hour of day, weekday or date."""
    means = hourly.groupBy(by).agg(F.avg("speed_mean").alias("speed_mean"))
    if by == "day_of_week":
        return means.orderBy(F.array_position(F.lit(WEEKDAYS), F.col(by)))
    return means.orderBy(by)


def box_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles, 1.5·IQR whisker ends (actual values), and outlier count per category."""
    rows = df.where(F.col(by).isNotNull())
    quartiles = grouped_quantiles(rows, [by], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fenced = rows.select(by, value).join(quartiles, by)
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return fenced.groupBy(by).agg(
        F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"), F.count(value).alias("n"),
    )


def window_min_max_dates(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("year_week").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))


def map_extent(segments: DataFrame) -> DataFrame:
    """Extent over both endpoints of all rows, centre, padded bounds and zoom level."""
    lat, lon = ("start_latitude", "end_latitude"), ("start_longitude", "end_longitude")
    edge = segments.agg(
        F.min(F.least(*lat)).alias("min_lat"), F.max(F.greatest(*lat)).alias("max_lat"),
        F.min(F.least(*lon)).alias("min_lon"), F.max(F.greatest(*lon)).alias("max_lon"),
    )
    height = F.greatest(F.col("max_lat") - F.col("min_lat"), F.lit(0.01))
    width = F.greatest(F.col("max_lon") - F.col("min_lon"), F.lit(0.01))
    zoom = F.least(F.log2(F.lit(360.0) / (height * 1.1)) - 1, F.log2(F.lit(360.0) / (width * 1.1 * 2.0)) - 1)
    return edge.select(
        "min_lat", "max_lat", "min_lon", "max_lon",
        ((F.col("min_lat") + F.col("max_lat")) / 2).alias("center_lat"),
        ((F.col("min_lon") + F.col("max_lon")) / 2).alias("center_lon"),
        (F.col("min_lat") - 0.01).alias("south"), (F.col("min_lon") - 0.01).alias("west"),
        (F.col("max_lat") + 0.01).alias("north"), (F.col("max_lon") + 0.01).alias("east"),
        F.greatest(F.lit(9), F.least(F.lit(15), F.bround(zoom, 0).cast("int"))).alias("zoom"),
    )


# --- event counts ---------------------------------------------------------


def daily_active_summary(daily: DataFrame, today: str | None = None) -> DataFrame:
    """Average, maximum and today's value of a daily count series."""
    day = F.current_date() if today is None else F.to_date(F.lit(today))
    count = F.col("event_count")
    return daily.agg(
        F.avg(count).alias("average_active"), F.max(count).alias("maximum_active"),
        F.max(F.when(F.col("date") == day, count)).alias("current_active"),
    )


def incidents(events: DataFrame, hours: int = -7) -> DataFrame:
    """Incidents with a valid start, with their fixed-offset local start time."""
    local = events.where(F.col("EventType") == INCIDENT).withColumn("start_local", C.to_local_time("StartDate", hours))
    return local.where(F.col("start_local").isNotNull())


def hour_of_day_counts(local: DataFrame) -> DataFrame:
    """Incidents per local hour, all 24 hours, with a 12-hour label."""
    counts = local.groupBy(F.hour("start_local").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    spine = local.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    full = spine.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("label", C.hour_label_12h("hour"))


def day_of_week_counts(local: DataFrame) -> DataFrame:
    """Incidents per weekday, all seven days in order."""
    counts = local.groupBy(F.date_format("start_local", "EEEE").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    spine = _named_spine(local.sparkSession, "day", WEEKDAYS)
    return spine.join(counts, "day", "left").select("position", "day", F.coalesce("n", F.lit(0)).alias("n"))


def weekly_pattern(days: DataFrame) -> DataFrame:
    """Weekday / weekend totals, shares, averages per day, peak day and ratio."""
    n, at = F.col("n"), F.col("position")
    totals = days.agg(
        F.sum(n).alias("total"), F.sum(F.when(at < 5, n).otherwise(0)).alias("weekday_total"),
        F.sum(F.when(at >= 5, n).otherwise(0)).alias("weekend_total"),
        F.max_by("day", F.struct(n, -at)).alias("peak_day"), F.max(n).alias("peak_count"),
    )
    total, weekday, weekend = F.col("total"), F.col("weekday_total"), F.col("weekend_total")
    return totals.select(
        "total", "weekday_total", "weekend_total", (F.try_divide(weekday, total) * 100).alias("weekday_percent"),
        (F.try_divide(weekend, total) * 100).alias("weekend_percent"),
        (weekday / 5).alias("avg_weekday"), (weekend / 2).alias("avg_weekend"),
        F.when(F.col("peak_count") > 0, F.col("peak_day")).alias("peak_day"), "peak_count",
        F.try_divide(weekday, weekend).alias("weekday_weekend_ratio"),
    )


def period_shares(hours: DataFrame) -> DataFrame:
    """Rush totals, and day (6–17) versus night counts and percentages, from hourly counts."""

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    h = F.col("hour")
    sums = hours.agg(
        F.sum("n").alias("total"), total(h.between(7, 9)).alias("morning_rush"), total(h.between(16, 18)).alias("evening_rush"),
        total(h.between(6, 17)).alias("day_count"), total(~h.between(6, 17)).alias("night_count"),
    )
    return sums.withColumns({
        "day_percent": F.try_divide(F.col("day_count"), F.col("total")) * 100,
        "night_percent": F.try_divide(F.col("night_count"), F.col("total")) * 100,
    })


def top_roadways(events: DataFrame, n: int = 15) -> DataFrame:
    """Roads with most incidents, with their rank."""
    road = F.col("RoadwayName")
    rows = events.where((F.col("EventType") == INCIDENT) & F.col("StartDate").isNotNull() & road.isNotNull() & (road != ""))
    counts = rows.groupBy("RoadwayName").agg(F.count(F.lit(1)).alias("accident_count"))
    return counts.orderBy(F.desc("accident_count"), "RoadwayName").limit(n)


def top_share(top: DataFrame, head: int = 5) -> DataFrame:
    """Total and share of the first ``head`` roads within a (short) top list."""
    first = top.orderBy(F.desc("accident_count"), "RoadwayName").limit(head).agg(F.sum("accident_count")).scalar()
    total = F.sum("accident_count")
    return top.agg(first.alias("head_total"), total.alias("shown_total"), (first / total * 100).alias("head_percent"))


def severity_breakdown(events: DataFrame) -> DataFrame:
    """Incidents per severity, empty or NULL as Unknown, with the share of the total."""
    level = F.when(F.col("Severity").isNull() | (F.col("Severity") == ""), "Unknown").otherwise(F.col("Severity"))
    rows = events.where((F.col("EventType") == INCIDENT) & F.col("StartDate").isNotNull())
    counts = rows.groupBy(level.alias("severity_level")).agg(F.count(F.lit(1)).alias("accident_count"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("percent", F.col("accident_count") / total * 100).orderBy(F.desc("accident_count"))


def value_counts(df: DataFrame, by: str) -> DataFrame:
    counts = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), by)


def table_summary(events: DataFrame) -> DataFrame:
    """Row count, earliest plausible start and latest plausible end as dates (epoch-second input)."""
    start, end = C.epoch_to_timestamp(F.col("StartDate")), C.epoch_to_timestamp(F.col("PlannedEndDate"))
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.to_date(F.min(F.when(start > F.lit("2000-01-01").cast("timestamp"), start))).alias("earliest"),
        F.to_date(F.max(F.when(end < F.lit("2200-01-01").cast("timestamp"), end))).alias("latest"),
    )


def flow_summary(flow: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows of both flow tables and the time range, in one row."""
    total = segments.agg(F.count(F.lit(1))).scalar()
    return flow.agg(
        F.count(F.lit(1)).alias("total_flow"), total.alias("total_segments"),
        F.min(C.epoch_to_timestamp(F.col("timestamp"))).alias("earliest"),
        F.max(C.epoch_to_timestamp(F.col("timestamp"))).alias("latest"),
    )


def road_class_distribution(segments: DataFrame) -> DataFrame:
    return segments.groupBy("frc").agg(F.count(F.lit(1)).alias("count")).orderBy("frc")


def first_last_event(local: DataFrame) -> DataFrame:
    return local.agg(
        F.to_date(F.min("start_local")).alias("first_date"), F.to_date(F.max("start_local")).alias("last_date"),
        F.count(F.lit(1)).alias("total"),
    )


# --- durations ------------------------------------------------------------


def mean_duration(events: DataFrame) -> DataFrame:
    return events.withColumn("d", C.event_minutes()).groupBy("EventType").agg(F.avg("d").alias("avg_minutes"))


def histogram(df: DataFrame, value: Column, by: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Equal-width counts per group; the last bin is closed.  Open limits come from each group's own range."""
    rows = df.select(F.col(by), value.alias("v")).where(F.col("v").isNotNull())
    if low is None or high is None:
        ranges = rows.groupBy(by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        rows = rows.join(ranges, by)
    else:
        rows = rows.withColumns({"lo": F.lit(float(low)), "hi": F.lit(float(high))})
        rows = rows.where(F.col("v").between(F.col("lo"), F.col("hi")))
    # A constant group spans half a unit on either side.
    flat = F.col("lo") == F.col("hi")
    lo = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo"))
    slot = F.least(F.floor((F.col("v") - lo) / width * bins), F.lit(bins - 1))
    return rows.groupBy(by, slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def capped_durations(df: DataFrame, start: str, end: str, by: str, cap: float = 90.0, limit_year: int = 2263) -> DataFrame:
    """Durations in days capped at ``cap`` with a flag for those beyond, sane end years only."""
    sane = df.where(F.year(end) < limit_year)
    return sane.select(
        by, C.duration_days(start, end, cap).alias("duration_days"),
        (C.duration_days(start, end) > cap).alias("is_long"),
    )


def long_events(durations: DataFrame, by: str) -> DataFrame:
    return durations.groupBy(by).agg(F.count_if("is_long").alias("n_long"), F.count(F.lit(1)).alias("n"))


# --- event impact ---------------------------------------------------------


def flag_column(mode: str, column: str = "plnd_evt") -> Column:
    """``exactly_one`` (count = 1) or ``any`` (count > 0)."""
    if mode not in ("exactly_one", "any"):
        raise ValueError("flag_mode must be 'exactly_one' or 'any'")
    return F.col(column) == 1 if mode == "exactly_one" else F.col(column) > 0


def spatial_event_rate(impact: DataFrame, flag_mode: str = "exactly_one", key: str = "tmc_code") -> DataFrame:
    flag = F.coalesce(flag_column(flag_mode), F.lit(False)).cast("int")
    return impact.groupBy(key).agg(
        F.avg("diff").alias("mean_diff"), F.avg(flag).alias("event_rate"), F.sum(flag).alias("n_events")
    )


def temporal_event_rate(impact: DataFrame, flag_mode: str = "exactly_one", time_col: str = "time_bin") -> DataFrame:
    flag = F.coalesce(flag_column(flag_mode), F.lit(False)).cast("int")
    return impact.groupBy(time_col).agg(F.avg("diff").alias("mean_diff"), F.avg(flag).alias("event_rate"))


def trimmed_mean(
    df: DataFrame, keys: list[str], value: str, low: float = 0.01, high: float = 0.99, out: str = "trimmed_mean",
) -> DataFrame:
    """Mean of the values between two exact quantiles of their group (both ends included)."""
    limits = grouped_quantiles(df, keys, value, {"__low": low, "__high": high})
    kept = df.select(*keys, value).join(limits, keys)
    kept = kept.where(F.col(value).between(F.col("__low"), F.col("__high")))
    return kept.groupBy(*keys).agg(F.avg(value).alias(out))


def extra_delay_profile(
    impact: DataFrame, by: list[str], value: str = "diff", planned: str = "plnd_evt"
) -> DataFrame:
    """Trimmed mean delay with and without planned events by hour (or weekday and hour), and the difference."""
    marked = impact.withColumn("__with", F.coalesce(F.col(planned) > 0, F.lit(False)))
    means = trimmed_mean(marked, [*by, "__with"], value, out="m")
    wide = means.groupBy(*by).agg(
        F.coalesce(F.max(F.when(~F.col("__with"), F.col("m"))), F.lit(0.0)).alias("no_event"),
        F.coalesce(F.max(F.when(F.col("__with"), F.col("m"))), F.lit(0.0)).alias("with_event"),
    )
    return wide.withColumn("extra_delay", F.col("with_event") - F.col("no_event"))


def mean_diff_by_hour(impact: DataFrame) -> DataFrame:
    return impact.groupBy("hour").agg(F.avg("diff").alias("mean_diff"))


def balance_report(train: DataFrame, no_event: Column, planned: Column) -> DataFrame:
    """Shares of planned rows in the balanced set and in train, and planned : no-event.

    ``no_event`` and ``planned`` tell which train rows are in either subset.
    """
    counts = train.agg(
        F.count_if(planned).alias("n_planned"), F.count_if(no_event).alias("n_no_event"), F.count(F.lit(1)).alias("n_train")
    )
    p, n, t = F.col("n_planned"), F.col("n_no_event"), F.col("n_train")
    one = F.lit(1)
    return counts.select(
        "n_planned", "n_no_event", "n_train", (p + n).alias("n_balanced"),
        (p * 100 / F.greatest(p + n, one)).alias("planned_in_balanced"),
        (p * 100 / F.greatest(t, one)).alias("planned_in_train"), (p * 100 / F.greatest(n, one)).alias("planned_to_none"),
    )
