"""Aggregations and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from laneflow.catalog.fixtures import Fixtures
from laneflow.catalog.registry import query
from laneflow.functions import columns as C
from laneflow.functions.fixed_values import METRO_CITIES, MONTHS, SEASONS, WEEKDAYS
from laneflow.operators import aggregates as A, grid, intervals, reshape, spatial


def _values(names: list[str]) -> str:
    return ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))


@query("a01_bin_readings", "SELECT * FROM binned", "binned", "speed travel_time_seconds reference_speed")
def a01(fx: Fixtures) -> DataFrame:
    return grid.bin_readings(fx.readings)


@query("a01_bin_readings_first", """
    SELECT tmc_code, time_bin, avg(speed) AS speed, arg_min(source, measurement_tstamp) AS source FROM (
        SELECT 'S' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS tmc_code, ts AS measurement_tstamp, time_bucket(INTERVAL 6 HOUR, ts) AS time_bin, value AS speed,
               event_type AS source FROM events) GROUP BY 1, 2""", "", "speed")
def a01_first(fx: Fixtures) -> DataFrame:
    """Six-hour bins; the text column keeps its earliest value."""
    rows = fx.events.select(
        F.concat(F.lit("S"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("tmc_code"), F.col("ts").alias("measurement_tstamp"),
        F.col("value").alias("speed"), F.col("event_type").alias("source"), F.lit(1).alias("cvalue"),
    )
    return grid.bin_readings(rows, "6h")


@query("a02_hourly_stats", "SELECT * FROM hourly", "hourly", "speed_mean speed_median speed_min speed_max")
def a02(fx: Fixtures) -> DataFrame:
    return grid.hourly_stats(fx.readings)


@query("a03_merge_partial_stats", """
    SELECT tmc_code, hour, avg(speed_mean) AS speed_mean, avg(speed_median) AS speed_median, min(speed_min) AS speed_min,
           max(speed_max) AS speed_max, CAST(sum(count) AS BIGINT) AS count
    FROM (SELECT event_id % 3 AS chunk, 'S' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS tmc_code, date_trunc('hour', ts) AS hour, avg(value) AS speed_mean,
                 quantile_cont(value, 0.5) AS speed_median, min(value) AS speed_min, max(value) AS speed_max, count(value) AS count
          FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2""", "", "speed_mean speed_median speed_min speed_max")
def a03(fx: Fixtures) -> DataFrame:
    """Three interleaved files aggregated apart, then merged."""
    parts = None
    chunked = fx.events.select(
        (F.col("event_id") % 3).alias("chunk"), F.concat(F.lit("S"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("tmc_code"),
        F.col("ts").alias("measurement_tstamp"), F.col("value").alias("speed"),
    )
    for chunk in range(3):
        part = grid.hourly_stats(chunked.where(F.col("chunk") == chunk))
        parts = part if parts is None else reshape.union_all(parts, part)
    return grid.merge_partial_stats(parts)


@query("a04_daily_trend", "SELECT date, avg(speed_mean) AS speed_mean FROM hourly_calendar GROUP BY 1", "hourly_calendar", "speed_mean")
def a04(fx: Fixtures) -> DataFrame:
    return A.daily_trend(fx.hourly_calendar)


SPREAD = """
    SELECT CAST(n.position AS INTEGER) AS position, n.{name}, h.mean, h.median, h.std FROM (VALUES {values}) AS n(position, {name})
    LEFT JOIN (SELECT {name}, avg(speed_mean) AS mean, quantile_cont(speed_mean, 0.5) AS median, stddev_samp(speed_mean) AS std
               FROM hourly_calendar GROUP BY 1) h ON h.{name} = n.{name}"""


@query("a05_monthly_stats", SPREAD.format(name="month_name", values=_values(MONTHS)), "hourly_calendar", "mean median std")
def a05(fx: Fixtures) -> DataFrame:
    return A.monthly_stats(fx.hourly_calendar)


@query("a06_seasonal_stats", SPREAD.format(name="season", values=_values(SEASONS)), "hourly_calendar", "mean median std")
def a06(fx: Fixtures) -> DataFrame:
    return A.seasonal_stats(fx.hourly_calendar)


@query("a07_rush_by_season", f"""
    SELECT CAST(n.position AS INTEGER) AS position, n.season, h.morning_rush, h.evening_rush, h.non_rush FROM (VALUES {_values(SEASONS)}) AS n(position, season)
    LEFT JOIN (SELECT season, avg(speed_mean) FILTER (WHERE is_morning_rush) AS morning_rush, avg(speed_mean) FILTER (WHERE is_evening_rush) AS evening_rush,
               avg(speed_mean) FILTER (WHERE NOT is_peak) AS non_rush FROM hourly_calendar GROUP BY 1) h ON h.season = n.season""",
    "hourly_calendar", "morning_rush evening_rush non_rush")
def a07(fx: Fixtures) -> DataFrame:
    return A.rush_by_season(fx.hourly_calendar)


@query("a08_weekend_vs_weekday", f"""
    SELECT CAST(n.position AS INTEGER) AS position, n.season, weekday, weekend, weekend - weekday AS speed_diff, (weekend - weekday) / weekday * 100 AS percent_diff
    FROM (VALUES {_values(SEASONS)}) AS n(position, season)
    LEFT JOIN (SELECT season, avg(speed_mean) FILTER (WHERE NOT is_weekend) AS weekday, avg(speed_mean) FILTER (WHERE is_weekend) AS weekend
               FROM hourly_calendar GROUP BY 1) h ON h.season = n.season""", "hourly_calendar", "weekday weekend speed_diff percent_diff")
def a08(fx: Fixtures) -> DataFrame:
    return A.weekend_vs_weekday(fx.hourly_calendar)


@query("a09_group_speed_summary", """
    SELECT road, avg(speed_mean) AS mean, stddev_samp(speed_mean) AS std, count(speed_mean) AS count FROM hourly_calendar
    WHERE road IS NOT NULL GROUP BY 1 HAVING count(speed_mean) > 1000""", "hourly_calendar", "mean std")
def a09(fx: Fixtures) -> DataFrame:
    return A.group_speed_summary(fx.hourly_calendar, "road", 1000)


@query("a09_direction_summary", """
    SELECT direction, avg(speed_mean) AS mean, stddev_samp(speed_mean) AS std, count(speed_mean) AS count FROM hourly_calendar
    WHERE direction IS NOT NULL GROUP BY 1""", "hourly_calendar", "mean std")
def a09_direction(fx: Fixtures) -> DataFrame:
    return A.group_speed_summary(fx.hourly_calendar, "direction")


DROPS = """
    SELECT tmc, road, direction, avg(speed_mean) FILTER (WHERE is_peak) - avg(speed_mean) FILTER (WHERE NOT is_peak) AS peak_speed_drop
    FROM hourly_calendar WHERE tmc IS NOT NULL GROUP BY 1, 2, 3"""


@query("a10_peak_offpeak_drop", DROPS, "hourly_calendar", "peak_speed_drop")
def a10(fx: Fixtures) -> DataFrame:
    return A.peak_offpeak_drop(fx.hourly_calendar)


DAY = """
    SELECT tmc, avg(speed_mean) AS speed_mean, any_value(road) AS road, any_value(direction) AS direction,
           any_value(start_latitude) AS start_latitude, any_value(start_longitude) AS start_longitude,
           any_value(end_latitude) AS end_latitude, any_value(end_longitude) AS end_longitude
    FROM hourly_calendar WHERE date = DATE '2024-01-09' GROUP BY 1"""
STRICT_BAND = """
    CASE WHEN speed_mean <= 0 OR speed_mean > 100 THEN NULL WHEN speed_mean <= 20 THEN '0-20' WHEN speed_mean <= 30 THEN '20-30'
         WHEN speed_mean <= 40 THEN '30-40' WHEN speed_mean <= 50 THEN '40-50' WHEN speed_mean <= 60 THEN '50-60' ELSE '60+' END"""


@query("a11_segment_day_average", f"SELECT *, {STRICT_BAND} AS speed_category FROM ({DAY})", "hourly_calendar",
       "speed_mean start_latitude start_longitude end_latitude end_longitude")
def a11(fx: Fixtures) -> DataFrame:
    return A.segment_day_average(fx.hourly_calendar, "2024-01-09")


DAILY = """
    SELECT CAST(d.date AS DATE) AS date, count(DISTINCT i.id) AS event_count
    FROM (SELECT unnest(generate_series(DATE '1997-03-01', DATE '1997-04-30', INTERVAL 1 DAY)) AS date) d
    LEFT JOIN day_intervals i ON d.date >= i.start_date AND d.date <= i.end_date GROUP BY 1"""


@query("a12_daily_active_counts", f"""
    SELECT avg(event_count) AS average_active, max(event_count) AS maximum_active, max(event_count) FILTER (WHERE date = DATE '1997-04-15') AS current_active
    FROM ({DAILY})""", "day_intervals", "average_active")
def a12(fx: Fixtures) -> DataFrame:
    return A.daily_active_summary(intervals.daily_active_ids(fx.day_intervals, "1997-03-01", "1997-04-30"), "1997-04-15")


LOCAL = """
    (SELECT *, make_timestamp((StartDate - 25200) * 1000000) AS start_local FROM road_events
     WHERE EventType = 'accidentsAndIncidents' AND StartDate IS NOT NULL)"""
HOURS = f"""
    SELECT CAST(h.hour AS INTEGER) AS hour, coalesce(c.n, 0) AS n FROM (SELECT unnest(range(24)) AS hour) h
    LEFT JOIN (SELECT hour(start_local) AS hour, count(*) AS n FROM {LOCAL} GROUP BY 1) c ON c.hour = h.hour"""
DAYS = f"""
    SELECT CAST(d.position AS INTEGER) AS position, d.day, coalesce(c.n, 0) AS n FROM (VALUES {_values(WEEKDAYS)}) AS d(position, day)
    LEFT JOIN (SELECT dayname(start_local) AS day, count(*) AS n FROM {LOCAL} GROUP BY 1) c ON c.day = d.day"""


@query("a13_hour_of_day_counts", f"""
    SELECT *, CASE WHEN hour % 12 = 0 THEN '12' ELSE CAST(hour % 12 AS VARCHAR) END || CASE WHEN hour < 12 THEN ' AM' ELSE ' PM' END AS label FROM ({HOURS})""",
    "road_events")
def a13(fx: Fixtures) -> DataFrame:
    return A.hour_of_day_counts(A.incidents(fx.road_events))


@query("a14_day_of_week_counts", DAYS, "road_events")
def a14(fx: Fixtures) -> DataFrame:
    return A.day_of_week_counts(A.incidents(fx.road_events))


@query("a14_weekly_pattern", f"""
    SELECT CAST(total AS BIGINT) AS total, CAST(wd AS BIGINT) AS weekday_total, CAST(we AS BIGINT) AS weekend_total, wd / total * 100 AS weekday_percent,
           we / total * 100 AS weekend_percent, wd / 5 AS avg_weekday, we / 2 AS avg_weekend, peak_day, peak_count, wd / we AS weekday_weekend_ratio
    FROM (SELECT CAST(sum(n) AS DOUBLE) AS total, CAST(sum(n) FILTER (WHERE position < 5) AS DOUBLE) AS wd,
                 CAST(sum(n) FILTER (WHERE position >= 5) AS DOUBLE) AS we, arg_max(day, (n, -position)) AS peak_day, max(n) AS peak_count FROM ({DAYS}))""",
    "road_events", "weekday_percent weekend_percent avg_weekday avg_weekend weekday_weekend_ratio")
def a14_pattern(fx: Fixtures) -> DataFrame:
    return A.weekly_pattern(A.day_of_week_counts(A.incidents(fx.road_events)))


@query("a15_period_shares", f"""
    SELECT *, day_count / CAST(total AS DOUBLE) * 100 AS day_percent, night_count / CAST(total AS DOUBLE) * 100 AS night_percent
    FROM (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (WHERE hour BETWEEN 7 AND 9) AS BIGINT) AS morning_rush,
                 CAST(sum(n) FILTER (WHERE hour BETWEEN 16 AND 18) AS BIGINT) AS evening_rush,
                 CAST(sum(n) FILTER (WHERE hour BETWEEN 6 AND 17) AS BIGINT) AS day_count,
                 CAST(sum(n) FILTER (WHERE hour NOT BETWEEN 6 AND 17) AS BIGINT) AS night_count FROM ({HOURS}))""",
    "road_events", "day_percent night_percent")
def a15(fx: Fixtures) -> DataFrame:
    return A.period_shares(A.hour_of_day_counts(A.incidents(fx.road_events)))


TOP_ROADS = """
    SELECT RoadwayName, count(*) AS accident_count FROM road_events WHERE EventType = 'accidentsAndIncidents' AND StartDate IS NOT NULL
      AND RoadwayName IS NOT NULL AND RoadwayName <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"""


@query("a16_top_roadways", TOP_ROADS, "road_events")
def a16(fx: Fixtures) -> DataFrame:
    return A.top_roadways(fx.road_events)


@query("a16_top_share", f"""
    SELECT CAST(sum(accident_count) FILTER (WHERE rn <= 5) AS BIGINT) AS head_total, CAST(sum(accident_count) AS BIGINT) AS shown_total,
           CAST(sum(accident_count) FILTER (WHERE rn <= 5) AS DOUBLE) / CAST(sum(accident_count) AS DOUBLE) * 100 AS head_percent
    FROM (SELECT *, row_number() OVER (ORDER BY accident_count DESC, RoadwayName) AS rn FROM ({TOP_ROADS}))""", "road_events", "head_percent")
def a16_share(fx: Fixtures) -> DataFrame:
    return A.top_share(A.top_roadways(fx.road_events))


@query("a17_severity_breakdown", """
    SELECT severity_level, accident_count, accident_count / CAST(sum(accident_count) OVER () AS DOUBLE) * 100 AS percent FROM (
        SELECT CASE WHEN Severity IS NULL OR Severity = '' THEN 'Unknown' ELSE Severity END AS severity_level, count(*) AS accident_count
        FROM road_events WHERE EventType = 'accidentsAndIncidents' AND StartDate IS NOT NULL GROUP BY 1)""", "road_events", "percent")
def a17(fx: Fixtures) -> DataFrame:
    return A.severity_breakdown(fx.road_events)


@query("a18_event_type_counts", "SELECT EventType, count(*) AS n FROM road_events GROUP BY 1", "road_events")
def a18(fx: Fixtures) -> DataFrame:
    return A.value_counts(fx.road_events, "EventType")


@query("a18_source_counts", "SELECT data_source_id, count(*) AS n FROM work_zones GROUP BY 1", "work_zones")
def a18_source(fx: Fixtures) -> DataFrame:
    return A.value_counts(fx.work_zones, "data_source_id")


@query("a18_city_counts", """
    SELECT nearest_city, count(*) AS n FROM (
        SELECT z.id, arg_min(c.name, (sqrt((latitude - c.la) * (latitude - c.la) + (longitude - c.lo) * (longitude - c.lo)), c.r)) AS nearest_city
        FROM work_zones z CROSS JOIN (VALUES """ + ", ".join(
            f"('{n}', {i}, CAST({la} AS DOUBLE), CAST({lo} AS DOUBLE))" for i, (n, (la, lo)) in enumerate(METRO_CITIES.items())
        ) + """) AS c(name, r, la, lo) GROUP BY 1) GROUP BY 1""", "work_zones")
def a18_city(fx: Fixtures) -> DataFrame:
    return A.value_counts(spatial.nearest_city(fx.work_zones, METRO_CITIES), "nearest_city")


@query("a19_table_summary", """
    SELECT count(*) AS total_events, CAST(min(make_timestamp(StartDate * 1000000)) FILTER (WHERE StartDate > 946684800) AS DATE) AS earliest,
           CAST(max(make_timestamp(PlannedEndDate * 1000000)) FILTER (WHERE PlannedEndDate < 7258118400) AS DATE) AS latest FROM road_events""", "road_events")
def a19(fx: Fixtures) -> DataFrame:
    return A.table_summary(fx.road_events)


@query("a19_flow_summary", """
    SELECT count(*) AS total_flow, (SELECT count(*) FROM flow_segments) AS total_segments,
           make_timestamp(min(timestamp) * 1000000) AS earliest, make_timestamp(max(timestamp) * 1000000) AS latest FROM flow""", "flow flow_segments")
def a19_flow(fx: Fixtures) -> DataFrame:
    return A.flow_summary(fx.flow, fx.flow_segments)


@query("a20_road_class_distribution", "SELECT frc, count(*) AS count FROM flow_segments GROUP BY 1", "flow_segments")
def a20(fx: Fixtures) -> DataFrame:
    return A.road_class_distribution(fx.flow_segments)


MINUTES = """
    CASE WHEN EventType IN ('closures', 'roadwork') THEN (PlannedEndDate - StartDate) / CAST(60 AS DOUBLE)
         WHEN EventType = 'accidentsAndIncidents' THEN (LastUpdated - Reported) / CAST(60 AS DOUBLE) END"""


@query("a21_mean_duration", f"SELECT EventType, avg({MINUTES}) AS avg_minutes FROM road_events GROUP BY 1", "road_events", "avg_minutes")
def a21(fx: Fixtures) -> DataFrame:
    return A.mean_duration(fx.road_events)


@query("a21_duration_histogram", f"""
    SELECT EventType, CAST(least(floor((v - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM (
        SELECT EventType, v, min(v) OVER (PARTITION BY EventType) AS lo, max(v) OVER (PARTITION BY EventType) AS hi
        FROM (SELECT EventType, {MINUTES} AS v FROM road_events WHERE PlannedEndDate < 9223372036 OR EventType = 'accidentsAndIncidents') WHERE v IS NOT NULL) GROUP BY 1, 2""",
    "road_events")
def a21_histogram(fx: Fixtures) -> DataFrame:
    sane = fx.road_events.where((F.col("PlannedEndDate") < 9_223_372_036) | (F.col("EventType") == "accidentsAndIncidents"))
    return A.histogram(sane, C.event_minutes(), "EventType", 20)


@query("a21_capped_histogram", """
    SELECT data_source_id, CAST(least(floor(d / 90 * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM (
        SELECT data_source_id, least(epoch(t1 - t0) / CAST(86400 AS DOUBLE), 90) AS d FROM (
            SELECT data_source_id, CAST(replace(substr(end_date, 1, 19), 'T', ' ') AS TIMESTAMP) AS t1,
                   try_cast(replace(substr(start_date, 1, 19), 'T', ' ') AS TIMESTAMP) AS t0 FROM work_zones) WHERE t0 IS NOT NULL) GROUP BY 1, 2""", "work_zones")
def a21_capped(fx: Fixtures) -> DataFrame:
    return A.histogram(_work_durations(fx), F.col("duration_days"), "data_source_id", 30, 0, 90)


def _work_durations(fx: Fixtures) -> DataFrame:
    dated = fx.work_zones.withColumns({"t0": C.iso_text_timestamp("start_date"), "t1": C.iso_text_timestamp("end_date")})
    return A.capped_durations(dated.where(F.col("t0").isNotNull()), "t0", "t1", "data_source_id")


@query("a21_long_events", """
    SELECT data_source_id, count(*) FILTER (WHERE t1 - t0 > INTERVAL 90 DAY) AS n_long, count(*) AS n FROM (
        SELECT data_source_id, CAST(replace(substr(end_date, 1, 19), 'T', ' ') AS TIMESTAMP) AS t1,
               try_cast(replace(substr(start_date, 1, 19), 'T', ' ') AS TIMESTAMP) AS t0 FROM work_zones) WHERE t0 IS NOT NULL GROUP BY 1""", "work_zones")
def a21_long(fx: Fixtures) -> DataFrame:
    return A.long_events(_work_durations(fx), "data_source_id")


SPATIAL = """
    SELECT tmc_code, avg(diff) AS mean_diff, avg(CAST(plnd_evt = 1 AS INTEGER)) AS event_rate, CAST(sum(CAST(plnd_evt = 1 AS INTEGER)) AS BIGINT) AS n_events
    FROM impact GROUP BY 1"""
TEMPORAL = "SELECT time_bin, avg(diff) AS mean_diff, avg(CAST(plnd_evt = 1 AS INTEGER)) AS event_rate FROM impact GROUP BY 1"


@query("a22_spatial_event_rate", SPATIAL, "impact", "mean_diff event_rate")
def a22(fx: Fixtures) -> DataFrame:
    return A.spatial_event_rate(fx.impact)


@query("a23_temporal_event_rate", TEMPORAL, "impact", "mean_diff event_rate")
def a23(fx: Fixtures) -> DataFrame:
    return A.temporal_event_rate(fx.impact)


def trimmed_sql(keys: str) -> str:
    return f"""
    SELECT {keys}, avg(diff) AS trimmed_mean FROM (
        SELECT *, quantile_cont(diff, 0.01) OVER (PARTITION BY {keys}) AS lo, quantile_cont(diff, 0.99) OVER (PARTITION BY {keys}) AS hi
        FROM (SELECT *, plnd_evt > 0 AS with_planned FROM impact)) WHERE diff BETWEEN lo AND hi GROUP BY {keys}"""


@query("a24_trimmed_mean", trimmed_sql("tmc_code"), "impact", "trimmed_mean")
def a24(fx: Fixtures) -> DataFrame:
    return A.trimmed_mean(fx.impact, ["tmc_code"], "diff")


@query("a24_trimmed_mean_distributed", trimmed_sql("event_type"), "impact", "trimmed_mean")
def a24_distributed(fx: Fixtures) -> DataFrame:
    """The same by distributed selection, as it runs when one group holds most rows."""
    return A.trimmed_mean(fx.impact, ["event_type"], "diff")


def profile_sql(keys: str) -> str:
    return f"""
    SELECT {keys}, coalesce(max(trimmed_mean) FILTER (WHERE NOT with_planned), 0) AS no_event, coalesce(max(trimmed_mean) FILTER (WHERE with_planned), 0) AS with_event,
           coalesce(max(trimmed_mean) FILTER (WHERE with_planned), 0) - coalesce(max(trimmed_mean) FILTER (WHERE NOT with_planned), 0) AS extra_delay
    FROM ({trimmed_sql(keys + ", with_planned")}) GROUP BY {keys}"""


@query("a25_extra_delay_profile", profile_sql("hour"), "impact", "no_event with_event extra_delay")
def a25(fx: Fixtures) -> DataFrame:
    return A.extra_delay_profile(fx.impact, ["hour"])


@query("a25_extra_delay_weekday_hour", profile_sql("dow, hour"), "impact", "no_event with_event extra_delay")
def a25_weekday(fx: Fixtures) -> DataFrame:
    return A.extra_delay_profile(fx.impact, ["dow", "hour"])


@query("a26_speed_category_distribution", f"""
    SELECT speed_category, count(*) AS n FROM (SELECT {STRICT_BAND} AS speed_category FROM ({DAY})) WHERE speed_category IS NOT NULL GROUP BY 1""",
    "hourly_calendar")
def a26(fx: Fixtures) -> DataFrame:
    return A.speed_category_distribution(A.segment_day_average(fx.hourly_calendar, "2024-01-09"))


HOUR_COLUMNS = [f"h{h:02d}" for h in range(24)]


@query("a27_week_profile_pivot", f"""
    SELECT w.year_week, CAST(d.position AS INTEGER) AS day_position, d.day AS day_of_week,
           {", ".join(f"avg(h.speed_mean) FILTER (WHERE h.hour_of_day = {i}) AS {c}" for i, c in enumerate(HOUR_COLUMNS))}
    FROM (SELECT DISTINCT year_week FROM hourly_calendar) w CROSS JOIN (VALUES {_values(WEEKDAYS)}) AS d(position, day)
    LEFT JOIN hourly_calendar h ON h.year_week = w.year_week AND h.day_of_week = d.day GROUP BY 1, 2, 3""",
    "hourly_calendar", " ".join(HOUR_COLUMNS))
def a27(fx: Fixtures) -> DataFrame:
    return A.week_profile_pivot(fx.hourly_calendar)


@query("a27_speed_range", "SELECT min(speed_mean) AS global_min, max(speed_mean) AS global_max FROM hourly", "hourly", "global_min global_max")
def a27_range(fx: Fixtures) -> DataFrame:
    return A.speed_range(fx.hourly)


# Every two-hour bin between the first and the last, with every segment.
MATRIX = """
    SELECT time_bin, tmc_code FROM (SELECT unnest(generate_series(min(t), max(t), INTERVAL 2 HOUR)) AS time_bin FROM (
        SELECT time_bucket(INTERVAL 2 HOUR, measurement_tstamp) AS t FROM readings)) CROSS JOIN (SELECT DISTINCT tmc_code FROM readings)"""


@query("a28_time_segment_matrix", f"""
    WITH cells AS ({MATRIX}), binned_2h AS (
        SELECT time_bucket(INTERVAL 2 HOUR, measurement_tstamp) AS time_bin, tmc_code, avg(speed) AS speed FROM readings GROUP BY 1, 2)
    SELECT c.time_bin, c.tmc_code, b.speed FROM cells c LEFT JOIN binned_2h b ON b.time_bin = c.time_bin AND b.tmc_code = c.tmc_code""", "readings", "speed")
def a28(fx: Fixtures) -> DataFrame:
    """The matrix of all segments, one row per cell."""
    wide = reshape.time_segment_matrix(fx.readings, fx.codes, interval="2h")
    return reshape.stack_wide_to_long(wide, "time_bin", fx.codes, "tmc_code", "speed", keep_null=True)


@query("a28_matrix_median_resampled", f"""
    WITH cells AS ({MATRIX}), binned_2h AS (
        SELECT time_bucket(INTERVAL 2 HOUR, measurement_tstamp) AS time_bin, tmc_code, quantile_cont(speed, 0.5) AS speed FROM readings GROUP BY 1, 2)
    SELECT time_bucket(INTERVAL 1 DAY, c.time_bin) AS time_bin, c.tmc_code, avg(b.speed) AS speed
    FROM cells c LEFT JOIN binned_2h b ON b.time_bin = c.time_bin AND b.tmc_code = c.tmc_code GROUP BY 1, 2""", "readings", "speed")
def a28_resampled(fx: Fixtures) -> DataFrame:
    wide = reshape.time_segment_matrix(fx.readings, fx.codes, interval="2h", agg="median")
    daily = reshape.resample_matrix(wide, fx.codes, "1d")
    return reshape.stack_wide_to_long(daily, "time_bin", fx.codes, "tmc_code", "speed", keep_null=True)


@query("a29_event_hour_rollup", """
    SELECT tmc_code, date_trunc('hour', time_bin) AS time_bin, CAST(sum(evt_cat_unplanned) AS BIGINT) AS evt_cat_unplanned,
           CAST(sum(evt_cat_planned) AS BIGINT) AS evt_cat_planned FROM features GROUP BY 1, 2""", "features")
def a29(fx: Fixtures) -> DataFrame:
    return grid.event_hour_rollup(fx.features, ["evt_cat_unplanned", "evt_cat_planned"])


BOX = """
    SELECT {by}, max(q1) AS q1, max(median) AS median, max(q3) AS q3,
           min({v}) FILTER (WHERE {v} BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_low,
           max({v}) FILTER (WHERE {v} BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_high,
           count(*) FILTER (WHERE {v} NOT BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS n_outliers, count({v}) AS n
    FROM (SELECT {by}, {v}, quantile_cont({v}, 0.25) OVER w AS q1, quantile_cont({v}, 0.5) OVER w AS median, quantile_cont({v}, 0.75) OVER w AS q3
          FROM {table} WINDOW w AS (PARTITION BY {by})) GROUP BY 1"""
BOX_NUMBERS = "q1 median q3 whisker_low whisker_high"


@query("a30_box_summary", BOX.format(by="month_name", v="speed_mean", table="hourly_calendar"), "hourly_calendar", BOX_NUMBERS)
def a30(fx: Fixtures) -> DataFrame:
    return A.box_summary(fx.hourly_calendar, "month_name", "speed_mean")


@query("a30_box_by_event_type", BOX.format(by="event_type", v="diff", table="impact"), "impact", BOX_NUMBERS)
def a30_events(fx: Fixtures) -> DataFrame:
    return A.box_summary(fx.impact, "event_type", "diff")


@query("a31_profile_by_calendar", """
    SELECT 'hour' AS kind, CAST(hour_of_day AS VARCHAR) AS bucket, avg(speed_mean) AS speed_mean FROM hourly_calendar GROUP BY hour_of_day
    UNION ALL SELECT 'weekday', day_of_week, avg(speed_mean) FROM hourly_calendar GROUP BY day_of_week
    UNION ALL SELECT 'date', CAST(date AS VARCHAR), avg(speed_mean) FROM hourly_calendar GROUP BY date""", "hourly_calendar", "speed_mean")
def a31(fx: Fixtures) -> DataFrame:
    parts = []
    for kind, by in (("hour", "hour_of_day"), ("weekday", "day_of_week"), ("date", "date")):
        profile = A.profile_by_calendar(fx.hourly_calendar, by)
        parts.append(profile.select(F.lit(kind).alias("kind"), F.col(by).cast("string").alias("bucket"), "speed_mean"))
    return reshape.union_all(*parts)


MASKED = """
    (SELECT *, max(CAST(evt_total > 0 AS INTEGER)) OVER w = 1 AS near_event, max(CAST(evt_cat_planned > 0 AS INTEGER)) OVER w = 1 AS near_planned
     FROM features WHERE time_bin < (SELECT time_bin FROM (SELECT time_bin, row_number() OVER (ORDER BY time_bin) - 1 AS pos, count(*) OVER () AS n
                                     FROM (SELECT DISTINCT time_bin FROM features)) WHERE pos = CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT))
     WINDOW w AS (PARTITION BY tmc_code ORDER BY time_bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"""
HASH = "CAST(('0x' || substr(md5(tmc_code || '|' || strftime(time_bin, '%Y-%m-%d %H:%M:%S') || '|{seed}'), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE)"


@query("a32_balance_report", f"""
    SELECT *, n_planned + n_no_event AS n_balanced, n_planned * 100.0 / (n_planned + n_no_event) AS planned_in_balanced,
           n_planned * 100.0 / n_train AS planned_in_train, n_planned * 100.0 / n_no_event AS planned_to_none
    FROM (SELECT count(*) FILTER (WHERE near_planned) AS n_planned, count(*) FILTER (WHERE NOT near_event AND {HASH.format(seed=2)} < CAST(0.05 AS DOUBLE)) AS n_no_event,
                 count(*) AS n_train FROM {MASKED})""", "features", "planned_in_balanced planned_in_train planned_to_none")
def a32(fx: Fixtures) -> DataFrame:
    from laneflow.operators.sampling import in_sample
    from laneflow.plans.impact import masked_train

    train = masked_train(fx.features)
    none = ~F.col("near_event") & in_sample(["tmc_code", "time_bin"], 0.05, 2)
    return A.balance_report(train, none, F.col("near_planned"))


@query("a33_mean_diff_by_hour", "SELECT hour, avg(diff) AS mean_diff FROM impact GROUP BY 1", "impact", "mean_diff")
def a33(fx: Fixtures) -> DataFrame:
    return A.mean_diff_by_hour(fx.impact)


@query("a34_map_extent", """
    SELECT *, CAST(greatest(9, least(15, round_even(least(
               log2(360 / (greatest(max_lat - min_lat, CAST(0.01 AS DOUBLE)) * CAST(1.1 AS DOUBLE))) - 1,
               log2(360 / (greatest(max_lon - min_lon, CAST(0.01 AS DOUBLE)) * CAST(1.1 AS DOUBLE) * 2)) - 1), 0))) AS INTEGER) AS zoom
    FROM (SELECT min(least(start_latitude, end_latitude)) AS min_lat, max(greatest(start_latitude, end_latitude)) AS max_lat,
                 min(least(start_longitude, end_longitude)) AS min_lon, max(greatest(start_longitude, end_longitude)) AS max_lon,
                 (min_lat + max_lat) / 2 AS center_lat, (min_lon + max_lon) / 2 AS center_lon, min_lat - 0.01 AS south, min_lon - 0.01 AS west,
                 max_lat + 0.01 AS north, max_lon + 0.01 AS east FROM segments)""",
    "segments", "min_lat max_lat min_lon max_lon center_lat center_lon south west north east")
def a34(fx: Fixtures) -> DataFrame:
    return A.map_extent(fx.segments)


@query("a35_window_min_max_dates", "SELECT year_week, min(date) AS start_date, max(date) AS end_date FROM hourly_calendar GROUP BY 1", "hourly_calendar")
def a35(fx: Fixtures) -> DataFrame:
    return A.window_min_max_dates(fx.hourly_calendar)


@query("a36_first_last_event", f"""
    SELECT CAST(min(start_local) AS DATE) AS first_date, CAST(max(start_local) AS DATE) AS last_date, count(*) AS total FROM {LOCAL}""", "road_events")
def a36(fx: Fixtures) -> DataFrame:
    return A.first_last_event(A.incidents(fx.road_events))
