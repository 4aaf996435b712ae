"""Joins (J01–J15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from laneflow.catalog.fixtures import Fixtures
from laneflow.catalog.q_scans import NEAREST, SCALE, SEARCHED
from laneflow.catalog.registry import query
from laneflow.functions.fixed_values import METRO_CITIES
from laneflow.operators import filters, grid, intervals, joins, spatial


@query("j01_nearest_segment_join", f"""
    WITH windowed_source AS (SELECT * FROM utc_events), searched AS ({SEARCHED}), scale AS ({SCALE}), nearest AS ({NEAREST})
    SELECT ID, found AS near_tmc, round(sqrt(d2), 3) AS near_distance, round(qx, 1) AS near_x, round(qy, 1) AS near_y, round(t, 6) AS near_t FROM nearest""", "utc_events segments")
def j01(fx: Fixtures) -> DataFrame:
    events = filters.infer_direction(fx.utc_events.drop("near_tmc"))
    matched = spatial.nearest_segment_join(events, fx.segments)
    # Coarse digits: the projection scale comes from a mean, whose last digits depend on summation order.
    digits = {"near_distance": 3, "near_x": 1, "near_y": 1, "near_t": 6}
    return matched.select("ID", "near_tmc", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query("j02_interval_overlap_counts", "SELECT tmc_code, time_bin, evt_cat_unplanned, evt_cat_planned FROM event_counts", "event_counts")
def j02(fx: Fixtures) -> DataFrame:
    cells = grid.densify_grid(fx.binned).select("tmc_code", "time_bin")
    return intervals.interval_overlap_counts(cells, fx.windowed, times=fx.binned)


@query("j02_interval_overlap_days", """
    WITH days AS (SELECT segment, day FROM (SELECT DISTINCT segment FROM day_intervals) CROSS JOIN
        (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1997-12-31', INTERVAL 7 DAY)) AS TIMESTAMP) AS day))
    SELECT d.segment, d.day AS time_bin, CAST(count(*) FILTER (WHERE category = '1-URGENT') AS INTEGER) AS "evt_1-URGENT",
           CAST(count(*) FILTER (WHERE category <> '1-URGENT') AS INTEGER) AS evt_rest
    FROM days d LEFT JOIN (SELECT *, coalesce(end_date, start_date) AS stop FROM day_intervals) i
      ON i.segment = d.segment AND d.day < i.stop AND d.day + INTERVAL 1 DAY > i.start_date
    GROUP BY 1, 2""", "day_intervals")
def j02_days(fx: Fixtures) -> DataFrame:
    """Long and inverted intervals on a sparse grid of single days."""
    spans = fx.day_intervals.select(
        "segment", F.col("start_date").cast("timestamp").alias("event_start"),
        F.coalesce("end_date", "start_date").cast("timestamp").alias("event_end"), "category",
    )
    days = F.explode(F.sequence(F.lit("1996-01-01").cast("timestamp"), F.lit("1997-12-31").cast("timestamp"), F.expr("INTERVAL 7 DAYS")))
    cells = fx.day_intervals.select("segment").distinct().select("segment", days.alias("time_bin"))
    return intervals.interval_overlap_counts(
        cells, spans, "1d", "segment", "segment", category="category", categories=["1-URGENT", "rest"], fallback="rest"
    )


@query("j03_event_window_rules", "SELECT ID, EventType, event_start, event_end FROM windowed", "windowed")
def j03(fx: Fixtures) -> DataFrame:
    return intervals.event_window_rules(fx.utc_events).select("ID", "EventType", "event_start", "event_end")


@query("j04_densify_grid", "SELECT tmc_code, time_bin, speed FROM dense", "dense", "speed")
def j04(fx: Fixtures) -> DataFrame:
    return grid.densify_grid(fx.binned).select("tmc_code", "time_bin", "speed")


@query("j04_densify_regular", """
    WITH whole AS (SELECT tmc_code, date_trunc('hour', measurement_tstamp) AS time_bin, avg(speed) AS speed FROM readings
                   WHERE hour(measurement_tstamp) <> 5 GROUP BY 1, 2),
    spine AS (SELECT unnest(generate_series(min(time_bin), max(time_bin), INTERVAL 1 HOUR)) AS time_bin FROM whole)
    SELECT t.tmc_code, s.time_bin, w.speed FROM (SELECT DISTINCT tmc_code FROM whole) t CROSS JOIN spine s
    LEFT JOIN whole w ON w.tmc_code = t.tmc_code AND w.time_bin = s.time_bin""", "readings", "speed")
def j04_regular(fx: Fixtures) -> DataFrame:
    """Every hour between the first and last bin, also hours no segment reported."""
    binned = grid.bin_readings(fx.readings.where(F.hour("measurement_tstamp") != 5))
    return grid.densify_grid(binned, grid="regular", interval="1h").select("tmc_code", "time_bin", "speed")


@query("j05_attach_segment_attributes", """
    SELECT b.tmc_code, b.time_bin, s.miles, coalesce(t.onramp, 0) AS onramp, coalesce(t.offramp, 0) AS offramp, coalesce(t.curve, 0) AS curve
    FROM binned b LEFT JOIN segments s ON s.tmc = b.tmc_code LEFT JOIN tags t ON t.tmc = b.tmc_code""", "binned segments tags", "miles")
def j05(fx: Fixtures) -> DataFrame:
    joined = joins.attach_segment_attributes(fx.binned, fx.tagged_segments)
    return joined.select("tmc_code", "time_bin", "miles", "onramp", "offramp", "curve")


@query("j07_join_readings_geometry", "SELECT tmc_code, hour, speed_mean, tmc, road, start_latitude FROM hourly_calendar",
       "hourly_calendar", "speed_mean start_latitude")
def j07(fx: Fixtures) -> DataFrame:
    joined = joins.join_readings_geometry(fx.hourly, fx.segments)
    return joined.select("tmc_code", "hour", "speed_mean", "tmc", "road", "start_latitude")


@query("j08_join_week_geometry", """
    SELECT w.tmc_code, w.speed_mean, s.road, s.miles FROM (SELECT tmc_code, avg(speed_mean) AS speed_mean FROM hourly_calendar
    WHERE year_week = '2024-02' GROUP BY 1) w JOIN segments s ON s.tmc = w.tmc_code""", "hourly_calendar segments", "speed_mean miles")
def j08(fx: Fixtures) -> DataFrame:
    hourly = fx.hourly_calendar.select("tmc_code", "year_week", "speed_mean")
    return joins.join_week_geometry(hourly, fx.segments, "2024-02").select("tmc_code", "speed_mean", "road", "miles")


@query("j09_join_flow_segments", """
    SELECT f.id, f.segment_id, f.currentSpeed, s.frc, s.openlr FROM flow f JOIN flow_segments s ON s.segment_id = f.segment_id""",
    "flow flow_segments", "currentSpeed")
def j09(fx: Fixtures) -> DataFrame:
    return joins.join_flow_segments(fx.flow, fx.flow_segments).select("id", "segment_id", "currentSpeed", "frc", "openlr")


@query("j10_date_spine_range_join", """
    SELECT CAST(d.date AS DATE) AS date, count(DISTINCT i.id) AS event_count
    FROM (SELECT unnest(generate_series(DATE '1997-03-01', DATE '1997-04-30', INTERVAL 1 DAY)) AS date) d
    LEFT JOIN day_intervals i ON d.date >= i.start_date AND d.date <= i.end_date GROUP BY 1""", "day_intervals")
def j10(fx: Fixtures) -> DataFrame:
    return intervals.daily_active_ids(fx.day_intervals, "1997-03-01", "1997-04-30")


@query("j10_epoch_spine", """
    SELECT d.date, count(DISTINCT e.ID) AS event_count
    FROM (SELECT unnest(range(1704100000, 1706300000 + 86400, 86400)) AS date) d
    LEFT JOIN road_events e ON d.date >= e.StartDate AND d.date <= e.PlannedEndDate GROUP BY 1""", "road_events")
def j10_epoch(fx: Fixtures) -> DataFrame:
    return intervals.epoch_active_ids(fx.road_events, 1_704_100_000, 1_706_300_000)


CITIES_SQL = ", ".join(f"('{n}', {i}, CAST({la} AS DOUBLE), CAST({lo} AS DOUBLE))" for i, (n, (la, lo)) in enumerate(METRO_CITIES.items()))


@query("j11_nearest_city", f"""
    SELECT id, arg_min(name, d) AS nearest_city FROM (
        SELECT z.id, c.name, (sqrt((latitude - c.la) * (latitude - c.la) + (longitude - c.lo) * (longitude - c.lo)), c.r) AS d
        FROM work_zones z CROSS JOIN (VALUES {CITIES_SQL}) AS c(name, r, la, lo)) GROUP BY 1""", "work_zones")
def j11(fx: Fixtures) -> DataFrame:
    return spatial.nearest_city(fx.work_zones, METRO_CITIES).select("id", "nearest_city")


@query("j12_semi_anti_filter", """
    SELECT tmc_code, hour, tmc_code IN (SELECT tmc FROM segments WHERE road = 'R5') AS kept FROM hourly""", "hourly segments")
def j12(fx: Fixtures) -> DataFrame:
    keys = fx.segments.where("road = 'R5'").select(F.col("tmc").alias("tmc_code"))
    hours = fx.hourly.select("tmc_code", "hour")
    kept = joins.semi_filter(hours, keys, "tmc_code").withColumn("kept", F.lit(True))
    return kept.unionByName(joins.anti_filter(hours, keys, "tmc_code").withColumn("kept", F.lit(False)))


@query("j13_join_impact_long", "SELECT time_bin, tmc_code AS tmc, diff, residuals, plnd_evt, un_plnd_evt FROM impact WHERE diff > 0",
       "impact", "diff residuals")
def j13(fx: Fixtures) -> DataFrame:
    rows = fx.impact.withColumnRenamed("tmc_code", "tmc")
    diff = rows.select("time_bin", "tmc", F.when(F.col("diff") > 0, F.col("diff")).alias("diff"))
    parts = [rows.select("time_bin", "tmc", c) for c in ("residuals", "plnd_evt", "un_plnd_evt")]
    return joins.join_impact_long(diff, *parts)


@query("j14_join_truth_prediction", """
    SELECT model, time_bin, tmc_code, y_true, CASE WHEN hour(time_bin) < 12 THEN y_pred END AS y_pred FROM predictions""", "predictions", "y_true y_pred")
def j14(fx: Fixtures) -> DataFrame:
    """Wide truth and (half a day of) prediction matrices of all segments to one long table per model."""
    from laneflow.operators.reshape import pivot_long_to_wide

    def one(model: str) -> DataFrame:
        rows = fx.predictions.where(F.col("model") == model)
        truth = pivot_long_to_wide(rows, "time_bin", "tmc_code", "y_true", fx.codes)
        predicted = pivot_long_to_wide(rows.where(F.hour("time_bin") < 12), "time_bin", "tmc_code", "y_pred", fx.codes)
        return joins.join_truth_prediction(truth, predicted, fx.codes).withColumn("model", F.lit(model))

    return one("last").unionByName(one("mixed"))


@query("j15_holiday_join", """
    SELECT h.date, h.holiday, d.speed_mean FROM (VALUES (DATE '2024-01-01', 'New Year''s Day'), (DATE '2024-01-15', 'MLK Day')) AS h(date, holiday)
    JOIN (SELECT date, avg(speed_mean) AS speed_mean FROM hourly_calendar GROUP BY 1) d ON d.date = h.date""", "hourly_calendar", "speed_mean")
def j15(fx: Fixtures) -> DataFrame:
    from laneflow.operators.aggregates import daily_trend

    return joins.holiday_join(daily_trend(fx.hourly_calendar))


@query("j15_holiday_join_years", """
    SELECT h.date, h.holiday, d.speed_mean FROM (
        SELECT CAST(d AS DATE) AS date, CASE
            WHEN (month(d) = 1 AND day(d) = 1 AND isodow(d) < 6) OR (month(d) = 12 AND day(d) = 31 AND isodow(d) = 5) OR (month(d) = 1 AND day(d) = 2 AND isodow(d) = 1) THEN 'New Year''s Day'
            WHEN month(d) = 1 AND isodow(d) = 1 AND day(d) BETWEEN 15 AND 21 THEN 'MLK Day'
            WHEN month(d) = 5 AND isodow(d) = 1 AND day(d) > 24 THEN 'Memorial Day'
            WHEN month(d) = 7 AND ((day(d) = 4 AND isodow(d) < 6) OR (day(d) = 3 AND isodow(d) = 5) OR (day(d) = 5 AND isodow(d) = 1)) THEN 'Independence Day'
            WHEN month(d) = 9 AND isodow(d) = 1 AND day(d) < 8 THEN 'Labor Day'
            WHEN month(d) = 11 AND isodow(d) = 4 AND day(d) BETWEEN 22 AND 28 THEN 'Thanksgiving'
            WHEN month(d) = 12 AND ((day(d) = 25 AND isodow(d) < 6) OR (day(d) = 24 AND isodow(d) = 5) OR (day(d) = 26 AND isodow(d) = 1)) THEN 'Christmas' END AS holiday
        FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders)) h
    JOIN (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS speed_mean FROM orders GROUP BY 1) d ON d.date = h.date
    WHERE h.holiday IS NOT NULL""", "", "speed_mean")
def j15_years(fx: Fixtures) -> DataFrame:
    """Holidays over all years of the orders table."""
    daily = fx.table("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("speed_mean"))
    return joins.holiday_join(daily)
