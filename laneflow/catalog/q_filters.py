"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from laneflow.catalog.fixtures import Fixtures
from laneflow.catalog.registry import query
from laneflow.functions import columns as C
from laneflow.functions.fixed_values import IMPACT_CLASSES, METRO_CITIES, STATE_CITIES
from laneflow.operators import filters

BOX = (33.4, 33.5, -112.05, -111.95)
BOX_SQL = "BETWEEN 33.4 AND 33.5 AND {lon} BETWEEN -112.05 AND -111.95"
WEEK = ("2024-01-10 00:00:00", "2024-01-17 00:00:00")
WEEK_EPOCH = (1_704_844_800, 1_705_449_600)


@query("f01_filter_bbox", f"SELECT ID, Latitude, Longitude FROM road_events WHERE Latitude {BOX_SQL.format(lon='Longitude')}",
       "road_events", "Latitude Longitude")
def f01(fx: Fixtures) -> DataFrame:
    return filters.filter_bbox(fx.road_events, BOX).select("ID", "Latitude", "Longitude")


@query("f02_filter_segments_bbox", f"""
    SELECT tmc FROM segments WHERE (start_latitude {BOX_SQL.format(lon='start_longitude')} OR end_latitude {BOX_SQL.format(lon='end_longitude')})
      AND road = 'R3'""", "segments")
def f02(fx: Fixtures) -> DataFrame:
    return filters.filter_segments_bbox(fx.segments, BOX, "R3").select("tmc")


@query("f02_road_only", "SELECT tmc FROM segments WHERE road = 'R3'", "segments")
def f02_road(fx: Fixtures) -> DataFrame:
    return filters.filter_segments_bbox(fx.segments, road="R3").select("tmc")


@query("f02_box_only", f"""
    SELECT tmc FROM segments WHERE start_latitude {BOX_SQL.format(lon='start_longitude')} OR end_latitude {BOX_SQL.format(lon='end_longitude')}""", "segments")
def f02_box(fx: Fixtures) -> DataFrame:
    return filters.filter_segments_bbox(fx.segments, BOX).select("tmc")


@query("f03_filter_road_pattern", "SELECT ID, RoadwayName FROM road_events WHERE regexp_matches(RoadwayName, '(?i)I-10|I10')", "road_events")
def f03(fx: Fixtures) -> DataFrame:
    return filters.filter_road_pattern(fx.road_events).select("ID", "RoadwayName")


@query("f04_filter_keys_timerange", f"""
    SELECT tmc_code, measurement_tstamp, speed FROM readings WHERE tmc_code IN (SELECT tmc FROM segments WHERE road = 'R2')
      AND measurement_tstamp >= TIMESTAMP '{WEEK[0]}' AND measurement_tstamp <= TIMESTAMP '{WEEK[1]}'""", "readings segments", "speed")
def f04(fx: Fixtures) -> DataFrame:
    keys = fx.segments.where("road = 'R2'").select(F.col("tmc").alias("tmc_code"))
    low, high = (F.lit(t).cast("timestamp") for t in WEEK)
    return filters.filter_keys_timerange(fx.readings, keys, low, high).select("tmc_code", "measurement_tstamp", "speed")


@query("f05_infer_direction", """
    SELECT ID, RoadwayName, CASE WHEN lower(DirectionOfTravel) = 'unknown'
        THEN coalesce(nullif(lower(regexp_extract(RoadwayName, '(?i)(west|east|south|north)', 1)), ''), 'unknown')
        ELSE DirectionOfTravel END AS DirectionOfTravel FROM road_events""", "road_events")
def f05(fx: Fixtures) -> DataFrame:
    return filters.infer_direction(fx.road_events).select("ID", "RoadwayName", "DirectionOfTravel")


@query("f06_drop_optional_columns", "SELECT ID, EventType FROM road_events", "road_events")
def f06(fx: Fixtures) -> DataFrame:
    wide = fx.road_events.select("ID", "EventType", F.lit("x").alias("EncodedPolyline"), F.lit(1).alias("Width"))
    return filters.drop_optional_columns(wide)


@query("f07_map_category", """
    SELECT ID, CASE WHEN EventSubType = 'leftlanes' THEN 'cat_planned' ELSE 'cat_unplanned' END AS two_level,
           CASE EventSubType WHEN 'leftlanes' THEN 'cat_closure' WHEN 'crashRlane' THEN 'cat_major' WHEN 'debrisinroad' THEN 'cat_obstruction'
                ELSE 'cat_misc' END AS five_level FROM road_events""", "road_events")
def f07(fx: Fixtures) -> DataFrame:
    two = filters.map_category(fx.road_events, out="two_level")
    return filters.map_category(two, IMPACT_CLASSES, "cat_misc", out="five_level").select("ID", "two_level", "five_level")


@query("f08_filter_city_radius", """
    SELECT ID FROM road_events WHERE Latitude BETWEEN CAST(33.3528 AS DOUBLE) - CAST(0.1 AS DOUBLE) AND CAST(33.3528 AS DOUBLE) + CAST(0.1 AS DOUBLE)
      AND Longitude BETWEEN CAST(-111.789 AS DOUBLE) - CAST(0.1 AS DOUBLE) AND CAST(-111.789 AS DOUBLE) + CAST(0.1 AS DOUBLE)""", "road_events")
def f08(fx: Fixtures) -> DataFrame:
    return filters.filter_city_radius(fx.road_events, "Gilbert", STATE_CITIES).select("ID")


@query("f09_active_events", f"""
    SELECT ID, EventType, LastUpdated FROM road_events
    WHERE ((EventType = 'accidentsAndIncidents' AND StartDate BETWEEN {WEEK_EPOCH[0]} AND {WEEK_EPOCH[1]})
        OR (EventType <> 'accidentsAndIncidents' AND StartDate <= {WEEK_EPOCH[1]} AND PlannedEndDate >= {WEEK_EPOCH[0]}))
      AND Latitude BETWEEN 33.3484 AND 33.5484 AND Longitude BETWEEN -112.174 AND -111.974""", "road_events")
def f09(fx: Fixtures) -> DataFrame:
    return filters.active_events(fx.road_events, *WEEK_EPOCH, "Phoenix", STATE_CITIES).select("ID", "EventType", "LastUpdated")


ISO_ACTIVE = f"""
    update_date IS NOT NULL AND try_cast(replace(substr(start_date, 1, 19), 'T', ' ') AS TIMESTAMP) <= TIMESTAMP '{WEEK[1]}'
    AND try_cast(replace(substr(end_date, 1, 19), 'T', ' ') AS TIMESTAMP) >= TIMESTAMP '{WEEK[0]}'"""


@query("f10_active_workzones", f"SELECT id, update_date, start_date, end_date FROM work_zones WHERE {ISO_ACTIVE}", "work_zones")
def f10(fx: Fixtures) -> DataFrame:
    kept = filters.active_between_iso(fx.work_zones, "2024-01-10T00:00:00Z", "2024-01-17T00:00:00Z")
    return kept.select("id", "update_date", "start_date", "end_date")


@query("f10_active_accidents", f"""
    SELECT id, update_date FROM work_zones WHERE event_type = 'error' AND {ISO_ACTIVE}
      AND latitude BETWEEN 33.3152 AND 33.5152 AND longitude BETWEEN -111.9315 AND -111.7315""", "work_zones")
def f10_accidents(fx: Fixtures) -> DataFrame:
    accidents = fx.work_zones.where("event_type = 'error'")
    kept = filters.active_between_iso(accidents, "2024-01-10T00:00:00Z", "2024-01-17T00:00:00Z", "Mesa", METRO_CITIES)
    return kept.select("id", "update_date")


@query("f11_split_valid_dates", """
    SELECT ID, EventType, CASE WHEN EventType = 'accidentsAndIncidents' THEN StartDate IS NOT NULL
        ELSE StartDate IS NOT NULL AND PlannedEndDate IS NOT NULL AND PlannedEndDate < 9223372036 END AS valid FROM road_events""", "road_events")
def f11(fx: Fixtures) -> DataFrame:
    valid, rejected = filters.split_valid_dates(fx.road_events)
    label = lambda df, flag: df.select("ID", "EventType", F.lit(flag).alias("valid"))
    return label(valid, True).unionByName(label(rejected, False))


@query("f12_snapshot_at", """
    SELECT r.tmc_code, r.speed, s.start_latitude, s.end_longitude FROM readings r JOIN segments s ON s.tmc = r.tmc_code
    WHERE r.measurement_tstamp = (SELECT max(measurement_tstamp) FROM readings)""", "readings segments", "speed start_latitude end_longitude")
def f12(fx: Fixtures) -> DataFrame:
    newest = fx.readings.agg(F.max("measurement_tstamp")).scalar()
    return filters.snapshot_at(fx.readings, fx.segments, newest).select("tmc_code", "speed", "start_latitude", "end_longitude")


@query("f13_filter_road_class", "SELECT segment_id, frc FROM flow_segments WHERE frc IN ('FRC0', 'FRC1')", "flow_segments")
def f13(fx: Fixtures) -> DataFrame:
    return filters.filter_road_class(fx.flow_segments).select("segment_id", "frc")


@query("f14_filter_direction", """
    SELECT tmc_code, measurement_tstamp, speed FROM readings
    WHERE tmc_code IN (SELECT tmc FROM segments WHERE direction = 'WESTBOUND') AND speed IS NOT NULL""", "readings segments", "speed")
def f14(fx: Fixtures) -> DataFrame:
    return filters.filter_direction(fx.readings, fx.segments, "W").select("tmc_code", "measurement_tstamp", "speed")


@query("f15_filter_year_limit", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders WHERE year(o_orderdate) < 1998")
def f15(fx: Fixtures) -> DataFrame:
    dated = fx.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"))
    return filters.filter_year_limit(dated, "o_orderdate", 1998)


@query("f16_filter_roads_project", """
    SELECT hour, tmc, speed_mean, road, direction, (start_latitude + end_latitude) / 2 AS lat, (start_longitude + end_longitude) / 2 AS lon,
           CASE WHEN speed_mean < 0 OR speed_mean > 1000 THEN NULL WHEN speed_mean <= 20 THEN '0-20' WHEN speed_mean <= 30 THEN '20-30'
                WHEN speed_mean <= 40 THEN '30-40' WHEN speed_mean <= 50 THEN '40-50' WHEN speed_mean <= 60 THEN '50-60' ELSE '60+' END AS speed_bin
    FROM hourly_calendar WHERE road IN ('R1', 'R4')""", "hourly_calendar", "speed_mean lat lon")
def f16(fx: Fixtures) -> DataFrame:
    return filters.hourly_points(fx.hourly_calendar, ["R1", "R4"])


@query("f17_filter_flag_split", """
    SELECT tmc_code, hour, is_peak AS part FROM hourly_calendar""", "hourly_calendar")
def f17(fx: Fixtures) -> DataFrame:
    rush, rest = filters.split_by_flag(fx.hourly_calendar.select("tmc_code", "hour", "is_peak"), F.col("is_peak"))
    mark = lambda df, flag: df.select("tmc_code", "hour", F.lit(flag).alias("part"))
    return mark(rush, True).unionByName(mark(rest, False))


@query("f18_filter_period", """
    SELECT 'week' AS period, tmc_code, hour, speed_mean FROM hourly_calendar WHERE year_week = '2024-03'
    UNION ALL SELECT 'date', tmc_code, hour, speed_mean FROM hourly_calendar WHERE date = DATE '2024-01-09'""", "hourly_calendar", "speed_mean")
def f18(fx: Fixtures) -> DataFrame:
    week = filters.filter_period(fx.hourly_calendar, year_week="2024-03").select(F.lit("week").alias("period"), "tmc_code", "hour", "speed_mean")
    day = filters.filter_period(fx.hourly_calendar, date="2024-01-09").select(F.lit("date").alias("period"), "tmc_code", "hour", "speed_mean")
    return week.unionByName(day)


@query("f19_report_lag_pairs", """
    SELECT EventType, LastUpdated AS update_time, StartDate AS start_time, (epoch(LastUpdated) - epoch(StartDate)) / 60.0 AS lag_minutes
    FROM utc_events""", "utc_events", "lag_minutes")
def f19(fx: Fixtures) -> DataFrame:
    return filters.report_lag_pairs(fx.utc_events, "LastUpdated", "StartDate", "EventType")
