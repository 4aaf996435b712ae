"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from laneflow.catalog.fixtures import Fixtures
from laneflow.catalog.registry import query
from laneflow.functions import columns as C
from laneflow.functions.holidays import us_holidays


@query("x01_to_utc", "SELECT ID, Reported AS in_seconds, Reported AS in_millis, StartDate, PlannedEndDate FROM utc_events", "utc_events")
def x01(fx: Fixtures) -> DataFrame:
    both = fx.road_events.select(
        "ID", F.col("Reported").alias("in_seconds"), (F.col("Reported") * 1000).alias("in_millis"), "StartDate", "PlannedEndDate"
    )
    return C.to_utc(both, ["in_seconds", "in_millis", "StartDate", "PlannedEndDate"])


@query("x02_ensure_utc", "SELECT event_id, ts AS naive, ts + INTERVAL 7 HOUR AS from_phoenix FROM events")
def x02(fx: Fixtures) -> DataFrame:
    raw = fx.table("events")
    return raw.select("event_id", C.ensure_utc("ts").alias("naive"), C.ensure_utc("ts", "America/Phoenix").alias("from_phoenix"))


@query("x03_floor_time", """
    SELECT event_id, time_bucket(INTERVAL 5 MINUTE, ts) AS five_min, date_trunc('hour', ts) AS hour, time_bucket(INTERVAL 6 HOUR, ts) AS six_hours,
           date_trunc('day', ts) AS day FROM events""")
def x03(fx: Fixtures) -> DataFrame:
    names = {"five_min": "5min", "hour": "1h", "six_hours": "6h", "day": "1d"}
    return fx.events.select("event_id", *[C.floor_time("ts", i).alias(n) for n, i in names.items()])


@query("x04_cyclic_features", """
    SELECT event_id, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos, sin(2 * pi() * (isodow(ts) - 1) / 7) AS dow_sin,
           cos(2 * pi() * (isodow(ts) - 1) / 7) AS dow_cos, CAST((isodow(ts) - 1) * 24 + hour(ts) AS INTEGER) AS hour_of_week,
           sin(2 * pi() * ((isodow(ts) - 1) * 24 + hour(ts)) / 168) AS hour_of_week_sin, cos(2 * pi() * ((isodow(ts) - 1) * 24 + hour(ts)) / 168) AS hour_of_week_cos,
           CAST(isodow(ts) > 5 AS INTEGER) AS is_weekend FROM events""", "", "hour_sin hour_cos dow_sin dow_cos hour_of_week_sin hour_of_week_cos")
def x04(fx: Fixtures) -> DataFrame:
    return fx.events.select("event_id", *[e.alias(n) for n, e in C.cyclic_features("ts").items()])


@query("x05_calendar_features", """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, CAST(month(o_orderdate) AS INTEGER) AS month, monthname(o_orderdate) AS month_name,
           CAST(day(o_orderdate) AS INTEGER) AS day, dayname(o_orderdate) AS day_of_week, CAST(hour(o_orderdate) AS INTEGER) AS hour_of_day,
           CAST(week(o_orderdate) AS INTEGER) AS week, CAST(isoyear(o_orderdate) AS INTEGER) AS year,
           isoyear(o_orderdate) || '-' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS year_week FROM orders""")
def x05(fx: Fixtures) -> DataFrame:
    orders = fx.table("orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    return orders.select("o_orderkey", *[e.alias(n) for n, e in C.calendar_features("at").items()])


@query("x06_season", """
    SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) < 6 THEN 'Spring' WHEN month(o_orderdate) < 9 THEN 'Summer'
           ELSE 'Fall' END AS season FROM orders""")
def x06(fx: Fixtures) -> DataFrame:
    return fx.table("orders").select("o_orderkey", C.season(F.month("o_orderdate")).alias("season"))


@query("x07_rush_flags", """
    SELECT event_id, hour(ts) BETWEEN 7 AND 9 AS is_morning_rush, hour(ts) BETWEEN 16 AND 18 AS is_evening_rush,
           hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 16 AND 18 AS is_peak, isodow(ts) > 5 AS is_weekend FROM events""")
def x07(fx: Fixtures) -> DataFrame:
    flags = C.rush_flags(F.hour("ts"), F.date_format("ts", "EEEE"))
    return fx.events.select("event_id", *[e.alias(n) for n, e in flags.items()])


@query("x08_per_mile", """
    SELECT tmc_code, time_bin, tt_per_mile, lag1_tt_per_mile, lag2_tt_per_mile, lag3_tt_per_mile, speed_ratio FROM features""",
    "features", "tt_per_mile lag1_tt_per_mile lag2_tt_per_mile lag3_tt_per_mile speed_ratio")
def x08(fx: Fixtures) -> DataFrame:
    base = fx.features.select("tmc_code", "time_bin", "travel_time_seconds", "miles", "lag1", "lag2", "lag3", "speed", "reference_speed")
    derived = {**C.per_mile(), "speed_ratio": C.speed_ratio()}
    return base.select("tmc_code", "time_bin", *[e.alias(n) for n, e in derived.items()])


@query("x09_log_features", """
    SELECT tmc_code, time_bin, ln(tt_per_mile + CAST(1e-6 AS DOUBLE)) AS log_tt_per_mile, ln(lag1_tt_per_mile + CAST(1e-6 AS DOUBLE)) AS log_lag1_tt_per_mile,
           ln(1 + tt_per_mile) AS log1p_tt FROM features""", "features", "log_tt_per_mile log_lag1_tt_per_mile log1p_tt")
def x09(fx: Fixtures) -> DataFrame:
    keys = ["tmc_code", "time_bin"]
    raw = fx.features.select(*keys, "tt_per_mile", "lag1_tt_per_mile")
    logged = C.log_features(raw).withColumnsRenamed({"log_tt_per_mile": "eps_log", "log_lag1_tt_per_mile": "eps_lag"})
    both = C.log_features(logged, "log1p")
    return both.select(*keys, F.col("eps_log").alias("log_tt_per_mile"), F.col("eps_lag").alias("log_lag1_tt_per_mile"), F.col("log_tt_per_mile").alias("log1p_tt"))


def _band_sql(low: str, high: str) -> str:
    return f"""CASE WHEN NOT ({low}) OR {high} THEN NULL WHEN v <= 20 THEN '0-20' WHEN v <= 30 THEN '20-30' WHEN v <= 40 THEN '30-40'
        WHEN v <= 50 THEN '40-50' WHEN v <= 60 THEN '50-60' ELSE '60+' END"""


@query("x10_speed_band", f"""
    SELECT event_id, {_band_sql('v > 0', 'v > 100')} AS strict_band, {_band_sql('v >= 0', 'v > 1000')} AS open_band,
           CASE WHEN v > 60 THEN '60+' WHEN v > 50 THEN '50-60' WHEN v > 40 THEN '40-50' WHEN v > 30 THEN '30-40' WHEN v > 20 THEN '20-30' ELSE '0-20' END AS default_band
    FROM (SELECT event_id, round(value) - 10 AS v FROM events)""")
def x10(fx: Fixtures) -> DataFrame:
    rows = fx.events.select("event_id", (F.round("value") - 10).alias("v"))
    return rows.select("event_id", *[C.speed_band("v", kind).alias(f"{kind}_band") for kind in ("strict", "open", "default")])


@query("x11_flow_tier", """
    SELECT id, ratio, CASE WHEN ratio > 0.9 THEN 'excellent' WHEN ratio > 0.7 THEN 'good' WHEN ratio > 0.5 THEN 'moderate' WHEN ratio > 0.3 THEN 'slow' ELSE 'stopped' END AS tier,
           CASE WHEN currentSpeed < 35 THEN 'congested' WHEN currentSpeed < 50 THEN 'critical' ELSE 'free-flow' END AS class
    FROM (SELECT *, CASE WHEN freeFlowSpeed > 0 THEN greatest(0.0, least(1.0, currentSpeed / freeFlowSpeed)) ELSE 0.5 END AS ratio FROM flow)""", "flow", "ratio")
def x11(fx: Fixtures) -> DataFrame:
    return fx.flow.select(
        "id", C.flow_ratio("currentSpeed", "freeFlowSpeed").alias("ratio"), C.flow_tier("currentSpeed", "freeFlowSpeed").alias("tier"),
        C.speed_class("currentSpeed").alias("class"),
    )


@query("x12_us_holidays", """
    SELECT date, holiday FROM (
        SELECT CAST(d AS DATE) AS date, CASE
            WHEN (month(d) = 1 AND day(d) = 1 AND isodow(d) < 6) OR (month(d) = 12 AND day(d) = 31 AND isodow(d) = 5) OR (month(d) = 1 AND day(d) = 2 AND isodow(d) = 1) THEN 'New Year''s Day'
            WHEN month(d) = 1 AND isodow(d) = 1 AND day(d) BETWEEN 15 AND 21 THEN 'MLK Day'
            WHEN month(d) = 5 AND isodow(d) = 1 AND day(d) > 24 THEN 'Memorial Day'
            WHEN month(d) = 7 AND ((day(d) = 4 AND isodow(d) < 6) OR (day(d) = 3 AND isodow(d) = 5) OR (day(d) = 5 AND isodow(d) = 1)) THEN 'Independence Day'
            WHEN month(d) = 9 AND isodow(d) = 1 AND day(d) < 8 THEN 'Labor Day'
            WHEN month(d) = 11 AND isodow(d) = 4 AND day(d) BETWEEN 22 AND 28 THEN 'Thanksgiving'
            WHEN month(d) = 12 AND ((day(d) = 25 AND isodow(d) < 6) OR (day(d) = 24 AND isodow(d) = 5) OR (day(d) = 26 AND isodow(d) = 1)) THEN 'Christmas' END AS holiday
        FROM (SELECT unnest(generate_series(min(l_shipdate), max(l_shipdate), INTERVAL 1 DAY)) AS d FROM lineitem)) WHERE holiday IS NOT NULL""")
def x12(fx: Fixtures) -> DataFrame:
    """Holidays between the first and last ship date."""
    line = fx.table("lineitem")
    low, high = (line.agg(F.to_date(f("l_shipdate"))).scalar() for f in (F.min, F.max))
    return us_holidays(fx.spark, low, high)


@query("x13_iso_week_label", """
    SELECT DISTINCT year_week, 'Week ' || CAST(week(m) AS VARCHAR) || ' (' || strftime(m, '%b %d') || ' - ' || strftime(m + INTERVAL 6 DAY, '%b %d, %Y') || ')' AS label
    FROM (SELECT isoyear(o_orderdate) || '-' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS year_week, date_trunc('week', o_orderdate) AS m FROM orders)""")
def x13(fx: Fixtures) -> DataFrame:
    weeks = fx.table("orders").select(C.calendar_features(F.col("o_orderdate").cast("timestamp"))["year_week"].alias("year_week")).distinct()
    return weeks.select("year_week", C.iso_week_label("year_week").alias("label"))


@query("x14_to_local_time", """
    SELECT ID, CASE WHEN PlannedEndDate < 9223372036 THEN make_timestamp((PlannedEndDate - 25200) * 1000000) END AS or_null,
           CASE WHEN PlannedEndDate IS NULL THEN NULL ELSE make_timestamp((least(PlannedEndDate, 9223372036) - 25200) * 1000000) END AS or_sentinel FROM road_events""", "road_events")
def x14(fx: Fixtures) -> DataFrame:
    return fx.road_events.select(
        "ID", C.to_local_time("PlannedEndDate").alias("or_null"), C.to_local_time("PlannedEndDate", out_of_range="sentinel").alias("or_sentinel")
    )


@query("x15_event_duration", """
    SELECT ID, round(CASE WHEN EventType IN ('closures', 'roadwork') THEN (r.PlannedEndDate - r.StartDate) / CAST(60 AS DOUBLE)
                    WHEN EventType = 'accidentsAndIncidents' THEN (r.LastUpdated - r.Reported) / CAST(60 AS DOUBLE) END, 2) AS minutes,
           CASE WHEN u.PlannedEndDate - u.StartDate IS NOT NULL THEN least(epoch(u.PlannedEndDate - u.StartDate) / CAST(86400 AS DOUBLE), 0.25) END AS days_capped
    FROM road_events r JOIN (SELECT ID, StartDate, PlannedEndDate FROM utc_events) u USING (ID)""", "road_events utc_events", "days_capped")
def x15(fx: Fixtures) -> DataFrame:
    timed = fx.road_events.withColumns({"s": C.epoch_to_timestamp(F.col("StartDate")), "e": C.epoch_to_timestamp(F.col("PlannedEndDate"))})
    # Minutes reach 1e9 here, where a double holds no sixth decimal: two are compared.
    return timed.select("ID", F.round(C.event_minutes(), 2).alias("minutes"), C.duration_days("s", "e", 0.25).alias("days_capped"))


@query("x16_event_label", "SELECT tmc_code, time_bin, event_type FROM impact", "impact")
def x16(fx: Fixtures) -> DataFrame:
    return fx.features.select("tmc_code", "time_bin", C.event_label("evt_cat_planned", "evt_cat_unplanned").alias("event_type"))


@query("x17_point_segment_distance", """
    SELECT ID, t, sqrt(power(px - (ax + t * vx), 2) + power(py - (ay + t * vy), 2)) AS distance, ax + t * vx AS proj_x, ay + t * vy AS proj_y FROM (
        SELECT *, CASE WHEN vx * vx + vy * vy = 0 THEN 0 ELSE greatest(0.0, least(1.0, ((px - ax) * vx + (py - ay) * vy) / (vx * vx + vy * vy))) END AS t FROM (
            SELECT ID, Longitude AS px, Latitude AS py, start_longitude AS ax, start_latitude AS ay, end_longitude - start_longitude AS vx, end_latitude - start_latitude AS vy
            FROM road_events JOIN segments ON tmc = near_tmc WHERE Latitude IS NOT NULL))""", "road_events segments", "t distance proj_x proj_y")
def x17(fx: Fixtures) -> DataFrame:
    """Each event against its own segment, in degrees."""
    pairs = fx.road_events.join(fx.segments, F.col("tmc") == F.col("near_tmc")).where(F.col("Latitude").isNotNull())
    names = ["Longitude", "Latitude", "start_longitude", "start_latitude", "end_longitude", "end_latitude"]
    parts = C.point_segment_distance(*[F.col(n) for n in names])
    return pairs.select("ID", *[e.alias(n) for n, e in parts.items()])


@query("x18_parse_polyline", """
    SELECT p_partkey AS segment_id, CAST(CASE WHEN n > 10 THEN (n + 2) // 3 ELSE n END AS INTEGER) AS n_points,
           CASE WHEN n > 10 THEN 33.5 + 3 * ((n + 2) // 3 - 1) ELSE 33.5 + n - 1 END AS last_latitude
    FROM (SELECT p_partkey, p_size % 15 AS n FROM part) WHERE n >= 2""", "", "last_latitude")
def x18(fx: Fixtures) -> DataFrame:
    parsed = fx.flow_segments.select("segment_id", C.parse_polyline("coordinates").alias("p")).where(F.col("p").isNotNull())
    return parsed.select("segment_id", F.size("p").alias("n_points"), F.element_at("p", -1).latitude.alias("last_latitude"))


@query("x19_hour_label_12h", """
    SELECT event_id, CASE WHEN hour(ts) = 0 THEN '12 AM' WHEN hour(ts) < 12 THEN hour(ts) || ' AM' WHEN hour(ts) = 12 THEN '12 PM' ELSE (hour(ts) - 12) || ' PM' END AS label FROM events""")
def x19(fx: Fixtures) -> DataFrame:
    return fx.events.select("event_id", C.hour_label_12h(F.hour("ts")).alias("label"))


@query("x20_describe_flow", """
    SELECT id, 'Traffic Flow (' || frc || ') - Speed: ' || printf('%.1f', currentSpeed) || '/' || printf('%.1f', freeFlowSpeed) || ' mph' AS Description,
           frc || ' Road' AS RoadwayName, CASE WHEN confidence IS NULL THEN 'N/A' ELSE 'Confidence: ' || printf('%.2f', confidence) END AS Severity
    FROM flow f JOIN flow_segments s ON s.segment_id = f.segment_id""", "flow flow_segments")
def x20(fx: Fixtures) -> DataFrame:
    joined = fx.flow.join(fx.flow_segments, "segment_id")
    return joined.select("id", *[e.alias(n) for n, e in C.describe_flow().items()])


@query("x21_clip_log", "SELECT event_id, ln(greatest(value - 5, CAST(1e-8 AS DOUBLE))) AS logged FROM events", "", "logged")
def x21(fx: Fixtures) -> DataFrame:
    return fx.events.select("event_id", C.clip_log(F.col("value") - 5).alias("logged"))


@query("x22_evt_total", "SELECT tmc_code, time_bin, evt_cat_unplanned + evt_cat_planned AS evt_total FROM features", "features")
def x22(fx: Fixtures) -> DataFrame:
    return fx.features.select("tmc_code", "time_bin", C.evt_total(["evt_cat_unplanned", "evt_cat_planned"]).alias("evt_total"))


@query("x23_text_preview", "SELECT doc_id, substr(coalesce(text, ''), 1, 80) AS preview FROM documents")
def x23(fx: Fixtures) -> DataFrame:
    return fx.table("documents").select("doc_id", C.text_preview("text").alias("preview"))


@query("x24_segment_midpoint", """
    SELECT tmc, (start_latitude + end_latitude) / 2 AS lat, (start_longitude + end_longitude) / 2 AS lon,
           road || ' ' || direction || ' - ' || printf('%.1f', miles) || ' mph' AS label FROM segments""", "segments", "lat lon")
def x24(fx: Fixtures) -> DataFrame:
    """Midpoint, and the label with miles in place of speed."""
    return fx.segments.select("tmc", *[e.alias(n) for n, e in C.segment_midpoint().items()], C.segment_label(F.col("miles")).alias("label"))
