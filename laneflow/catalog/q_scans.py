"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from laneflow.catalog.fixtures import Fixtures
from laneflow.catalog.registry import query
from laneflow.operators import grid, joins
from laneflow.plans.feature_table import build_feature_table, dense_features
from laneflow.sources import readers, writers
from laneflow.session import shared_dir

EVENT_LIST = "ID, RoadwayName, DirectionOfTravel, EventType, Reported, LastUpdated, StartDate, PlannedEndDate, Latitude, Longitude"


@query("s01_read_events", f"SELECT {EVENT_LIST} FROM utc_events", "utc_events", "Latitude Longitude")
def s01(fx: Fixtures) -> DataFrame:
    """Events written to JSON, read back with the fixed schema and UTC times."""
    path = shared_dir(fx.spark, "events")
    fx.road_events.write.json(path)
    return readers.read_events(fx.spark, path, "json").select(*EVENT_LIST.split(", "))


@query("s02_read_segments", """
    SELECT tmc, road, direction, intersection, start_latitude, start_longitude, end_latitude, end_longitude, miles, road_order, active_start_date
    FROM (SELECT *, row_number() OVER (PARTITION BY tmc ORDER BY active_start_date DESC NULLS LAST, road DESC, direction DESC, intersection DESC) AS rn
          FROM segment_versions
          WHERE ((start_latitude BETWEEN 33.4 AND 33.5 AND start_longitude BETWEEN -112.05 AND -111.9)
              OR (end_latitude BETWEEN 33.4 AND 33.5 AND end_longitude BETWEEN -112.05 AND -111.9)) AND road = 'R1') WHERE rn = 1""",
    "segment_versions", "start_latitude start_longitude end_latitude end_longitude miles road_order")
def s02(fx: Fixtures) -> DataFrame:
    path = shared_dir(fx.spark, "segments")
    fx.segment_versions.write.option("header", True).csv(path)
    return readers.read_segments(fx.spark, path, (33.4, 33.5, -112.05, -111.9), "R1")


@query("s03_read_readings", """
    SELECT tmc_code, measurement_tstamp, speed, reference_speed, travel_time_seconds FROM readings
    WHERE tmc_code IN (SELECT tmc FROM segments WHERE direction = 'EASTBOUND')
      AND measurement_tstamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'""",
    "readings segments", "speed reference_speed travel_time_seconds")
def s03(fx: Fixtures) -> DataFrame:
    path = shared_dir(fx.spark, "readings")
    stamp = F.date_format("measurement_tstamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    fx.readings.withColumns({"measurement_tstamp": stamp, "confidence_score": F.lit(30)}).write.option("header", True).csv(path)
    keys = fx.segments.where("direction = 'EASTBOUND'").select(F.col("tmc").alias("tmc_code"))
    read = readers.read_readings(fx.spark, path, keys, "2024-01-05 00:00:00", "2024-01-12 00:00:00")
    return read.drop("confidence_score")


FEATURE_NUMBERS = (
    "speed travel_time_seconds reference_speed lag1 lag2 lag3 miles hour_sin hour_cos dow_sin dow_cos hour_of_week_sin "
    "hour_of_week_cos tt_per_mile lag1_tt_per_mile lag2_tt_per_mile lag3_tt_per_mile speed_ratio"
)


@query("s04_read_feature_table", "SELECT tmc_code, time_bin, speed, evt_total FROM features", "features", "speed")
def s04(fx: Fixtures) -> DataFrame:
    path = shared_dir(fx.spark, "features")
    fx.features.write.parquet(path)
    return readers.read_feature_table(fx.spark, path, ["speed", "evt_total"])


@query("s05_write_feature_table", """
    SELECT count(*) AS n_rows, CAST(28 AS INTEGER) AS n_columns, count(DISTINCT tmc_code || CAST(time_bin AS VARCHAR)) AS n_pairs FROM features""",
    "features")
def s05(fx: Fixtures) -> DataFrame:
    return writers.write_feature_table(fx.unwritten_features, shared_dir(fx.spark, "features"))


@query("s06_rollup_cache", "SELECT * FROM hourly", "hourly", "speed_mean speed_median speed_min speed_max")
def s06(fx: Fixtures) -> DataFrame:
    """Hourly roll-up built once; the second call reloads it."""
    path = shared_dir(fx.spark, "rollup")
    writers.rollup_cache(fx.spark, path, lambda: fx.hourly)
    return writers.rollup_cache(fx.spark, path, lambda: fx.hourly.limit(0))


@query("s07_rewrite_bounded_files", "SELECT count(*) AS n_rows, true AS bounded, true AS several FROM readings", "readings")
def s07(fx: Fixtures) -> DataFrame:
    """All readings in CSV files of at most 20,000 bytes."""
    files = writers.rewrite_bounded_files(fx.readings, shared_dir(fx.spark, "bounded"), 20_000)
    return files.agg(F.sum("n_rows").alias("n_rows"), (F.max("n_bytes") <= 20_000).alias("bounded"), (F.count(F.lit(1)) > 1).alias("several"))


@query("s08_geojson", """
    SELECT tmc, point, lon, lat, speed_mean FROM (
        SELECT s.tmc, w.speed_mean, unnest([0, 1]) AS point, unnest([start_longitude, end_longitude]) AS lon, unnest([start_latitude, end_latitude]) AS lat
        FROM segments s JOIN (SELECT tmc_code, avg(speed_mean) AS speed_mean FROM hourly GROUP BY 1) w ON w.tmc_code = s.tmc)""",
    "segments hourly", "lon lat speed_mean")
def s08(fx: Fixtures) -> DataFrame:
    """Segments to LineString features on disk, and back to points."""
    speeds = fx.hourly.groupBy("tmc_code").agg(F.avg("speed_mean").alias("speed_mean"))
    rows = fx.segments.join(speeds, F.col("tmc") == F.col("tmc_code"))
    path = shared_dir(fx.spark, "geojson")
    writers.write_geojson(writers.to_geojson(rows), path)
    points = readers.from_geojson(fx.spark, path, lines=True)
    return points.select(
        F.col("properties")["tmc"].alias("tmc"), "point", "lon", "lat", F.col("properties")["speed_mean"].cast("double").alias("speed_mean")
    )


@query("s09_write_predictions", "SELECT model, count(*) AS n, avg(y_pred) AS mean_pred FROM predictions GROUP BY 1", "predictions", "mean_pred")
def s09(fx: Fixtures) -> DataFrame:
    path = shared_dir(fx.spark, "predictions")
    extra = {"split": F.lit("test"), "seq_len": F.lit(24), "direction": F.lit("WB")}
    writers.write_predictions(fx.predictions.withColumns(extra), path)
    stored = fx.spark.read.parquet(path)
    return stored.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("y_pred").alias("mean_pred"))


@query("s09_read_predictions", """
    WITH late AS (SELECT * FROM predictions WHERE time_bin >= (SELECT min(time_bin) + INTERVAL 24 HOUR FROM predictions))
    SELECT f.tmc_code, f.time_bin, m.model, p.y_pred FROM features f CROSS JOIN (VALUES ('last'), ('mixed')) AS m(model)
    LEFT JOIN late p ON p.tmc_code = f.tmc_code AND p.time_bin = f.time_bin AND p.model = m.model""", "predictions features", "y_pred")
def s09_read(fx: Fixtures) -> DataFrame:
    """Predictions without a model's first day, written and read back on the whole timeline."""
    path = shared_dir(fx.spark, "predictions")
    first = fx.predictions.agg(F.min("time_bin")).scalar()
    extra = {"split": F.lit("test"), "seq_len": F.lit(24), "direction": F.lit("WB")}
    writers.write_predictions(fx.predictions.where(F.col("time_bin") >= first + F.expr("INTERVAL 24 HOURS")).withColumns(extra), path)
    return readers.read_predictions(fx.spark, path, fx.travel_times).select("tmc_code", "time_bin", "model", "y_pred")


@query("s10_top_features", """
    SELECT model, 'error' AS kind, CAST(rank AS INTEGER) AS rank, feature, score FROM (
        SELECT model, unnest([1, 2]) AS rank, unnest(['rmse', 'mae']) AS feature,
               unnest([sqrt(avg(power(y_true - y_pred, 2))), avg(abs(y_true - y_pred))]) AS score FROM predictions GROUP BY model)""", "predictions", "score")
def s10_top(fx: Fixtures) -> DataFrame:
    """The list nested beside each model's metrics, read back as rows."""
    d = F.col("y_true") - F.col("y_pred")
    errors = fx.predictions.groupBy("model").agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"))
    top = errors.unpivot("model", ["rmse", "mae"], "feature", "score").withColumns({
        "kind": F.lit("error"), "rank": F.when(F.col("feature") == "rmse", 1).otherwise(2),
    })
    folder = shared_dir(fx.spark, "metrics")
    writers.write_metrics(errors.select("model", F.col("rmse").alias("cv_rmse_mean")), top, folder)
    return readers.read_top_features(fx.spark, f"{folder}/metrics_json")


@query("s10_metrics", """
    SELECT model, sqrt(avg(power(y_true - y_pred, 2))) AS cv_rmse FROM predictions GROUP BY 1""", "predictions", "cv_rmse")
def s10(fx: Fixtures) -> DataFrame:
    """Metrics with nested top features to CSV and JSON; read back under whichever alias is there."""
    d = F.col("y_true") - F.col("y_pred")
    metrics = fx.predictions.groupBy("model").agg(F.sqrt(F.avg(d * d)).alias("cv_rmse_mean"))
    top = metrics.select("model", F.lit("coef_abs").alias("kind"), F.lit(1).alias("rank"), F.lit("lag1").alias("feature"), F.lit(0.75).alias("score"))
    folder = shared_dir(fx.spark, "metrics")
    writers.write_metrics(metrics, top, folder)
    return readers.read_metrics(fx.spark, f"{folder}/metrics_json")


def _profile_sql(columns: list[tuple[str, bool]]) -> str:
    parts = []
    for name, numeric in columns:
        v = f"CAST({name} AS DOUBLE)"
        numbers = ", ".join(
            f"{expr if numeric else 'CAST(NULL AS DOUBLE)'} AS {alias}"
            for alias, expr in [
                ("mean", f"avg({v})"), ("std", f"stddev_samp({v})"), ("min", f"min({v})"), ("max", f"max({v})"),
                *[(f"p{p}", f"quantile_cont({v}, {p / 100})") for p in (5, 25, 50, 75, 95)],
            ]
        )
        parts.append(
            f"SELECT '{name}' AS \"column\", count(*) AS n_rows, count(*) - count({name}) AS n_null, "
            f"(count(*) - count({name})) * 100.0 / count(*) AS null_percent, {numbers} FROM dense"
        )
    return " UNION ALL ".join(parts)


@query("s11_table_profile", _profile_sql([("tmc_code", False), ("time_bin", False), ("speed", True), ("travel_time_seconds", True)]),
       "dense", "null_percent mean std min max p5 p25 p50 p75 p95")
def s11(fx: Fixtures) -> DataFrame:
    dense = grid.densify_grid(fx.binned).select("tmc_code", "time_bin", "speed", "travel_time_seconds")
    return writers.table_profile(dense)


@query("s12_write_training_snapshot", "SELECT curve, evt_total, lag1, miles, tt_per_mile FROM features", "features", "lag1 miles tt_per_mile")
def s12(fx: Fixtures) -> DataFrame:
    wanted = ["miles", "lag1", "evt_total", "curve", "not_there"]
    return writers.write_training_snapshot(fx.features, wanted, "tt_per_mile", shared_dir(fx.spark, "snapshot"))


# --- the whole feature table ----------------------------------------------

NEAREST = """
    SELECT * FROM (
        SELECT e.*, near.tmc AS found, near.d2 AS d2, near.qx, near.qy, near.t, row_number() OVER (PARTITION BY e.ID ORDER BY near.d2, near.tmc) AS rn
        FROM searched e LEFT JOIN (
            SELECT ID, tmc, t, ax + t * vx AS qx, ay + t * vy AS qy, (px - (ax + t * vx)) * (px - (ax + t * vx)) + (py - (ay + t * vy)) * (py - (ay + t * vy)) AS d2 FROM (
                SELECT *, greatest(0.0, least(1.0, ((px - ax) * vx + (py - ay) * vy) / CASE WHEN vx * vx + vy * vy = 0 THEN 1e-12 ELSE vx * vx + vy * vy END)) AS t FROM (
                    SELECT e.ID, s.tmc, e.Longitude * k AS px, e.Latitude * 110540.0 AS py, s.start_longitude * k AS ax, s.start_latitude * 110540.0 AS ay,
                           s.end_longitude * k - s.start_longitude * k AS vx, s.end_latitude * 110540.0 - s.start_latitude * 110540.0 AS vy
                    FROM searched e CROSS JOIN scale JOIN segments s ON e.wanted IS NULL OR contains(s.direction, e.wanted)
                    WHERE e.Latitude IS NOT NULL AND e.Longitude IS NOT NULL))) near ON near.ID = e.ID) WHERE rn = 1"""
SEARCHED = """
    SELECT *, CASE lower(dir) WHEN 'east' THEN 'EASTBOUND' WHEN 'west' THEN 'WESTBOUND' WHEN 'north' THEN 'NORTHBOUND' WHEN 'south' THEN 'SOUTHBOUND' END AS wanted
    FROM (SELECT *, CASE WHEN lower(DirectionOfTravel) = 'unknown'
                 THEN coalesce(nullif(lower(regexp_extract(RoadwayName, '(?i)(west|east|south|north)', 1)), ''), 'unknown')
                 ELSE DirectionOfTravel END AS dir FROM windowed_source)"""
SCALE = "SELECT 111320.0 * cos(radians(avg(Latitude))) AS k FROM windowed_source WHERE Latitude IS NOT NULL AND Longitude IS NOT NULL"

FEATURE_COLUMNS = (
    "tmc_code time_bin speed travel_time_seconds reference_speed evt_cat_unplanned evt_cat_planned evt_total lag1 lag2 lag3 miles "
    "onramp offramp curve hour_sin hour_cos dow_sin dow_cos hour_of_week hour_of_week_sin hour_of_week_cos is_weekend tt_per_mile "
    "lag1_tt_per_mile lag2_tt_per_mile lag3_tt_per_mile speed_ratio"
).split()


@query("e1_feature_table", f"""
    WITH windowed_source AS (SELECT * FROM utc_events), searched AS ({SEARCHED}), scale AS ({SCALE}), nearest AS ({NEAREST}),
    spans AS (
        SELECT found AS tmc, event_start, coalesce(event_stop, event_start) AS event_end, planned FROM (
            SELECT found, EventSubType IS NOT DISTINCT FROM 'leftlanes' AS planned,
                   CASE WHEN EventType IN ('closures', 'roadwork') THEN StartDate WHEN EventType = 'accidentsAndIncidents' THEN Reported END AS event_start,
                   CASE WHEN EventType IN ('closures', 'roadwork') THEN PlannedEndDate WHEN EventType = 'accidentsAndIncidents' THEN LastUpdated END AS event_stop
            FROM nearest) WHERE event_start IS NOT NULL AND found IS NOT NULL),
    counts AS (
        SELECT c.tmc_code, c.time_bin, CAST(count(*) FILTER (WHERE NOT planned) AS INTEGER) AS evt_cat_unplanned,
               CAST(count(*) FILTER (WHERE planned) AS INTEGER) AS evt_cat_planned
        FROM cells c LEFT JOIN spans w ON w.tmc = c.tmc_code AND c.time_bin < w.event_end AND c.time_bin + INTERVAL 1 HOUR > w.event_start
        GROUP BY 1, 2)
    SELECT f.* REPLACE (c.evt_cat_unplanned AS evt_cat_unplanned, c.evt_cat_planned AS evt_cat_planned,
                        c.evt_cat_unplanned + c.evt_cat_planned AS evt_total, 0 AS onramp, 0 AS offramp, 0 AS curve)
    FROM features f JOIN counts c ON c.tmc_code = f.tmc_code AND c.time_bin = f.time_bin""", "features utc_events", FEATURE_NUMBERS)
def e1(fx: Fixtures) -> DataFrame:
    """Raw events, segments and readings to the finished feature table."""
    events = fx.utc_events.drop("near_tmc")
    segments = fx.segments.withColumn("active_start_date", F.lit(None).cast("timestamp"))
    table = build_feature_table(events, segments, fx.readings)
    return table.select(*FEATURE_COLUMNS)


@query("e1_dense_features", "SELECT * FROM features", "features", FEATURE_NUMBERS)
def e1_dense(fx: Fixtures) -> DataFrame:
    """The part of the feature table after event matching."""
    return fx.features.select(*FEATURE_COLUMNS)


@query("e1_dense_features_blocks", "SELECT * FROM features", "features", FEATURE_NUMBERS)
def e1_blocks(fx: Fixtures) -> DataFrame:
    """The same cut into small blocks, as long time axes are."""
    return dense_features(fx.binned, fx.windowed, fx.tagged_segments, block_rows=50).select(*FEATURE_COLUMNS)


@query("j06_add_manual_tags", "SELECT s.tmc, t.onramp, t.offramp, t.curve FROM segments s LEFT JOIN tags t ON t.tmc = s.tmc", "segments tags")
def j06(fx: Fixtures) -> DataFrame:
    tagged = joins.add_manual_tags(fx.segments, fx.tags)
    return tagged.select("tmc", *[F.try_element_at("tmc_tags", F.lit(t)).alias(t) for t in ("onramp", "offramp", "curve")])
