"""Sorts, limits and top-k (T01–T06); set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from laneflow.catalog.fixtures import Fixtures
from laneflow.catalog.q_aggregates import DAY, DROPS, HOURS
from laneflow.catalog.registry import query
from laneflow.operators import aggregates as A, reshape as R, topk
from laneflow.operators.windows import chronological_split


@query("t01_top_k_hours", f"""
    SELECT hour, n FROM ({HOURS}) ORDER BY n DESC, hour LIMIT 3""", "road_events")
def t01(fx: Fixtures) -> DataFrame:
    return topk.top_k_hours(A.hour_of_day_counts(A.incidents(fx.road_events))).select("hour", "n")


@query("t02_worst_segments", f"""
    SELECT tmc, peak_speed_drop, road || ' ' || direction || ' (' || tmc || ')' AS segment_label, abs(peak_speed_drop) AS speed_reduction FROM ({DROPS})
    WHERE peak_speed_drop IS NOT NULL ORDER BY peak_speed_drop, tmc LIMIT 15""", "hourly_calendar", "peak_speed_drop speed_reduction")
def t02(fx: Fixtures) -> DataFrame:
    worst = topk.worst_segments(A.peak_offpeak_drop(fx.hourly_calendar))
    return worst.select("tmc", "peak_speed_drop", "segment_label", "speed_reduction")


JOINED_FLOW = "(SELECT f.*, s.frc FROM flow f JOIN flow_segments s ON s.segment_id = f.segment_id WHERE s.frc IN ({classes}))"


@query("t03_priority_sort_limit", f"""
    SELECT id, frc, timestamp FROM {JOINED_FLOW.format(classes="'FRC2', 'FRC5', 'FRC6'")}
    ORDER BY CAST(substr(frc, 4, 1) AS INTEGER), timestamp DESC, id LIMIT 1000""", "flow flow_segments")
def t03(fx: Fixtures) -> DataFrame:
    classes = ["FRC2", "FRC5", "FRC6"]
    rows = fx.flow.join(fx.flow_segments, "segment_id").where(F.col("frc").isin(classes))
    return topk.priority_sort_limit(rows, classes, local_limit=1000).select("id", "frc", "timestamp")


@query("t03_explicit_limit", f"""
    SELECT id, frc, timestamp FROM {JOINED_FLOW.format(classes="'FRC0', 'FRC1'")} ORDER BY CAST(substr(frc, 4, 1) AS INTEGER), timestamp DESC, id LIMIT 250""",
    "flow flow_segments")
def t03_limit(fx: Fixtures) -> DataFrame:
    rows = fx.flow.join(fx.flow_segments, "segment_id").where(F.col("frc").isin("FRC0", "FRC1"))
    return topk.priority_sort_limit(rows, ["FRC0", "FRC1"], 250).select("id", "frc", "timestamp")


@query("t04_top_features", """
    SELECT model, feature, score, CAST(rn AS INTEGER) AS rank FROM (
        SELECT model, feature, score, row_number() OVER (PARTITION BY model ORDER BY abs(score) DESC, feature) AS rn FROM (
            SELECT o_orderpriority AS model, 'c' || (o_custkey % 17) AS feature, avg(o_totalprice) - 250000 AS score FROM orders GROUP BY 1, 2)) WHERE rn <= 10""", "", "score")
def t04(fx: Fixtures) -> DataFrame:
    scores = fx.table("orders").groupBy(
        F.col("o_orderpriority").alias("model"), F.concat(F.lit("c"), (F.col("o_custkey") % 17).cast("string")).alias("feature")
    ).agg((F.avg("o_totalprice") - 250_000).alias("score"))
    return topk.top_features(scores)


@query("t05_order_segments", """
    SELECT tmc, CAST(row_number() OVER (ORDER BY start_longitude DESC NULLS LAST, tmc) - 1 AS INTEGER) AS position FROM segments WHERE direction = 'WESTBOUND'""", "segments")
def t05(fx: Fixtures) -> DataFrame:
    return topk.segment_positions(fx.segments.where("direction = 'WESTBOUND'"), "W")


@query("t06_rank_models", """
    SELECT model, rmse, cv_rmse_mean, CAST(row_number() OVER (ORDER BY cv_rmse_mean, model) AS INTEGER) AS place FROM (
        SELECT o_orderpriority AS model, avg(o_totalprice) AS rmse, stddev_samp(o_totalprice) AS cv_rmse_mean FROM orders GROUP BY 1)""", "", "rmse cv_rmse_mean")
def t06(fx: Fixtures) -> DataFrame:
    metrics = fx.table("orders").groupBy(F.col("o_orderpriority").alias("model")).agg(
        F.avg("o_totalprice").alias("rmse"), F.stddev_samp("o_totalprice").alias("cv_rmse_mean")
    )
    return topk.rank_models(metrics, "place")


@query("u01_union_all", "SELECT tmc_code, hour FROM hourly WHERE speed_mean > 90 UNION ALL SELECT tmc_code, hour FROM hourly WHERE speed_mean > 80", "hourly")
def u01(fx: Fixtures) -> DataFrame:
    slow = fx.hourly.where("speed_mean > 90").select("tmc_code", "hour")
    return R.union_all(slow, fx.hourly.where("speed_mean > 80").select("hour", "tmc_code"))


@query("u02_union_sources", """
    SELECT ID, NULL AS segment_id, EventType, RoadwayName, Severity, Description,
           CASE WHEN StartDate IS NOT NULL THEN make_timestamp((StartDate - 25200) * 1000000) END AS StartDate, Latitude, 'AZ511' AS data_source FROM road_events
    UNION ALL
    SELECT NULL, f.segment_id, 'traffic_flow', coalesce(frc || ' Road', 'Unknown Road'),
           CASE WHEN confidence IS NULL THEN 'N/A' ELSE 'Confidence: ' || printf('%.2f', confidence) END,
           'Traffic Flow (' || frc || ') - Speed: ' || printf('%.1f', currentSpeed) || '/' || printf('%.1f', freeFlowSpeed) || ' mph',
           make_timestamp(timestamp * 1000000), coordinate_lat, 'TomTom'
    FROM flow f JOIN flow_segments s ON s.segment_id = f.segment_id WHERE frc IN ('FRC0', 'FRC1')""", "road_events flow flow_segments", "Latitude")
def u02(fx: Fixtures) -> DataFrame:
    flow = fx.flow.join(fx.flow_segments, "segment_id").where(F.col("frc").isin("FRC0", "FRC1")).drop("id")
    both = R.union_sources(fx.road_events.drop("near_tmc"), flow)
    return both.select("ID", "segment_id", "EventType", "RoadwayName", "Severity", "Description", "StartDate", "Latitude", "data_source")


@query("u03_distinct_values", "SELECT DISTINCT intersection FROM segments", "segments")
def u03(fx: Fixtures) -> DataFrame:
    return R.distinct_values(fx.segments, "intersection")


@query("u04_unpivot_metrics", """
    SELECT model_feat, CASE split_part(model_feat, '_', 1) WHEN 'lr' THEN 'Linear Regression' WHEN 'rf' THEN 'Random Forest' ELSE 'XGBoost' END AS model,
           CASE substr(model_feat, strpos(model_feat, '_') + 1) WHEN 'base' THEN 'road' WHEN 'cyc_lags' THEN 'road + cyc + lag' WHEN 'full' THEN 'full' ELSE 'other' END AS features,
           dataset, rmse
    FROM (SELECT model_feat, unnest(['cv_rmse', 'rmse']) AS dataset, unnest([cv, mean]) AS rmse FROM (
        SELECT ['lr', 'rf', 'xgb'][1 + o_custkey % 3] || '_' || ['base', 'cyc_lags', 'full', 'other'][1 + o_orderkey % 4] AS model_feat,
               stddev_samp(o_totalprice) AS cv, avg(o_totalprice) AS mean FROM orders GROUP BY 1))""", "", "rmse")
def u04(fx: Fixtures) -> DataFrame:
    family = F.element_at(F.array(F.lit("lr"), F.lit("rf"), F.lit("xgb")), (F.col("o_custkey") % 3 + 1).cast("int"))
    features = F.element_at(F.array(*[F.lit(x) for x in ("base", "cyc_lags", "full", "other")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    metrics = fx.table("orders").groupBy(F.concat(family, F.lit("_"), features).alias("model_feat")).agg(
        F.stddev_samp("o_totalprice").alias("cv_rmse"), F.avg("o_totalprice").alias("rmse")
    )
    return R.unpivot_metrics(metrics.withColumnRenamed("rmse", "mean_"), ["cv_rmse", "mean_"]).replace("mean_", "rmse", "dataset")


def _with_absent(fx: Fixtures) -> DataFrame:
    """All segments, and one that the table lacks, in order."""
    absent = fx.spark.createDataFrame([("S999999",)], "tmc_code string")
    return R.column_places(fx.codes.select("tmc_code").unionByName(absent), "tmc_code")


@query("u05_pivot_long_to_wide", """
    SELECT t.time_bin, string_agg(coalesce(CAST(CAST(round(b.speed * 1000) AS BIGINT) AS VARCHAR), '-'), ',' ORDER BY c.tmc_code) AS cells
    FROM (SELECT DISTINCT time_bin FROM binned) t CROSS JOIN (SELECT DISTINCT tmc_code FROM binned UNION ALL SELECT 'S999999') c
    LEFT JOIN binned b ON b.time_bin = t.time_bin AND b.tmc_code = c.tmc_code GROUP BY 1""", "binned")
def u05(fx: Fixtures) -> DataFrame:
    """All segments, and one that the table lacks, as columns; a row's cells are shown as one text."""
    wide = R.pivot_long_to_wide(fx.binned, "time_bin", "tmc_code", "speed", _with_absent(fx))
    shown = F.transform(R.CELLS, lambda v: F.round(v * 1000).cast("bigint").cast("string"))
    return wide.select("time_bin", F.array_join(shown, ",", "-").alias("cells"))


@query("u05_stack", "SELECT time_bin, tmc_code, speed FROM binned", "binned", "speed")
def u05_stack(fx: Fixtures) -> DataFrame:
    order = _with_absent(fx)
    wide = R.pivot_long_to_wide(fx.binned, "time_bin", "tmc_code", "speed", order)
    return R.stack_wide_to_long(wide, "time_bin", order, "tmc_code", "speed")


@query("u06_concat_split_labelled", """
    SELECT tmc_code, time_bin, CASE WHEN time_bin < (SELECT time_bin FROM (SELECT time_bin, row_number() OVER (ORDER BY time_bin) - 1 AS pos, count(*) OVER () AS n
        FROM (SELECT DISTINCT time_bin FROM binned)) WHERE pos = CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT)) THEN 'Train' ELSE 'Test' END AS split FROM binned""", "binned")
def u06(fx: Fixtures) -> DataFrame:
    split = chronological_split(fx.binned.select("tmc_code", "time_bin"), out="part")
    return R.concat_split_labelled(split.where("part = 'train'").drop("part"), split.where("part = 'test'").drop("part"))


@query("u07_explode_segment_endpoints", f"""
    SELECT point, latitude, longitude, road, direction, speed, speed_category, tmc AS segment_id FROM (
        SELECT unnest([0, 1]) AS point, unnest([start_latitude, end_latitude]) AS latitude, unnest([start_longitude, end_longitude]) AS longitude, road, direction,
               speed_mean AS speed, CASE WHEN speed_mean > 60 THEN '60+' WHEN speed_mean > 50 THEN '50-60' WHEN speed_mean > 40 THEN '40-50'
               WHEN speed_mean > 30 THEN '30-40' WHEN speed_mean > 20 THEN '20-30' ELSE '0-20' END AS speed_category, tmc FROM ({DAY}))""",
    "hourly_calendar", "latitude longitude speed")
def u07(fx: Fixtures) -> DataFrame:
    return R.explode_segment_endpoints(A.segment_day_average(fx.hourly_calendar, "2024-01-09")).drop("segment_label")
