"""Window-style operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from laneflow.catalog.fixtures import Fixtures
from laneflow.catalog.registry import query
from laneflow.operators import grid, windows as W
from laneflow.operators.ordering import POS

CUT = """
    (SELECT time_bin FROM (SELECT time_bin, row_number() OVER (ORDER BY time_bin) - 1 AS pos, count(*) OVER () AS n
     FROM (SELECT DISTINCT time_bin FROM {table})) WHERE pos = CAST(floor(n * CAST({ratio} AS DOUBLE)) AS BIGINT){back})"""


@query("w01_add_lags", """
    SELECT tmc_code, time_bin, travel_time_seconds, lag1, lag2, lag3 FROM lagged WHERE lag3 IS NOT NULL""", "lagged", "travel_time_seconds lag1 lag2 lag3")
def w01(fx: Fixtures) -> DataFrame:
    filled = grid.interpolate_linear(grid.densify_grid(fx.binned), ["travel_time_seconds"])
    return W.add_lags(filled).select("tmc_code", "time_bin", "travel_time_seconds", "lag1", "lag2", "lag3")


@query("w01_add_lags_sparse", """
    SELECT * FROM (SELECT tmc_code, time_bin, speed, lag(speed, 1) OVER w AS prev1, lag(speed, 24) OVER w AS prev24
    FROM binned WINDOW w AS (PARTITION BY tmc_code ORDER BY time_bin)) WHERE prev24 IS NOT NULL""", "binned", "speed prev1 prev24")
def w01_sparse(fx: Fixtures) -> DataFrame:
    """Row-based lags on the binned table, where hours are missing; tiny blocks exercise the halo."""
    lagged = W.add_lags(fx.binned, "speed", (1, 24), prefix="prev", block_rows=16)
    return lagged.select("tmc_code", "time_bin", "speed", "prev1", "prev24")


@query("w02_interpolate_linear", "SELECT tmc_code, time_bin, speed, travel_time_seconds, reference_speed FROM filled", "filled",
       "speed travel_time_seconds reference_speed")
def w02(fx: Fixtures) -> DataFrame:
    return grid.interpolate_linear(grid.densify_grid(fx.binned), grid.MEASURES, block_rows=100).drop(POS)


@query("w03_latest_per_key", """
    SELECT tmc, active_start_date, road, miles FROM (SELECT *, row_number() OVER (PARTITION BY tmc ORDER BY active_start_date DESC NULLS LAST, road_order DESC) AS rn
    FROM segment_versions) WHERE rn = 1""", "segment_versions", "miles")
def w03(fx: Fixtures) -> DataFrame:
    return W.latest_per_key(fx.segment_versions, "tmc", "active_start_date", ["road_order"]).select("tmc", "active_start_date", "road", "miles")


@query("w04_buffer_mask", """
    SELECT tmc_code, time_bin, max(CAST(evt_cat_planned > 0 AS INTEGER)) OVER (PARTITION BY tmc_code ORDER BY time_bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 AS near_planned
    FROM event_counts""", "event_counts")
def w04(fx: Fixtures) -> DataFrame:
    from laneflow.operators.intervals import interval_overlap_counts

    counts = interval_overlap_counts(grid.densify_grid(fx.binned), fx.windowed, times=fx.binned)
    return W.buffer_mask(counts, F.col("evt_cat_planned") > 0, 3, "near_planned", block_rows=64).select("tmc_code", "time_bin", "near_planned")


@query("w05_sliding_sequences", """
    SELECT tmc_code, time_bin, y, CAST(6 AS INTEGER) AS steps, l6 AS first_speed, l1 AS last_speed, p6 AS first_travel, s AS sum_speed FROM (
        SELECT tmc_code, time_bin, travel_time_seconds AS y, row_number() OVER w - 1 AS pos, lag(speed, 6) OVER w AS l6, lag(speed, 1) OVER w AS l1,
               lag(travel_time_seconds, 6) OVER w AS p6, sum(speed) OVER (PARTITION BY tmc_code ORDER BY time_bin ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS s
        FROM binned WINDOW w AS (PARTITION BY tmc_code ORDER BY time_bin)) WHERE pos >= 6 AND (pos - 6) % 2 = 0""",
    "binned", "y first_speed last_speed first_travel sum_speed")
def w05(fx: Fixtures) -> DataFrame:
    """Sequences of six rows with stride two; the nested array is summed up for comparison."""
    rows = W.sliding_sequences(fx.binned, ["speed", "travel_time_seconds"], "travel_time_seconds", 6, 2, block_rows=32)
    return rows.select(
        "tmc_code", "time_bin", "y", F.size("x").alias("steps"), F.col("x")[0][0].alias("first_speed"), F.col("x")[5][0].alias("last_speed"),
        F.col("x")[0][1].alias("first_travel"), F.aggregate("x", F.lit(0.0), lambda acc, step: acc + step[0]).alias("sum_speed"),
    )


@query("w06_chronological_split_per_key", """
    SELECT tmc_code, time_bin, CASE WHEN rn > n - greatest(1, CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT)) THEN 'test' ELSE 'train' END AS split FROM (
        SELECT tmc_code, time_bin, row_number() OVER (PARTITION BY tmc_code ORDER BY time_bin) AS rn, count(*) OVER (PARTITION BY tmc_code) AS n FROM binned)""", "binned")
def w06(fx: Fixtures) -> DataFrame:
    return W.chronological_split_per_key(fx.binned.select("tmc_code", "time_bin"), 0.2)


@query("w07_chronological_split", f"""
    SELECT tmc_code, time_bin, CASE WHEN time_bin < {CUT.format(table='binned', ratio='0.8', back='')} THEN 'train' ELSE 'test' END AS split FROM binned""", "binned")
def w07(fx: Fixtures) -> DataFrame:
    return W.chronological_split(fx.binned.select("tmc_code", "time_bin"), 0.2)


@query("w08_best_per_group", """
    SELECT tmc_code, hour, speed_mean FROM (SELECT *, row_number() OVER (PARTITION BY tmc_code ORDER BY speed_mean, hour) AS rn FROM hourly) WHERE rn = 1""",
    "hourly", "speed_mean")
def w08(fx: Fixtures) -> DataFrame:
    return W.best_per_group(fx.hourly.select("tmc_code", "hour", "speed_mean"), ["tmc_code"], "speed_mean", ["hour"])


CHAIN = """
    SELECT direction, tmc, miles, row_number() OVER (PARTITION BY direction ORDER BY start_longitude, tmc) - 1 AS pos FROM segments"""


@query("w09_chain_edges", f"""
    SELECT * FROM (SELECT direction, tmc AS src, lead(tmc) OVER (PARTITION BY direction ORDER BY pos) AS dst, pos AS src_id, pos + 1 AS dst_id FROM ({CHAIN}))
    WHERE dst IS NOT NULL""", "segments")
def w09(fx: Fixtures) -> DataFrame:
    return W.chain_edges(fx.segments, "direction", "start_longitude", "tmc", check=False)


@query("w10_cumulative_length", f"""
    SELECT direction, tmc, sum(coalesce(CASE WHEN pos % 10 <> 0 THEN miles END, 0.01)) OVER (PARTITION BY direction ORDER BY pos) AS cumulative_miles FROM ({CHAIN})""",
    "segments", "cumulative_miles")
def w10(fx: Fixtures) -> DataFrame:
    """Running miles, every tenth length unknown."""
    chain = W.with_chain_position(fx.segments, "direction", "start_longitude", "tmc")
    holed = chain.withColumn("miles", F.when(F.col(POS) % 10 != 0, F.col("miles")))
    return W.cumulative_length(holed, "direction").select("direction", "tmc", "cumulative_miles")


@query("w11_every_nth_frame", """
    SELECT hour FROM (SELECT hour, row_number() OVER (ORDER BY hour) - 1 AS pos FROM (SELECT DISTINCT hour FROM hourly)) WHERE pos % 5 = 0 AND pos < 5 * 60""", "hourly")
def w11(fx: Fixtures) -> DataFrame:
    return W.every_nth_frame(fx.hourly, "hour", 5, 60)


RATE = "SELECT time_bin, avg(speed) AS mean_speed, row_number() OVER (ORDER BY time_bin) - 1 AS pos, count(*) OVER () AS n FROM binned GROUP BY 1"


@query("w12_shift_circular", f"""
    WITH rate AS ({RATE}) SELECT l.lag, b.time_bin, b.mean_speed, a.mean_speed AS shifted
    FROM rate b CROSS JOIN (SELECT CAST(unnest(range(-6, 7)) AS INTEGER) AS lag) l JOIN rate a ON a.pos = (b.pos - l.lag + b.n) % b.n""", "binned", "mean_speed shifted")
def w12(fx: Fixtures) -> DataFrame:
    rate = fx.binned.groupBy("time_bin").agg(F.avg("speed").alias("mean_speed"))
    return W.shift_circular(rate, "mean_speed", list(range(-6, 7))).select("lag", "time_bin", "mean_speed", "shifted")


@query("w12_shift_plain", """
    SELECT tmc_code, time_bin, lag(speed, 2) OVER w AS shift_2, speed AS shift_0, lead(speed, 3) OVER w AS shift_m3 FROM binned
    WINDOW w AS (PARTITION BY tmc_code ORDER BY time_bin)""", "binned", "shift_2 shift_0 shift_m3")
def w12_plain(fx: Fixtures) -> DataFrame:
    return W.shift_plain(fx.binned, "speed", [2, 0, -3], block_rows=16).select("tmc_code", "time_bin", "shift_2", "shift_0", "shift_m3")


@query("w13_align_predictions", """
    SELECT c.tmc_code, c.time_bin, CASE WHEN c.pos >= 24 THEN p.y_pred END AS y_pred FROM cells c
    LEFT JOIN predictions p ON p.tmc_code = c.tmc_code AND p.time_bin = c.time_bin AND p.model = 'last'""", "cells predictions", "y_pred")
def w13(fx: Fixtures) -> DataFrame:
    """Predictions that start after a warm-up of 24 bins, on the full timeline."""

    spine = grid.densify_grid(fx.binned).select("tmc_code", "time_bin", POS)
    warm = spine.where(F.col(POS) >= 24).select("tmc_code", "time_bin")
    late = fx.predictions.where("model = 'last'").join(warm, ["tmc_code", "time_bin"], "left_semi")
    return W.align_predictions(spine, late.select("tmc_code", "time_bin", "y_pred"))


@query("w14_add_seasonal_difference", """
    SELECT tmc_code, time_bin, speed - lag(speed, 24) OVER (PARTITION BY tmc_code ORDER BY time_bin) AS sdiff FROM filled""", "filled", "sdiff")
def w14(fx: Fixtures) -> DataFrame:
    filled = grid.interpolate_linear(grid.densify_grid(fx.binned), ["speed"])
    return W.add_seasonal_difference(filled, "speed", 24, "sdiff", block_rows=100).select("tmc_code", "time_bin", "sdiff")


@query("w15_tail_validation_split", """
    SELECT tmc_code, time_bin, CASE WHEN pos >= n - greatest(1, CAST(floor(CAST(0.2 AS DOUBLE) * n) AS BIGINT)) THEN 'validation' ELSE 'train' END AS part FROM (
        SELECT tmc_code, time_bin, row_number() OVER (ORDER BY time_bin, tmc_code) - 1 AS pos, count(*) OVER () AS n FROM binned)""", "binned")
def w15(fx: Fixtures) -> DataFrame:
    return W.tail_validation_split(fx.binned.select("tmc_code", "time_bin"), 0.2)


@query("w15_overlap_validation_split", """
    WITH bins AS (SELECT time_bin, row_number() OVER (ORDER BY time_bin) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT time_bin FROM binned)),
    rows AS (SELECT b.tmc_code, b.time_bin, pos, CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT) AS cut FROM binned b JOIN bins USING (time_bin))
    SELECT 'train' AS part, tmc_code, time_bin FROM rows WHERE pos < cut UNION ALL SELECT 'validation', tmc_code, time_bin FROM rows WHERE pos >= cut - 24""", "binned")
def w15_overlap(fx: Fixtures) -> DataFrame:
    train, validation = W.overlap_validation_split(fx.binned.select("tmc_code", "time_bin"), 24, 0.1)
    mark = lambda df, name: df.select(F.lit(name).alias("part"), "tmc_code", "time_bin")
    return mark(train, "train").unionByName(mark(validation, "validation"))
