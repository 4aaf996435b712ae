"""Polled feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from laneflow.catalog.fixtures import Fixtures
from laneflow.catalog.registry import query
from laneflow.session import shared_dir
from laneflow.streaming import feeds


@query("r01_upsert_snapshots", """
    SELECT id, arg_max(payload, poll) AS payload, min(poll) AS first_seen, max(poll) AS last_seen, count(DISTINCT poll) AS n_polls FROM snapshots GROUP BY 1""",
    "snapshots", "payload")
def r01(fx: Fixtures) -> DataFrame:
    return feeds.upsert_snapshots(fx.snapshots)


@query("r01_poll_counts", """
    SELECT poll, inserted, changed, unchanged, CAST(sum(inserted) OVER (ORDER BY poll) AS BIGINT) AS total FROM (
        SELECT poll, count(*) FILTER (WHERE rn = 1) AS inserted, count(*) FILTER (WHERE rn > 1 AND prev IS DISTINCT FROM payload) AS changed,
               count(*) FILTER (WHERE rn > 1 AND prev IS NOT DISTINCT FROM payload) AS unchanged
        FROM (SELECT *, row_number() OVER w AS rn, lag(payload) OVER w AS prev FROM (SELECT id, poll, CAST(floor(payload / 40) AS BIGINT) AS payload FROM snapshots)
              WINDOW w AS (PARTITION BY id ORDER BY poll)) GROUP BY 1)""", "snapshots")
def r01_counts(fx: Fixtures) -> DataFrame:
    return feeds.poll_counts(fx.snapshots.withColumn("payload", F.floor(F.col("payload") / 40)))


@query("r02_stream_upsert", "SELECT id, poll, payload FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY poll DESC) AS rn FROM snapshots) WHERE rn = 1",
       "snapshots", "payload")
def r02(fx: Fixtures) -> DataFrame:
    """Snapshots written in four files, streamed one file per batch into the store."""
    folder = shared_dir(fx.spark, "upserts")
    fx.snapshots.repartition(4, "poll").write.parquet(f"{folder}/in")
    stream = fx.spark.readStream.schema(fx.snapshots.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    feeds.stream_upsert(stream, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return feeds.current_state(fx.spark, f"{folder}/log").select("id", "poll", "payload")


@query("r03_stream_bin_readings", """
    SELECT tmc_code, time_bucket(INTERVAL 6 HOUR, measurement_tstamp) AS time_bin, avg(speed) AS speed, avg(travel_time_seconds) AS travel_time_seconds,
           avg(reference_speed) AS reference_speed, count(*) AS n,
           time_bucket(INTERVAL 6 HOUR, measurement_tstamp) + INTERVAL 6 HOUR <= (SELECT max(measurement_tstamp) - INTERVAL 2 HOUR FROM readings) AS is_final
    FROM readings GROUP BY 1, 2""", "readings", "speed travel_time_seconds reference_speed")
def r03(fx: Fixtures) -> DataFrame:
    """Readings streamed into six-hour bins: final ones past the watermark, the open ones as they stand."""
    folder = shared_dir(fx.spark, "binned")
    raw = fx.spark.readStream.schema(fx.table("events").schema).parquet(f"{fx.sf_dir}/events*.parquet")
    readings = raw.select(
        F.concat(F.lit("S"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("tmc_code"), F.col("ts").alias("measurement_tstamp"),
        F.col("value").alias("speed"), (F.col("value") + 10).alias("travel_time_seconds"), F.lit(60.0).alias("reference_speed"),
    )
    feeds.write_binned(feeds.stream_bin_readings(readings, "6h"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return feeds.current_bins(fx.spark, f"{folder}/out", "6h", "2h")


def _log_lines(fx: Fixtures) -> DataFrame:
    """A synthetic poll log with one line per poll and a failure every so often."""
    counts = fx.snapshots.groupBy("poll").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("payload")).cast("bigint").alias("total"))
    hour = F.hour("poll")
    good = F.concat(
        F.lit("["), F.date_format("poll", "yyyy-MM-dd HH:mm:ss"), F.lit("] Updated+Inserted: "), F.col("n").cast("string"), F.lit(", total: "),
        F.col("total").cast("string"), F.lit(" events in database"),
    )
    bad = F.array(F.lit("Error fetching data: connection refused"), F.lit("No valid events data received"))
    return counts.select(F.explode(F.when((hour == 9) & (F.dayofmonth("poll") % 7 == 0), bad).otherwise(F.array(good))).alias("value"))


@query("r04_poll_health", """
    WITH counts AS (SELECT poll, count(*) AS n, CAST(sum(floor(payload)) AS BIGINT) AS total FROM snapshots GROUP BY 1),
    good AS (SELECT *, epoch(poll - lag(poll) OVER (ORDER BY poll)) / CAST(3600 AS DOUBLE) AS gap FROM counts WHERE NOT (hour(poll) = 9 AND day(poll) % 7 = 0))
    SELECT count(*) AS polls, avg(n) AS mean_upserts, CAST(max(n) AS INTEGER) AS max_upserts, CAST(sum(greatest(round(gap / 3) - 1, 0)) AS BIGINT) AS missed_polls, max(gap) AS longest_gap_hours,
           (SELECT count(*) FROM counts WHERE hour(poll) = 9 AND day(poll) % 7 = 0) AS fetch_errors, (SELECT count(*) FROM counts WHERE hour(poll) = 9 AND day(poll) % 7 = 0) AS no_data
    FROM good""", "snapshots", "mean_upserts longest_gap_hours")
def r04(fx: Fixtures) -> DataFrame:
    path = shared_dir(fx.spark, "poll-log")
    _log_lines(fx).write.text(path)
    return feeds.poll_health(feeds.parse_poll_log(fx.spark.read.text(path)))
