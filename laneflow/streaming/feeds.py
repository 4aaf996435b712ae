"""Polled snapshot feeds: batch and streaming upserts, streamed binning, poll health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from laneflow.functions.columns import interval_seconds
from laneflow.operators.ordering import POS, blocked_window, running_sums, with_position
from laneflow.streaming.upserts import compact_log, current_state, latest_rows, write_upserts

__all__ = [
    "compact_log", "current_bins", "current_state", "latest_rows", "parse_poll_log", "poll_counts", "poll_gaps", "poll_health",
    "stream_bin_readings", "stream_upsert", "upsert_snapshots", "write_binned", "write_upserts",
]


def upsert_snapshots(polls: DataFrame, key: str = "id", poll: str = "poll", payload: str = "payload") -> DataFrame:
    """Current row per id with when it was first and last seen."""
    return polls.groupBy(key).agg(
        F.max(F.struct(poll, payload)).getField(payload).alias(payload),
        F.min(poll).alias("first_seen"), F.max(poll).alias("last_seen"), F.count_distinct(poll).alias("n_polls"),
    )


def poll_counts(polls: DataFrame, key: str = "id", poll: str = "poll", payload: str = "payload") -> DataFrame:
    """Per poll: rows inserted, changed and unchanged, and the table size after it."""
    once = polls.groupBy(key, poll).agg(F.max(payload).alias(payload))
    placed = with_position(once, poll, [key], chunk="30d")
    seen = blocked_window(
        placed, lambda w: {"__before": F.lag(F.struct(payload), 1).over(w)}, before=1, after=0, keys=[key],
    )
    new = F.col(POS) == 0
    changed = ~new & ~F.col("__before").getField(payload).eqNullSafe(F.col(payload))
    counts = seen.groupBy(poll).agg(
        F.count_if(new).alias("inserted"), F.count_if(changed).alias("changed"), F.count_if(~new & ~changed).alias("unchanged")
    )
    summed = running_sums(with_position(counts, poll), ["inserted"], [], POS)
    return summed.select(poll, "inserted", "changed", "unchanged", F.col("__run_inserted").alias("total"))


def stream_upsert(
    stream: DataFrame, path: str, checkpoint: str, key: str = "id", poll: str = "poll", **trigger
) -> StreamingQuery:
    """Upsert a stream of snapshots into the store at ``path``."""
    writer = stream.writeStream.foreachBatch(lambda batch, n: write_upserts(batch, n, path, key, poll))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_bin_readings(
    stream: DataFrame, interval: str = "1h", lateness: str = "2 hours", time_col: str = "measurement_tstamp",
    key: str = "tmc_code",
) -> DataFrame:
    """Means per segment and bin of a stream, with the bin's newest reading.

    State is one running mean per open (segment, bin).  Readings of bins that the
    watermark has passed come too late and are dropped.
    """
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, lateness)
    measures = [c for c in ("speed", "travel_time_seconds", "reference_speed") if c in stream.columns]
    window = F.window(time_col, f"{interval_seconds(interval)} seconds")
    binned = timed.groupBy(window, key).agg(*[F.avg(c).alias(c) for c in measures], F.count(F.lit(1)).alias("n"), F.max(time_col).alias("last_reading"))
    return binned.select(key, F.col("window.start").alias("time_bin"), *measures, "n", "last_reading")


def write_binned(binned: DataFrame, path: str, checkpoint: str, key: str = "tmc_code", **trigger) -> StreamingQuery:
    """Keep the newest state of every bin at ``path``, of open ones too.

    Each micro-batch brings the bins it changed, whole; they replace what the
    store held of them.  Read them with :func:`current_bins`.
    """
    def store(batch: DataFrame, n: int) -> None:
        write_upserts(batch.withColumn("__batch", F.lit(n).cast("long")), n, path, [key, "time_bin"], "__batch")

    writer = binned.writeStream.outputMode("update").foreachBatch(store)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_bins(spark: SparkSession, path: str, interval: str = "1h", lateness: str = "2h", key: str = "tmc_code") -> DataFrame:
    """All bins; ``is_final`` tells those that no reading can change any more, the others are provisional."""
    bins = current_state(spark, path, [key, "time_bin"], "__batch").drop("__batch")
    newest = bins.agg(F.max("last_reading")).scalar()
    ends = F.unix_micros("time_bin") + interval_seconds(interval) * 1_000_000
    final = ends <= F.unix_micros(newest) - interval_seconds(lateness) * 1_000_000
    return bins.withColumn("is_final", final).drop("last_reading")


def parse_poll_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Poll lines ``[time] Updated+Inserted: N, total: M …`` and failure lines.

    Only the kind of a failure is kept, never its text, which may hold addresses or keys.
    """
    text = F.col(column)
    pattern = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] Updated\+Inserted: (\d+), total: (\d+)"
    kind = (
        F.when(text.rlike(pattern), "poll").when(text.startswith("Error fetching"), "fetch_error")
        .when(text.startswith("No valid events"), "no_data").otherwise("other")
    )
    return lines.select(
        kind.alias("kind"), F.try_to_timestamp(F.regexp_extract(text, pattern, 1)).alias("poll_time"),
        F.regexp_extract(text, pattern, 2).try_cast("int").alias("upserts"),
        F.regexp_extract(text, pattern, 3).try_cast("int").alias("total"),
    )


def poll_gaps(log: DataFrame, expected: str = "3h") -> DataFrame:
    """Gap before each poll, polls missed in it, and growth of the table."""
    polls = log.where("kind = 'poll'").select("poll_time", "upserts", "total")
    placed = with_position(polls, "poll_time", tiebreak=["total"])
    seen = blocked_window(
        placed,
        lambda w: {"__prev": F.lag("poll_time").over(w), "__size": F.lag("total").over(w)}, before=1, after=0, keys=[],
    )
    hours = (F.unix_micros("poll_time") - F.unix_micros("__prev")) / 3_600_000_000.0
    missed = F.greatest(F.round(hours * 3600 / interval_seconds(expected)).cast("int") - 1, F.lit(0))
    return seen.select(
        "poll_time", "upserts", "total", hours.alias("gap_hours"), missed.alias("missed_polls"),
        (F.col("total") - F.col("__size")).alias("new_events"),
    )


def poll_health(log: DataFrame, expected: str = "3h") -> DataFrame:
    """One row: polls, failures by kind, missed polls, upsert mean and maximum."""
    kinds = log.agg(
        F.struct(F.count_if(F.col("kind") == "fetch_error").alias("e"), F.count_if(F.col("kind") == "no_data").alias("n"))
    ).scalar()
    return poll_gaps(log, expected).agg(
        F.count(F.lit(1)).alias("polls"), F.avg("upserts").alias("mean_upserts"), F.max("upserts").alias("max_upserts"),
        F.sum("missed_polls").alias("missed_polls"), F.max("gap_hours").alias("longest_gap_hours"),
        kinds.getField("e").alias("fetch_errors"), kinds.getField("n").alias("no_data"),
    )
