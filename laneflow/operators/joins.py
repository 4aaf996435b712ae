"""Attribute, geometry, membership and alignment joins.

No side is broadcast by hint: Spark broadcasts what its size estimate (or AQE's
run-time size) puts under the threshold and shuffles otherwise, splitting skewed
partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from laneflow.functions.fixed_values import SEGMENT_TAG_ROWS, TAG_COLUMNS
from laneflow.functions.holidays import us_holidays
from laneflow.operators.reshape import CELLS, stack_wide_to_long
from laneflow.schemas import GEOMETRY_COLUMNS

SEGMENT_COLUMNS = ["tmc", "road", "direction", "intersection", *GEOMETRY_COLUMNS]


def segment_tags(spark: SparkSession, rows: list[tuple[str, int, int, int]] = SEGMENT_TAG_ROWS) -> DataFrame:
    return spark.createDataFrame(rows, "tmc string, onramp int, offramp int, curve int")


def add_manual_tags(segments: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Attach the ramp and curve tags of a segment as a map; untagged segments get NULL."""
    table = segment_tags(segments.sparkSession) if tags is None else tags
    pairs = F.create_map(*[x for c in TAG_COLUMNS for x in (F.lit(c), F.col(c))])
    return segments.join(table.select("tmc", pairs.alias("tmc_tags")), "tmc", "left")


def attach_segment_attributes(
    df: DataFrame, segments: DataFrame, tags: list[str] = TAG_COLUMNS, key: str = "tmc_code"
) -> DataFrame:
    """Static miles per segment, and tag columns with 0 for untagged segments."""
    columns = [F.max(F.col("miles").cast("double")).alias("miles")]
    if "tmc_tags" in segments.columns:
        columns += [F.max(F.try_element_at("tmc_tags", F.lit(t))).alias(t) for t in tags]
    else:
        columns += [F.max(t).alias(t) for t in tags]
    static = segments.groupBy(F.col("tmc").alias(key)).agg(*columns)
    joined = df.join(static, key, "left")
    return joined.withColumns({t: F.coalesce(F.col(t), F.lit(0)).cast("int") for t in tags})


def join_readings_geometry(stats: DataFrame, segments: DataFrame) -> DataFrame:
    place = segments.select(*SEGMENT_COLUMNS)
    return stats.join(place, stats["tmc_code"] == place["tmc"], "left")


def join_week_geometry(hourly: DataFrame, segments: DataFrame, year_week: str) -> DataFrame:
    """Weekly mean speed per segment with its geometry; segments without one are dropped."""
    weekly = hourly.where(F.col("year_week") == year_week).groupBy("tmc_code").agg(F.avg("speed_mean").alias("speed_mean"))
    return weekly.join(segments, weekly["tmc_code"] == segments["tmc"], "inner")


def join_flow_segments(flow: DataFrame, segments: DataFrame) -> DataFrame:
    return flow.join(segments, "segment_id", "inner")


def semi_filter(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti_filter(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def join_impact_long(
    diff: DataFrame, residuals: DataFrame, planned: DataFrame, unplanned: DataFrame, on: tuple[str, str] = ("time_bin", "tmc")
) -> DataFrame:
    """Long impact table; cells whose diff is NULL are left out."""
    keys = list(on)
    out = diff.where(F.col("diff").isNotNull())
    for side in (residuals, planned, unplanned):
        out = out.join(side, keys, "left")
    return out


def join_truth_prediction(truth: DataFrame, predicted: DataFrame, segments: list[str] | DataFrame) -> DataFrame:
    """Wide truth and prediction matrices (one column per segment, or all cells in one array) to one long table.

    Arrays meet as whole rows, before their cells are written out.
    """
    if isinstance(segments, DataFrame):
        both = truth.select("time_bin", F.col(CELLS).alias("__t")).join(predicted.select("time_bin", F.col(CELLS).alias("__p")), "time_bin", "left")
        pairs = F.transform("__t", lambda v, i: F.struct(v.alias("y_true"), F.get("__p", i).alias("y_pred")))
        long = stack_wide_to_long(both.select("time_bin", pairs.alias(CELLS)), "time_bin", segments, "tmc_code", "__c", keep_null=True)
        return long.select("time_bin", "tmc_code", "__c.y_true", "__c.y_pred")

    def long(df: DataFrame, value: str) -> DataFrame:
        return stack_wide_to_long(df, "time_bin", segments, "tmc_code", value, keep_null=True)

    return long(truth, "y_true").join(long(predicted, "y_pred"), ["time_bin", "tmc_code"], "left")


def holiday_join(daily: DataFrame, date_col: str = "date", value: str = "speed_mean") -> DataFrame:
    """Holidays within the data's range that have a daily value."""
    low, high = daily.agg(F.min(date_col)).scalar(), daily.agg(F.max(date_col)).scalar()
    calendar = us_holidays(daily.sparkSession, low, high).withColumnRenamed("date", date_col)
    return calendar.join(daily.select(date_col, value), date_col)
