"""Row filters and projections over events, segments, readings and flow tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from laneflow import schemas
from laneflow.functions import columns as C
from laneflow.functions.fixed_values import PLANNED_CLASSES

INCIDENT = "accidentsAndIncidents"


def inside_bbox(lat: Column, lon: Column, bbox: tuple[float, float, float, float]) -> Column:
    lat_min, lat_max, lon_min, lon_max = bbox
    return lat.between(lat_min, lat_max) & lon.between(lon_min, lon_max)


def filter_bbox(df: DataFrame, bbox, lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    return df.where(inside_bbox(F.col(lat), F.col(lon), bbox))


def filter_segments_bbox(df: DataFrame, bbox=None, road: str | None = None) -> DataFrame:
    """Either endpoint inside the box, and exactly this road; a condition that is not given does not apply."""
    if bbox:
        start = inside_bbox(F.col("start_latitude"), F.col("start_longitude"), bbox)
        end = inside_bbox(F.col("end_latitude"), F.col("end_longitude"), bbox)
        df = df.where(start | end)
    return df.where(F.col("road") == road) if road else df


def filter_road_pattern(df: DataFrame, pattern: str = r"I-10|I10", column: str = "RoadwayName") -> DataFrame:
    """Case-insensitive regular expression; NULL names never match."""
    return df.where(F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False)))


def filter_keys_timerange(
    df: DataFrame, keys: DataFrame, start=None, end=None, key: str = "tmc_code", ts: str = "measurement_tstamp"
) -> DataFrame:
    """Rows whose key is in ``keys`` and whose time lies in the closed range, open on a side that is not given."""
    inside = df
    if start is not None:
        inside = inside.where(F.col(ts) >= F.lit(start))
    if end is not None:
        inside = inside.where(F.col(ts) <= F.lit(end))
    return inside.join(keys.select(key), key, "left_semi")


def infer_direction(df: DataFrame, direction: str = "DirectionOfTravel", name: str = "RoadwayName") -> DataFrame:
    token = F.lower(F.regexp_extract(F.col(name), "(?i)(west|east|south|north)", 1))
    guessed = F.coalesce(F.nullif(token, F.lit("")), F.lit("unknown"))
    known = F.col(direction)
    return df.withColumn(direction, F.when(F.lower(known) == "unknown", guessed).otherwise(known))


def drop_optional_columns(df: DataFrame, columns: list[str] = schemas.EVENT_HEAVY_COLUMNS) -> DataFrame:
    return df.drop(*columns)


def map_category(
    df: DataFrame, mapping: dict[str, str] = PLANNED_CLASSES, default: str = "cat_unplanned",
    source: str = "EventSubType", out: str = "cat_event_type",
) -> DataFrame:
    """Lookup of a fixed dictionary, as one literal map expression."""
    if source not in df.columns:
        return df.withColumn(out, F.lit(default))
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(out, F.coalesce(F.try_element_at(table, F.col(source)), F.lit(default)))


def filter_city_radius(
    df: DataFrame, city: str | None, centres: dict[str, tuple[float, float]],
    lat: str = "Latitude", lon: str = "Longitude", radius: float = 0.1,
) -> DataFrame:
    """±``radius`` degrees around a named centre; unknown or no city keeps all rows."""
    if city not in centres:
        return df
    centre_lat, centre_lon = centres[city]
    box = (centre_lat - radius, centre_lat + radius, centre_lon - radius, centre_lon + radius)
    return filter_bbox(df, box, lat, lon)


def active_events(
    df: DataFrame, start: int, end: int, city: str | None = None, centres: dict | None = None, ordered: bool = True
) -> DataFrame:
    """Incidents that start in the range; other events that overlap it (epoch seconds, inclusive)."""
    kind, begin, finish = F.col("EventType"), F.col("StartDate"), F.col("PlannedEndDate")
    incident = (kind == INCIDENT) & begin.between(start, end)
    other = (kind != INCIDENT) & (begin <= end) & (finish >= start)
    kept = filter_city_radius(df.where(incident | other), city, centres or {})
    return kept.orderBy(F.desc("LastUpdated")) if ordered else kept


def active_between_iso(
    df: DataFrame, start: str, end: str, city: str | None = None, centres: dict | None = None, ordered: bool = True
) -> DataFrame:
    """Work zones or accidents overlapping a range, on ISO text dates."""
    begin, finish = C.iso_text_timestamp("start_date"), C.iso_text_timestamp("end_date")
    low, high = C.iso_text_timestamp(F.lit(start)), C.iso_text_timestamp(F.lit(end))
    kept = df.where(F.col("update_date").isNotNull() & (begin <= high) & (finish >= low))
    kept = filter_city_radius(kept, city, centres or {}, "latitude", "longitude")
    return kept.orderBy(C.iso_text_timestamp("update_date").desc()) if ordered else kept


def date_validity(hours: int = -7) -> Column:
    """Incidents need a valid start, flow rows nothing, all others a valid start and end."""
    limit = C.sentinel_time(hours)
    start_ok = F.col("StartDate").isNotNull() & (F.col("StartDate") != limit)
    end_ok = F.col("PlannedEndDate").isNotNull() & (F.col("PlannedEndDate") != limit)
    kind = F.col("EventType")
    valid = F.when(kind == "traffic_flow", True).when(kind == INCIDENT, start_ok)
    return valid.when(kind.isNotNull(), start_ok & end_ok).otherwise(False)


def split_valid_dates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Localise epoch columns (out of range → sentinel) and split into valid and rejected rows."""
    local = {c: C.to_local_time(c, out_of_range="sentinel") for c in ("StartDate", "PlannedEndDate", "LastUpdated")}
    flagged = df.withColumns(local).withColumn("__valid", date_validity())
    return flagged.where("__valid").drop("__valid"), flagged.where("NOT __valid").drop("__valid")


def snapshot_at(readings: DataFrame, segments: DataFrame, at) -> DataFrame:
    """Readings exactly at one instant with complete segment geometry."""
    moment = readings.where(F.col("measurement_tstamp") == F.lit(at))
    joined = moment.join(segments, moment["tmc_code"] == segments["tmc"], "left")
    return joined.dropna(subset=schemas.GEOMETRY_COLUMNS)


def filter_road_class(df: DataFrame, classes: list[str] | None = None) -> DataFrame:
    wanted = ["FRC0", "FRC1"] if classes is None else classes
    return df.where(F.col("frc").isin(wanted)) if wanted else df


def short_direction(direction: str | Column) -> Column:
    upper = F.upper(schemas.as_column(direction))
    return F.when(upper.contains("EAST"), "E").when(upper.contains("WEST"), "W")


def filter_direction(readings: DataFrame, segments: DataFrame, direction: str, value: str = "speed") -> DataFrame:
    """Non-null readings of the segments that run in one direction (``E`` or ``W``)."""
    allowed = segments.where(short_direction("direction") == direction).select(F.col("tmc").alias("tmc_code"))
    complete = readings.where(F.col("measurement_tstamp").isNotNull() & F.col(value).isNotNull())
    return complete.join(allowed, "tmc_code", "left_semi")


def filter_year_limit(df: DataFrame, column: str, limit: int = 2263) -> DataFrame:
    return df.where(F.year(column) < limit)


def hourly_points(df: DataFrame, roads: list[str] | None = None) -> DataFrame:
    """Map points: optional road selection, minimal columns, midpoint and open speed band."""
    kept = df.where(F.col("road").isin(roads)) if roads else df
    return kept.select(
        "hour", "tmc", "speed_mean", "road", "direction",
        *[expr.alias(name) for name, expr in C.segment_midpoint().items()],
        C.speed_band("speed_mean", "open").alias("speed_bin"),
    )


def split_by_flag(df: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where the flag holds, and the rest (NULL flags belong to the rest)."""
    held = F.coalesce(flag, F.lit(False))
    return df.where(held), df.where(~held)


def filter_period(df: DataFrame, year_week: str | None = None, date: str | None = None) -> DataFrame:
    """One ISO week, else one date, else everything."""
    if year_week:
        return df.where(F.col("year_week") == year_week)
    return df.where(F.col("date") == F.to_date(F.lit(date))) if date else df


def report_lag_pairs(df: DataFrame, update: str, start: str, label: str) -> DataFrame:
    """(update, start) pairs per label with the reporting lag in minutes."""
    return df.select(
        F.col(label), F.col(update).alias("update_time"), F.col(start).alias("start_time"),
        ((F.unix_micros(F.col(update)) - F.unix_micros(F.col(start))) / 60_000_000.0).alias("lag_minutes"),
    )
