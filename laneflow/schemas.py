"""Table schemas, and the tolerant / strict column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T


_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def _schema(spec: str) -> T.StructType:
    """Flat schema from ``name type`` pairs; needs no running session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (pair.split() for pair in spec.split(","))])


EVENTS = _schema(
    "ID string, Organization string, RoadwayName string, DirectionOfTravel string, Description string, "
    "Reported bigint, LastUpdated bigint, StartDate bigint, PlannedEndDate bigint, LanesAffected string, "
    "Latitude double, Longitude double, EventType string, EventSubType string, IsFullClosure boolean, Severity string"
)
SEGMENTS = _schema(
    "tmc string, road string, direction string, intersection string, start_latitude double, "
    "start_longitude double, end_latitude double, end_longitude double, miles double, road_order double, "
    "active_start_date timestamp"
)
READINGS = _schema(
    "tmc_code string, measurement_tstamp timestamp, speed double, reference_speed double, "
    "travel_time_seconds double"
)
# Present in the raw feed, dropped before binning.
READING_EXTRAS = ["confidence_score", "cvalue", "Inrix 2013", "Inrix 2019"]
EVENT_TIME_COLUMNS = ["Reported", "LastUpdated", "StartDate", "PlannedEndDate"]
EVENT_HEAVY_COLUMNS = [
    "EncodedPolyline", "Width", "Height", "Length", "Weight", "Speed", "DetourPolyline", "DetourInstructions",
]
GEOMETRY_COLUMNS = ["start_latitude", "start_longitude", "end_latitude", "end_longitude"]
FEATURE_KEYS = ["tmc_code", "time_bin"]

POLYLINE = "array<struct<latitude:double,longitude:double>>"
GEOJSON_FEATURE = (
    "type string, geometry struct<type:string, coordinates:string>, properties map<string,string>"
)
GEOJSON = (
    "type string, features array<struct<type:string, geometry:struct<type:string, coordinates:string>, "
    "properties:map<string,string>>>"
)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def with_optional_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks as typed NULLs."""
    absent = [f for f in schema.fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in absent])


def duplicate_keys(df: DataFrame, keys: list[str] = FEATURE_KEYS) -> DataFrame:
    """Key values that occur more than once (empty when the key contract holds)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value
