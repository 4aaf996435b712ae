"""Scans of events, segments, readings and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from laneflow import schemas
from laneflow.functions.columns import ensure_utc, to_utc
from laneflow.operators import filters
from laneflow.operators.windows import latest_per_key


def _scan(spark: SparkSession, path: str, fmt: str, schema=None, **options) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None and fmt in ("csv", "json"):
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def read_events(spark: SparkSession, path: str = "", fmt: str = "parquet", **options) -> DataFrame:
    """Events with their time columns as UTC timestamps.  ``fmt`` may be any Spark source, ``jdbc`` included."""
    raw = _scan(spark, path, fmt, schemas.EVENTS, **options)
    return to_utc(raw, schemas.present(raw, schemas.EVENT_TIME_COLUMNS))


def read_segments(
    spark: SparkSession, path: str, bbox=None, road: str | None = None, fmt: str = "csv"
) -> DataFrame:
    """Projected, typed segments; box and road filters at the scan; newest version per segment.

    CSV columns are matched by header name, so extra columns and other orders are fine.
    """
    wanted = schemas.SEGMENTS
    if fmt == "csv":
        raw = spark.read.option("header", True).csv(path)
        schemas.require_columns(raw, [f.name for f in wanted.fields if f.name != "active_start_date"])
        typed = [
            (F.try_to_timestamp(f.name) if f.name == "active_start_date" else F.col(f.name).try_cast(f.dataType)).alias(f.name)
            for f in wanted.fields if f.name in raw.columns
        ]
        rows = schemas.with_optional_columns(raw.select(*typed), wanted)
    else:
        rows = _scan(spark, path, fmt).select(*wanted.fieldNames())
    return latest_per_key(filters.filter_segments_bbox(rows, bbox, road), "tmc", "active_start_date")


def read_readings(
    spark: SparkSession, path: str, keys: DataFrame, start, end, fmt: str = "csv", source_tz: str = "UTC"
) -> DataFrame:
    """Readings of the given segments in a closed time range."""
    raw = spark.read.option("header", True).csv(path) if fmt == "csv" else _scan(spark, path, fmt)
    columns = schemas.present(raw, [*schemas.READINGS.fieldNames(), *schemas.READING_EXTRAS])
    numbers = {"speed", "reference_speed", "travel_time_seconds"}
    typed = []
    for c in columns:
        if c == "measurement_tstamp":
            stamp = F.try_to_timestamp(c) if fmt == "csv" else F.col(c)
            typed.append(ensure_utc(stamp, source_tz).alias(c))
        else:
            typed.append((F.col(f"`{c}`").try_cast("double") if c in numbers else F.col(f"`{c}`")).alias(c))
    return filters.filter_keys_timerange(raw.select(*typed), keys, start, end)


def read_feature_table(
    spark: SparkSession, path: str, columns: list[str] | None = None, check_keys: bool = True
) -> DataFrame:
    """Feature table with its key contract: key columns present and unique."""
    table = spark.read.parquet(path)
    schemas.require_columns(table, schemas.FEATURE_KEYS)
    if check_keys and schemas.duplicate_keys(table).limit(1).count():
        raise ValueError(f"{schemas.FEATURE_KEYS} is not unique in {path}")
    return table if columns is None else table.select(*schemas.FEATURE_KEYS, *columns)


def read_metrics(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Model name and cross-validated RMSE, from whichever known column names are there."""
    raw = _scan(spark, path, fmt)
    lower = {c.lower(): c for c in raw.columns}
    names = [lower[n] for n in ("model", "name", "model_feat") if n in lower]
    scores = [lower[n] for n in ("cv_rmse", "cv", "rmse_cv", "cv_rmse_mean") if n in lower]
    if not names or not scores:
        return spark.createDataFrame([], "model string, cv_rmse double")
    return raw.select(F.col(names[0]).cast("string").alias("model"), F.col(scores[0]).cast("double").alias("cv_rmse"))


def read_top_features(spark: SparkSession, path: str) -> DataFrame:
    """(model, kind, rank, feature, score) from the nested lists beside the metrics; models without a list have no rows."""
    nested = "model string, top_features_kind string, top_features array<struct<rank:int,feature:string,score:double>>"
    raw = spark.read.schema(nested).json(path)
    return raw.select("model", F.col("top_features_kind").alias("kind"), F.inline("top_features"))


def read_predictions(spark: SparkSession, path: str, timeline: DataFrame | None = None, models: list[str] | None = None) -> DataFrame:
    """Stored predictions, of all models or of ``models``; on a ``timeline`` (key, time) every model has all its rows.

    A sequence model predicts nothing for the first steps of a segment: rows of the
    timeline without a prediction are NULL.  Models are folders, so only the
    chosen ones are read.
    """
    stored = spark.read.parquet(path)
    if models is not None:
        stored = stored.where(F.col("model").isin(models))
    if timeline is None:
        return stored
    spine = timeline.select(*schemas.FEATURE_KEYS)
    # A few models: the timeline meets each one's folder, and is shuffled once for all of them.
    parts = []
    for name in sorted(r[0] for r in stored.select("model").where("model IS NOT NULL").distinct().collect()):
        rows = spine.join(stored.where(F.col("model") == name).drop("model"), schemas.FEATURE_KEYS, "left")
        others = [c for c in rows.columns if c not in schemas.FEATURE_KEYS]
        parts.append(rows.select(*schemas.FEATURE_KEYS, F.lit(name).cast(stored.schema["model"].dataType).alias("model"), *others))
    if not parts:
        return spine.join(stored, schemas.FEATURE_KEYS).select(*schemas.FEATURE_KEYS, "model", *[c for c in stored.columns if c not in (*schemas.FEATURE_KEYS, "model")]).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def from_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Points of the LineString features: feature number within its file, point number, lon, lat.

    ``lines=False`` reads whole FeatureCollection files, ``lines=True`` one feature per line.
    """
    if lines:
        features = spark.read.schema(schemas.GEOJSON_FEATURE).json(path).select("geometry", "properties", F.lit(0).alias("feature"))
    else:
        raw = spark.read.schema(schemas.GEOJSON).option("multiLine", True).json(path)
        features = raw.select(F.posexplode("features").alias("feature", "f")).select("f.geometry", "f.properties", "feature")
    routes = features.where(F.col("geometry.type") == "LineString")
    points = F.from_json("geometry.coordinates", "array<array<double>>")
    exploded = routes.select("feature", "properties", F.posexplode(points).alias("point", "c"))
    return exploded.select("feature", "properties", "point", F.col("c")[0].alias("lon"), F.col("c")[1].alias("lat"))
