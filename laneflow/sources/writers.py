"""Sinks, caches and table profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from laneflow.operators.ranking import grouped_quantiles
from laneflow.schemas import FEATURE_KEYS


def write_feature_table(df: DataFrame, path: str) -> DataFrame:
    """Write by date and report rows, columns and distinct keys.

    Rows are gathered by date, and Spark splits large dates over as many tasks as
    their size asks for and joins small ones.
    """
    dated = df.withColumn("date", F.to_date("time_bin"))
    dated.hint("rebalance", "date").write.mode("overwrite").option("compression", "zstd").partitionBy("date").parquet(path)
    written = df.sparkSession.read.parquet(path)
    pairs = written.select(*FEATURE_KEYS).distinct().agg(F.count(F.lit(1))).scalar()
    return written.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), pairs.alias("n_pairs")
    )


def write_intermediates(events: DataFrame, readings: DataFrame, segments: DataFrame, folder: str) -> None:
    for name, df in (("events", events), ("readings", readings), ("segments", segments)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished Parquet output lies at ``path``."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def rollup_cache(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """Reload an aggregate written earlier, or compute and write it."""
    if force or not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def rewrite_bounded_files(
    df: DataFrame, path: str, max_bytes: int, fmt: str = "csv", force: bool = False
) -> DataFrame:
    """Rewrite a table into text files of at most ``max_bytes`` bytes each; a finished rewrite is kept.

    Rows keep the order of their input partition.  Their sizes as written (``csv``
    with a header, or ``json``) are added up along it, and a file ends where the sum
    would pass the bound.  Two rows' worth of room is kept free for the row that
    crosses it.  Returns file, rows and bytes.  A row that does not fit is an error.
    """
    spark, row = df.sparkSession, F.struct(*[F.col(f"`{c}`") for c in df.columns])
    lines = {"csv": F.to_csv(row), "json": F.to_json(row)}
    if fmt not in lines:
        raise ValueError(f"text formats only: {sorted(lines)}")
    if force or not is_complete(spark, path):
        sized = df.withColumns({
            "__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id(), "__bytes": F.octet_length(lines[fmt]) + 1,
        })
        head = len(",".join(df.columns).encode()) + 1 if fmt == "csv" else 0
        longest = sized.agg(F.max("__bytes")).first()[0] or 0
        room = max_bytes - head - longest
        if room <= 0 and longest:
            raise ValueError(f"rows of up to {longest} bytes do not fit files of {max_bytes}")
        # One window per input partition, whose size the reader bounds.
        along = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut = sized.withColumn("__cut", F.floor((F.sum("__bytes").over(along) - 1) / F.lit(max(room, 1)))).drop("__at", "__bytes")
        writer = cut.write.mode("overwrite").partitionBy("__part", "__cut").format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(path)
    written = spark.read.schema(df.schema).format(fmt).option("header", True).load(path)
    files = written.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("n_bytes"))
    return files.groupBy("file", "n_bytes").agg(F.count(F.lit(1)).alias("n_rows"))


def to_geojson(df: DataFrame) -> DataFrame:
    """One LineString feature per segment row, as JSON text."""
    start = F.array("start_longitude", "start_latitude")
    end = F.array("end_longitude", "end_latitude")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"), F.array(start, end).alias("coordinates")).alias("geometry"),
        F.struct("tmc", "road", "direction", F.col("speed_mean").cast("double").alias("speed_mean"),
                 F.col("miles").cast("double").alias("miles")).alias("properties"),
    )
    return df.select("tmc", F.to_json(feature).alias("feature"))


def write_geojson(features: DataFrame, path: str) -> None:
    """Newline-delimited features: every task writes its own file."""
    features.select("feature").write.mode("overwrite").text(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Long predictions (keys, split, seq_len, direction, y_true, y_pred), one folder per model."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy("model").parquet(path)


def write_metrics(metrics: DataFrame, top: DataFrame, folder: str) -> None:
    """Flat metrics as CSV, and as JSON with each model's top features nested."""
    metrics.write.mode("overwrite").option("header", True).csv(f"{folder}/metrics_csv")
    # A model has at most ten top features.
    nested = top.groupBy("model").agg(
        F.max("kind").alias("top_features_kind"),
        F.array_sort(F.collect_list(F.struct("rank", "feature", "score"))).alias("top_features"),
    )
    metrics.join(nested, "model", "left").write.mode("overwrite").json(f"{folder}/metrics_json")


def write_training_snapshot(df: DataFrame, features: list[str], target: str, path: str) -> DataFrame:
    """Only the used columns, sorted by name."""
    columns = sorted({*features, target} & set(df.columns))
    df.select(*columns).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def table_profile(df: DataFrame) -> DataFrame:
    """Per column: rows, NULLs and their share; for numbers also mean, deviation, range and quantiles.

    Counts and moments of all columns take one pass; quantiles are exact.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    aggregates = [F.count(F.lit(1)).alias("n_rows")]
    for c in df.columns:
        aggregates.append(F.count_if(F.col(c).isNull()).alias(f"nulls|{c}"))
    for c in numeric:
        v = F.col(c).cast("double")
        aggregates += [
            F.avg(v).alias(f"mean|{c}"), F.stddev_samp(v).alias(f"std|{c}"), F.min(v).alias(f"min|{c}"), F.max(v).alias(f"max|{c}")
        ]
    row = df.agg(*aggregates)
    none = F.lit(None).cast("double")

    def cell(kind: str, c: str):
        return F.col(f"`{kind}|{c}`") if c in numeric else none

    entries = [
        F.struct(
            F.lit(c).alias("column"), F.col("n_rows"), F.col(f"`nulls|{c}`").alias("n_null"),
            F.try_divide(F.col(f"`nulls|{c}`") * 100.0, F.col("n_rows")).alias("null_percent"),
            *[cell(k, c).alias(k) for k in ("mean", "std", "min", "max")],
        )
        for c in df.columns
    ]
    profile = row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    marks = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    if not numeric:
        return profile
    # All numeric columns as (column, value) rows: one plan for the quantiles of all of them.
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in numeric]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    return profile.join(grouped_quantiles(long, ["column"], "value", marks), "column", "left")
