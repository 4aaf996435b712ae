"""Nearest-segment and nearest-city joins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from laneflow.functions.columns import point_segment_distance
from laneflow.functions.fixed_values import METRES_PER_DEGREE_LAT, METRES_PER_DEGREE_LON
from laneflow.operators.quadtree import QuadTree
from laneflow.session import materialise

DIRECTION_NAMES = {"east": "EASTBOUND", "west": "WESTBOUND", "north": "NORTHBOUND", "south": "SOUTHBOUND"}
ANY = "any"
# Segments per direction from which the quadtree's shape is drawn.
TREE_SAMPLE = 10_000


def nearest_segment_join(
    events: DataFrame,
    segments: DataFrame,
    event_id: str = "ID",
    lat: str = "Latitude",
    lon: str = "Longitude",
    direction: str = "DirectionOfTravel",
) -> DataFrame:
    """Attach the nearest segment that runs in the event's direction.

    Adds ``near_tmc``, ``near_distance`` (metres), ``near_x``/``near_y`` (projected
    point, metres) and ``near_t``.  Events without a known direction, or whose
    direction no segment has, are matched against all segments; events without
    coordinates stay unmatched; ties go to the lowest segment code.

    The search is exact and never compares every event with every segment.  A
    quadtree per direction splits where segments are dense; a segment is written
    once per leaf that it crosses.  A point is compared with the segments of one
    leaf, which gives a bound on its distance; only where the edge of another leaf
    with segments is nearer than that bound does a second join look there too.
    The tree's shape comes from a bounded sample (``TREE_SAMPLE`` segments per
    direction) and decides nothing but how many pairs are compared.

    Equal points are searched once, equal segments compared once; crowded leaves
    are left to Spark's splitting of skewed joins.
    """
    search = F.lower(F.col(direction)).alias("search")
    located = events.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    places = located.groupBy(F.col(lat).alias("__lat"), F.col(lon).alias("__lon"), search).agg(F.count(F.lit(1)).alias("n"))
    places = materialise(places, "places")
    # Driver scalars only: the latitude of the projection, and below the extents of at most five directions.
    lat0 = places.agg(F.sum(F.col("__lat") * F.col("n")) / F.sum("n")).first()[0]
    per_lon = METRES_PER_DEGREE_LON * math.cos(math.radians(lat0 or 0.0))
    x, y = lambda c: F.col(c) * F.lit(per_lon), lambda c: F.col(c) * F.lit(METRES_PER_DEGREE_LAT)
    upper = F.upper(F.col("direction"))
    classes = F.array_compact(F.array(F.lit(ANY), *[F.when(upper.contains(n), F.lit(d)) for d, n in DIRECTION_NAMES.items()]))
    ends = ["ax", "ay", "bx", "by"]
    lines = segments.select(
        "tmc", x("start_longitude").alias("ax"), y("start_latitude").alias("ay"), x("end_longitude").alias("bx"), y("end_latitude").alias("by"),
        F.explode(classes).alias("cls"),
    ).dropna(subset=ends)
    lines = materialise(lines.groupBy("cls", *ends).agg(F.min("tmc").alias("tmc")), "lines")
    low = [F.min(F.least("ax", "bx")), F.min(F.least("ay", "by"))]
    high = [F.max(F.greatest("ax", "bx")), F.max(F.greatest("ay", "by"))]
    extents = {r["cls"]: r for r in lines.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.array(*low, *high).alias("extent")).collect()}
    if lat0 is None or not extents:
        return events.select(
            "*", F.lit(None).cast("string").alias("near_tmc"),
            *[F.lit(None).cast("double").alias(c) for c in ("near_distance", "near_x", "near_y", "near_t")],
        )

    share = {c: min(1.0, TREE_SAMPLE / r["n"]) for c, r in extents.items()}
    wanted = F.create_map(*[F.lit(v) for pair in share.items() for v in pair])
    drawn = F.pmod(F.xxhash64("tmc", *ends), F.lit(1 << 20)) / F.lit(float(1 << 20)) < wanted[F.col("cls")]
    sample = lines.where(drawn).select("cls", *ends).toPandas()
    trees = {
        c: QuadTree.grown(tuple(r["extent"]), sample.loc[sample["cls"] == c, ends].to_numpy(float), 1 / share[c]) for c, r in extents.items()
    }

    def by_class(batch: pa.RecordBatch, work) -> pa.RecordBatch:
        """``work(tree, part)`` gives rows of the part and a leaf for each; all columns of these rows, and the leaf."""
        classes = np.array(batch.column("cls").to_pylist(), dtype=object)
        rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for name, tree in trees.items():
            part = np.flatnonzero(classes == name)
            if len(part):
                chosen, leaf = work(tree, batch.take(pa.array(part)))
                rows.append(part[chosen])
                leaves.append(leaf)
        out = batch.take(pa.array(np.concatenate(rows)))
        return pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(leaves))], [*out.schema.names, "leaf"])

    def numbers(batch: pa.RecordBatch, *names: str) -> np.ndarray:
        return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])

    def with_leaves(df: DataFrame, work) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield by_class(batch, work)

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("leaf", T.LongType())]))

    registered = materialise(with_leaves(lines, lambda tree, part: tree.crossed(numbers(part, *ends))), "segment-leaves")
    # At most MAX_LEAVES per direction.
    held = registered.select("cls", "leaf").distinct().toPandas()
    for name, tree in trees.items():
        tree.fill(held.loc[held["cls"] == name, "leaf"].to_numpy())

    known = [d for d in DIRECTION_NAMES if d in extents]
    cls = F.when(F.col("search").isin(known), F.col("search")).otherwise(F.lit(ANY)) if known else F.lit(ANY)
    key = ["cls", "__lat", "__lon"]
    point = [*key, "px", "py"]
    # A point's bytes say little about its work, so the number of partitions is stated and AQE joins none of them.
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = places.select(cls.alias("cls"), "__lat", "__lon").repartition(parts, *key).distinct().withColumns({"px": x("__lon"), "py": y("__lat")})

    vx, vy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    len2 = vx * vx + vy * vy
    len2 = F.when(len2 == 0, 1e-12).otherwise(len2)
    t = ((F.col("px") - F.col("ax")) * vx + (F.col("py") - F.col("ay")) * vy) / len2
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    qx, qy = F.col("ax") + F.col("t") * vx, F.col("ay") + F.col("t") * vy
    dx, dy = F.col("px") - F.col("qx"), F.col("py") - F.col("qy")
    def measured(df: DataFrame) -> DataFrame:
        pairs = df.join(registered, ["cls", "leaf"]).withColumn("t", t)
        return pairs.withColumns({"qx": qx, "qy": qy}).withColumn("dist2", dx * dx + dy * dy)

    # The bound is a plain number, so that its minimum needs no sorting; only pairs within it are ranked.
    placed = with_leaves(points, lambda tree, part: (np.arange(part.num_rows), tree.home(numbers(part, "px", "py"))))
    bounds = materialise(measured(placed).groupBy(*point, "leaf").agg(F.min("dist2").alias("bound")).withColumnRenamed("leaf", "home"), "bounds")
    reached = with_leaves(bounds, lambda tree, part: tree.within(numbers(part, "px", "py"), numbers(part, "bound")[:, 0], numbers(part, "home")[:, 0]))
    within = measured(reached).where(F.col("dist2") <= F.col("bound"))
    best = within.groupBy(*key).agg(F.min(F.struct("dist2", "tmc", F.col("qx").alias("x"), F.col("qy").alias("y"), "t")).alias("best"))
    matches = best.select(
        F.col("cls").alias("__cls"), F.col("__lat").alias("__mlat"), F.col("__lon").alias("__mlon"),
        F.col("best.tmc").alias("near_tmc"), F.sqrt("best.dist2").alias("near_distance"),
        F.col("best.x").alias("near_x"), F.col("best.y").alias("near_y"), F.col("best.t").alias("near_t"),
    )
    searched = F.lower(F.col(direction))
    keyed = events.withColumn("__search", F.when(searched.isin(known), searched).otherwise(F.lit(ANY)) if known else F.lit(ANY))
    joined = keyed.join(
        matches,
        (F.col("__search") == F.col("__cls")) & (F.col(lat) == F.col("__mlat")) & (F.col(lon) == F.col("__mlon")),
        "left",
    )
    return joined.drop("__search", "__cls", "__mlat", "__mlon")


def nearest_city(
    df: DataFrame, centres: dict[str, tuple[float, float]], lat: str = "latitude", lon: str = "longitude",
    out: str = "nearest_city",
) -> DataFrame:
    """Closest of a handful of fixed centres by degree distance; the first listed wins ties.

    The centre list is a literal of fixed length, so this is one expression per row and no join.
    """
    options = []
    for rank, (name, (clat, clon)) in enumerate(centres.items()):
        dy, dx = F.col(lat) - F.lit(clat), F.col(lon) - F.lit(clon)
        options.append(F.struct(F.sqrt(dy * dy + dx * dx).alias("d"), F.lit(rank).alias("r"), F.lit(name).alias("c")))
    best = F.array_min(F.array(*options))
    missing = F.col(lat).isNull() | F.col(lon).isNull()
    return df.withColumn(out, F.when(missing, F.lit("Other")).otherwise(best.getField("c")))


def with_projection(df: DataFrame, prefix: str = "") -> DataFrame:
    """Point-to-segment distance, projection and ``t`` for rows with px, py, ax, ay, bx, by."""
    parts = point_segment_distance(*[F.col(prefix + c) for c in ("px", "py", "ax", "ay", "bx", "by")])
    return df.withColumns(parts)
