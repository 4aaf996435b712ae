"""Line-graph feature propagation and per-bin feature tensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def neighbour_propagation(
    features: DataFrame, edges: DataFrame, columns: list[str], node: str = "tmc_code", time_col: str = "time_bin"
) -> DataFrame:
    """Degree-normalised sum over incoming neighbours and the node itself at each time.

    Weight of edge i→j is ``1 / sqrt(deg_i · deg_j)`` with in-degrees that include
    the self-loop; the pair table is as small as the graph.
    """
    nodes = edges.select(F.col("src").alias("n")).union(edges.select("dst")).distinct()
    loops = nodes.select(F.col("n").alias("src"), F.col("n").alias("dst"))
    full = edges.select("src", "dst").union(loops)
    degree = full.groupBy("dst").agg(F.count(F.lit(1)).alias("deg"))
    weighted = (
        full.join(degree.select(F.col("dst").alias("src"), F.col("deg").alias("deg_src")), "src")
        .join(degree.select("dst", F.col("deg").alias("deg_dst")), "dst")
        .select("src", "dst", (1 / F.sqrt(F.col("deg_src") * F.col("deg_dst"))).alias("w"))
    )
    sent = features.select(F.col(node).alias("src"), time_col, *columns).join(weighted, "src")
    return sent.groupBy(F.col("dst").alias(node), time_col).agg(*[
        F.sum(F.col(c) * F.col("w")).alias(f"nbr_{c}") for c in columns
    ])


def tensor_rows(
    df: DataFrame, positions: DataFrame, features: list[str], target: str, key: str = "tmc_code", time_col: str = "time_bin"
) -> DataFrame:
    """One row per bin: segments × features and targets in position order, with replaced-value counts.

    NULL, NaN and infinite values, and segments without a row, become 0.  The array
    of a bin is as long as the given position list.
    """
    placed = df.join(positions.withColumnRenamed("tmc", key), key)
    size = positions.agg(F.count(F.lit(1))).scalar()
    numbers = [*features, target]

    def usable(c: str):
        v = F.col(c).cast("double")
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))

    clean = {f"__{c}": F.when(usable(c), F.col(c).cast("double")).otherwise(0.0) for c in numbers}
    bad = sum([(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int") for c in features], F.lit(0))
    row = F.struct(
        F.col("position"), F.array(*[F.col(f"__{c}") for c in features]).alias("x"), F.col(f"__{target}").alias("y")
    )
    target_bad = (F.col(target).isNull() | F.isnan(F.col(target).cast("double"))).cast("int")
    per_bin = placed.withColumns(clean).withColumns({"__bad": bad, "__tbad": target_bad}).groupBy(time_col).agg(
        F.array_sort(F.collect_list(row)).alias("rows"),
        F.sum("__bad").alias("__bad"), F.sum("__tbad").alias("__tbad"), F.count(F.lit(1)).alias("__n"),
    )
    blank = F.array(*[F.lit(0.0) for _ in features])
    absent = F.col("__size") - F.col("__n")
    inside = F.filter("rows", lambda r: r.position.isNull() | ((r.position >= 0) & (r.position < F.col("__size"))))
    sized = per_bin.withColumn("__size", size).withColumn("rows", inside).withColumn("__at", F.transform("rows", lambda r: r.position.cast("int")))

    def filled(field: str, empty: Column) -> Column:
        """The rows in order, each behind as many blanks as positions are missing before it: one step per position."""

        def stretch(r: Column, i: Column) -> Column:
            here, gap = F.get("__at", i), F.get("__at", i) - F.coalesce(F.get("__at", i - 1), F.lit(-1)) - 1
            bad = F.raise_error(F.lit("a bin has two rows at one position, or one without a position")).cast("int")
            return F.concat(F.array_repeat(empty, F.when(here.isNull() | (gap < 0), bad).otherwise(gap)), F.array(r[field]))

        last = F.coalesce(F.get("__at", F.size("__at") - 1), F.lit(-1))
        return F.concat(F.flatten(F.transform("rows", stretch)), F.array_repeat(empty, (F.col("__size") - 1 - last).cast("int")))

    return sized.select(
        time_col, filled("x", blank).alias("x"), filled("y", F.lit(0.0)).alias("y"),
        (F.col("__bad") + absent * len(features)).alias("feature_nulls"), (F.col("__tbad") + absent).alias("target_nulls"),
    )
