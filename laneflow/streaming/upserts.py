"""A store of the newest row per key, upserted batch by batch.

Keys are dealt to buckets by hash.  A bucket is a short row of parts, oldest
first, each more than ``FOLD`` times as large as the next: a batch's rows for a
bucket absorb all newer parts that are not larger than that, so the parts of a
bucket are few and the store's size follows its keys, not its batches.  A
manifest per batch lists each bucket's parts; readers follow the newest whole
one, and what neither it nor the one before lists is removed.

    path/data/batch_id=n/bucket=b/   rows of one part
    path/manifest/batch_id=n/        (bucket, part, n_rows, n_buckets)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS, FOLD = 16, 2
# Rows of a part in one file, on average.
FILE_ROWS = 1_000_000

Parts = dict[int, list[tuple[int, int]]]


def latest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key by one map-side combined aggregate."""
    rest = [c for c in df.columns if c not in {*keys, *order}]
    newest = F.max(F.struct(*order, *rest)).alias("row")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"row.{c}").alias(c) for c in [*order, *rest]])


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and its constructor of paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose manifest is whole, in order."""
    files, make = _file_system(spark, path)
    top = make(f"{path}/manifest")
    if not files.exists(top):
        return []
    names = [status.getPath().getName() for status in files.listStatus(top)]
    numbers = [int(n.partition("=")[2]) for n in names if n.startswith("batch_id=")]
    return sorted(n for n in numbers if files.exists(make(f"{path}/manifest/batch_id={n}/_SUCCESS")))


def _manifest(spark: SparkSession, path: str, batch: int) -> tuple[Parts, int]:
    """Parts of each bucket, oldest first, as (batch, rows), and the number of buckets.  Its length is bounded by buckets and folding."""
    parts: Parts = {}
    buckets = BUCKETS
    for row in spark.read.parquet(f"{path}/manifest/batch_id={batch}").orderBy("bucket", "part").collect():
        parts.setdefault(row["bucket"], []).append((row["part"], row["n_rows"]))
        buckets = row["n_buckets"]
    return parts, buckets


def _read(spark: SparkSession, path: str, listed: list[tuple[int, int]]) -> DataFrame | None:
    """Rows of (bucket, part) pairs."""
    folders = [f"{path}/data/batch_id={part}/bucket={bucket}" for bucket, part in listed]
    return spark.read.option("basePath", f"{path}/data").parquet(*folders).drop("batch_id") if folders else None


def write_upserts(
    batch: DataFrame, batch_id: int, path: str, key: str | list[str] = "id", poll: str = "poll", buckets: int = BUCKETS
) -> None:
    """Fold one micro-batch's newest row per key into the store at ``path``.

    A batch that was stored before, or is empty, changes nothing.  One that was
    interrupted leaves no manifest: its replay writes the same folder anew, from
    the parts that the manifest before it lists.
    """
    spark, keys = batch.sparkSession, [key] if isinstance(key, str) else list(key)
    stored = _batches(spark, path)
    if batch_id in stored or batch.isEmpty():
        return
    parts, buckets = _manifest(spark, path, stored[-1]) if stored else ({}, buckets)
    newest = latest_rows(batch, keys, [poll]).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
    # At most one number per bucket.
    fresh = {r["bucket"]: r["n"] for r in newest.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    absorbed: list[tuple[int, int]] = []
    rows = 0
    for bucket, size in fresh.items():
        held = parts.setdefault(bucket, [])
        while held and held[-1][1] <= FOLD * size:
            part, n = held.pop()
            absorbed.append((bucket, part))
            size += n
        rows += size
    old = _read(spark, path, absorbed)
    folded = newest if old is None else latest_rows(newest.unionByName(old.select(*newest.columns)), [*keys, "bucket"], [poll])
    split = F.pmod(F.xxhash64(F.lit("file"), *keys), F.lit(max(1, -(-rows // (FILE_ROWS * len(fresh))))))
    data = f"{path}/data/batch_id={batch_id}"
    folded.repartition(F.col("bucket"), split).write.mode("overwrite").partitionBy("bucket").parquet(data)
    newest.unpersist()
    for r in spark.read.parquet(data).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():
        parts[r["bucket"]].append((batch_id, r["n"]))
    listed = [(b, part, n, buckets) for b, held in parts.items() for part, n in held]
    manifest = spark.createDataFrame(listed, "bucket int, part bigint, n_rows bigint, n_buckets int").coalesce(1)
    manifest.write.mode("overwrite").parquet(f"{path}/manifest/batch_id={batch_id}")
    _clear(spark, path, [*stored, batch_id])


def _clear(spark: SparkSession, path: str, stored: list[int]) -> None:
    """Remove manifests but the two newest, and parts that neither of them lists.

    Readers that have just taken the manifest before the newest find all its parts.
    """
    files, make = _file_system(spark, path)
    keep = stored[-2:]
    listed = {(b, part) for n in keep for b, held in _manifest(spark, path, n)[0].items() for part, _ in held}
    for n in stored[:-2]:
        files.delete(make(f"{path}/manifest/batch_id={n}"), True)
    for folder in files.listStatus(make(f"{path}/data")):
        part = folder.getPath().getName().partition("=")[2]
        inside = [s.getPath() for s in files.listStatus(folder.getPath()) if s.isDirectory()]
        gone = [p for p in inside if (int(p.getName().partition("=")[2]), int(part)) not in listed]
        for p in gone if len(gone) < len(inside) else [folder.getPath()]:
            files.delete(p, True)


def current_state(spark: SparkSession, path: str, key: str | list[str] = "id", poll: str = "poll") -> DataFrame:
    """Newest row per key over all batches."""
    keys = [key] if isinstance(key, str) else list(key)
    stored = _batches(spark, path)
    if not stored:
        raise FileNotFoundError(f"no batch was stored at {path}")
    parts, _ = _manifest(spark, path, stored[-1])
    rows = _read(spark, path, [(b, part) for b, held in parts.items() for part, _ in held])
    return latest_rows(rows, [*keys, "bucket"], [poll]).drop("bucket")


def compact_log(spark: SparkSession, path: str, target: str, key: str | list[str] = "id", poll: str = "poll") -> DataFrame:
    """The state as one batch of a store at a new place, which readers may switch to."""
    write_upserts(current_state(spark, path, key, poll), 0, target, key, poll)
    return current_state(spark, target, key, poll)
