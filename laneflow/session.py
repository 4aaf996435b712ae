"""Session settings, and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this library relies on.  Broadcast joins are left to
# Spark's own size check (autoBroadcastJoinThreshold, re-checked by AQE at run
# time with real sizes); nothing here is broadcast by hint.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles a method of more than 8,000 bytes: such a stage runs operator by operator instead, several times as fast.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "laneflow", master: str | None = None, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can reach.

    Where that setting is missing, as in a plain local session, the folder lies in
    the session's warehouse.  On a cluster a warehouse on a machine's own disk would
    lose rows silently, since every executor has its own: that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
        local = base.startswith(("file:", "/")) and not spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:").startswith("hdfs")
        if not is_local(spark.sparkContext.master) and local:
            raise RuntimeError("intermediate tables need a folder that all executors share: set spark.checkpoint.dir")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def is_local(master: str) -> bool:
    """Whether executors share the driver's machine and process."""
    return master == "local" or master.startswith("local[")


def materialise(df: DataFrame, label: str = "table", compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches of a plan would otherwise recompute an expensive
    input.  The table survives lost executors, and unlike a checkpointed RDD it
    keeps column pruning, filter pushdown and the size statistics that decide
    about broadcasts.  Sizes of files decide in which order they are read, and so in
    which order a fit's rows are drawn: ``compression`` is for tables without such readers.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
