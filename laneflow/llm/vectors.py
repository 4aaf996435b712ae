"""What both vector searches share: valid vectors, blobs of arrays, blocks of queries against shards, and top-k."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from laneflow.llm.common import small_batches

# Rows that a model may be fitted on, chosen by the hash of their id; index and search cover all rows.
SAMPLE_ROWS = 20_000
# Queries that meet a shard at a time.
BLOCK_QUERIES = 2_000


def clean_vectors(df: DataFrame, key: str, vector: str, zeros: bool = True) -> DataFrame:
    """(id, vec) with one row per id.

    Vectors that are null, or hold null or non-finite components, take no part,
    nor do all-zero ones unless ``zeros``, nor null ids.  Of several rows with
    one id the one with the largest vector counts.  Only vectors of the most
    common length stay (of equally common ones, the longest).
    """
    x = F.col(f"`{vector}`").cast("array<double>")
    rows = df.where(F.col(f"`{key}`").isNotNull() & x.isNotNull()).select(F.col(f"`{key}`").cast("long").alias("id"), x.alias("vec")).where(
        F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size("vec") > 0)
    )
    if not zeros:
        rows = rows.where(F.exists("vec", lambda v: v != 0))
    length = rows.groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size("vec") == (length["length"] if length else 0)).groupBy("id").agg(F.max("vec").alias("vec"))


def sample_matrix(df: DataFrame, column: str = "vec", rows: int = SAMPLE_ROWS) -> np.ndarray:
    """At most ``rows`` vectors as a matrix on the driver: those whose ids hash lowest."""
    taken = df.select(F.xxhash64("id").alias("h"), column).orderBy("h").limit(rows).select(column).toArrow()
    return matrix(taken.column(0).combine_chunks())


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def pack_arrays(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack_arrays(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as file:
        return {name: file[name] for name in file.files}


def search_blocks(
    queries: DataFrame, shards: DataFrame, search: Callable, schema: str, block: int = BLOCK_QUERIES
) -> DataFrame:
    """Blocks of queries against the shards they are routed to.

    ``queries``: shard, id, vec and ``bound``; ``shards``: shard and ``blob``.
    ``search(blob, ids, vectors, bounds)`` yields record batches of ``schema``.
    A task holds one shard and one block at a time; blocks hold ``block``
    queries on average, by the hash of their ids.
    """
    n_blocks = max(1, -(-queries.count() // block))
    grouped = queries.groupBy("shard", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block")).agg(
        F.collect_list(F.struct("id", "vec", "bound")).alias("queries")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked = batch.column("queries").slice(i, 1).flatten()
                ids, vecs, bounds = (asked.field(n) for n in range(3))
                yield from search(
                    unpack_arrays(batch.column("blob")[i].as_py()), ids.to_numpy(), matrix(vecs),
                    bounds.to_numpy(zero_copy_only=False),
                )

    small_batches(queries.sparkSession)
    return grouped.join(shards, "shard").select("queries", "blob").mapInArrow(run, schema)


def nearest(found: DataFrame, k: int, order: Column) -> DataFrame:
    """The first ``k`` of each query's finds, ranked from 1; ties go to the smaller id."""
    window = Window.partitionBy("query_id").orderBy(order, "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
