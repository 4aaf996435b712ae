"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes are the signs of the centred vectors after a rotation learned on a sample:
principal axes, then the rotation that brings the sample closest to its own
signs.  A code is split into substrings and each shard of rows indexes all of
them.  By the pigeonhole principle a code within Hamming radius r of the query's
differs from it in some substring by little: with r = m t + a, in one of the
first a + 1 of the m substrings by at most t, or in one of the others by at most
t - 1.  Probing all such values finds every code within the radius; those rows
are reranked by their distances as floats.

The radius is fitted too: on sample queries, it takes in a given share of the
true neighbours.  Where a shard has fewer than k codes within it, it grows
there until there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from laneflow.llm.common import materialise
from laneflow.llm.vectors import clean_vectors, matrix, nearest, pack_arrays, sample_matrix, search_blocks

SUBSTRING = 16
SHARD_ROWS = 50_000
SAMPLE_QUERIES = 200


# ----------------------------------------------------------------------- codes


@dataclass
class Coder:
    centre: np.ndarray
    axes: np.ndarray
    radius: int

    @property
    def substrings(self) -> int:
        return self.axes.shape[1] // SUBSTRING

    def encode(self, points: np.ndarray) -> np.ndarray:
        """A row of 16-bit substrings per vector."""
        bits = (points - self.centre) @ self.axes > 0
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)


def fit_coder(sample: np.ndarray, bits: int, k: int, share: float = 0.98, rounds: int = 30, seed: int = 5) -> Coder:
    """Learn the rotation, and the radius that takes in ``share`` of the ``k`` nearest in the sample.

    ``bits`` is a multiple of 16.  Beyond the vectors' dimensions, further bits
    come from further rotations, each learned from another start.
    """
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    centre = sample.mean(0)
    points = sample - centre
    _, principal = np.linalg.eigh(points.T @ points)
    principal = principal[:, ::-1]
    projected, axes = points @ principal, []
    while sum(a.shape[1] for a in axes) < bits:
        rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(projected @ rotation).T @ projected)
            rotation = (u @ v).T
        axes.append(principal @ rotation)
    coder = Coder(centre, np.hstack(axes)[:, :bits], bits)
    codes = coder.encode(sample)
    needed = []
    for i in range(min(SAMPLE_QUERIES, len(sample))):
        distance = ((sample - sample[i]) ** 2).sum(1)
        distance[i] = np.inf
        near = np.argpartition(distance, min(k, len(sample) - 1) - 1)[:k] if len(sample) > 1 else []
        needed += [int(np.bitwise_count(codes[j] ^ codes[i]).sum()) for j in near if np.isfinite(distance[j])]
    if needed:
        coder.radius = int(np.ceil(np.quantile(needed, share)))
    return coder


@cache
def _masks() -> tuple[np.ndarray, np.ndarray]:
    """All 16-bit differences by their number of bits, and how many have at most 0, 1, ... 16 of them."""
    values = np.arange(1 << SUBSTRING, dtype=np.uint32)
    counts = np.bitwise_count(values)
    return values[np.argsort(counts, kind="stable")], np.cumsum(np.bincount(counts))


# ----------------------------------------------------------------------- index


def build_index(ids: np.ndarray, points: np.ndarray, coder: Coder) -> dict[str, np.ndarray]:
    """For each substring the rows in order of its value, and where each value begins."""
    codes = coder.encode(points)
    orders = np.argsort(codes, axis=0, kind="stable").T.astype(np.int32)
    starts = np.array([np.concatenate([[0], np.cumsum(np.bincount(c, minlength=1 << SUBSTRING))]) for c in codes.T], np.int32)
    return {"ids": ids, "points": points, "codes": codes, "orders": orders, "starts": starts}


def within_radius(index: dict[str, np.ndarray], code: np.ndarray, radius: int) -> np.ndarray:
    """The rows whose codes differ from ``code`` in at most ``radius`` bits: all of them, by probing."""
    parts = len(code)
    masks, upto = _masks()
    full, extra = divmod(radius, parts)
    hit = np.zeros(len(index["ids"]), bool)
    for j in range(parts):
        most = min(full - (j > extra), SUBSTRING)
        if most < 0:
            continue
        probes = masks[: upto[most]] ^ np.uint32(code[j])
        begins = index["starts"][j][probes]
        lengths = index["starts"][j][probes + 1] - begins
        used = lengths > 0
        begins, lengths = begins[used], lengths[used]
        ends = np.cumsum(lengths)
        if len(ends):
            hit[index["orders"][j][np.arange(ends[-1]) + np.repeat(begins - (ends - lengths), lengths)]] = True
    rows = np.flatnonzero(hit)
    return rows[np.bitwise_count(index["codes"][rows] ^ code).sum(1) <= radius]


def search_index(index: dict[str, np.ndarray], query: np.ndarray, code: np.ndarray, k: int, radius: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and distances of the ``k`` nearest among the codes within the radius, wider where these are too few."""
    bits = len(code) * SUBSTRING
    while True:
        rows = within_radius(index, code, radius)
        rows = rows[index["ids"][rows] != skip]
        if len(rows) >= k or radius >= bits:
            break
        radius = min(radius + len(code), bits)
    distances = np.sqrt(((index["points"][rows] - query) ** 2).sum(1))
    first = np.lexsort((index["ids"][rows], distances))[:k]
    return index["ids"][rows][first], distances[first]


# ------------------------------------------------------------------ Spark jobs


def approximate_nearest(
    df: DataFrame, key: str, vector: str, queries: Column, k: int, bits: int = 64, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """The ``k`` nearest rows found, by Euclidean distance in double precision, for each row that ``queries`` selects.

    ``queries`` is a condition on ``id``.  Rotation and radius are learned on at
    most ``vectors.SAMPLE_ROWS`` rows; all rows are indexed.  A row is no
    candidate of its own query; fewer candidates than ``k`` are all returned;
    ties go to the smaller id; an empty table gives no rows.  Which vectors take
    part: :func:`laneflow.llm.vectors.clean_vectors`, without all-zero ones.
    """
    rows = materialise(clean_vectors(df, key, vector, zeros=False), "vectors")
    schema = "query_id bigint, vec_id bigint, score double"
    sample = sample_matrix(rows)
    if not len(sample):
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    coder = fit_coder(sample, bits, k)
    n_shards = max(1, -(-rows.count() // shard_rows))
    members = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int"))

    def index(group: pa.Table) -> pa.Table:
        arrays = build_index(group.column("id").to_numpy(), matrix(group.column("vec").combine_chunks()), coder)
        return pa.table({"shard": pa.array(group.column("shard")[:1].to_pylist(), pa.int32()), "blob": pa.array([pack_arrays(**arrays)], pa.binary())})

    shards = materialise(members.groupBy("shard").applyInArrow(index, "shard int, blob binary"), "indexes")

    def search(blob: dict, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        for one, query, code in zip(ids.tolist(), vectors, coder.encode(vectors), strict=True):
            found, distances = search_index(blob, query, code, k, coder.radius, one)
            yield pa.RecordBatch.from_pydict({
                "query_id": pa.array([one] * len(found), pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(distances, pa.float64()),
            })

    asked = rows.where(queries).withColumn("bound", F.lit(0).cast("long")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    found = search_blocks(asked, shards, search, schema)
    return nearest(found, k, F.asc("score")).select("query_id", "rank", "vec_id", "score")
