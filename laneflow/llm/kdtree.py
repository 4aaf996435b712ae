"""Exact top-k by inner product with a KD-tree per shard.

Shards are cells of a KD partition fitted on a sample, so that their boxes are
tight; crowded cells are salted into several shards.  Every shard builds a tree:
median splits of the widest side down to small leaves, each node with the tight
box of its points.  A query first searches the shard it lies in.  Its k-th best
score then goes along to the other shards: those whose box cannot reach it are
not asked, and in the others the best-first traversal stops at the first node
whose bound is below it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from laneflow.llm.common import materialise
from laneflow.llm.vectors import clean_vectors, matrix, nearest, pack_arrays, sample_matrix, search_blocks

LEAF = 256
# Rows of a shard, on average; and the most shards, whose boxes every router holds.  Beyond
# SHARD_ROWS x MAX_SHARDS rows the shards grow instead.
SHARD_ROWS, MAX_SHARDS = 20_000, 4_096
NONE = np.iinfo(np.int64).min


# ------------------------------------------------------------------- partition


def fit_cells(sample: np.ndarray, cells: int, least: int = 16) -> list[tuple[int, float]]:
    """Median splits of a sample as a heap of (dimension, border); node i has the children 2i+1 and 2i+2."""
    depth = max(0, (cells - 1).bit_length())
    while depth and len(sample) >> depth < least:
        depth -= 1
    splits: list[tuple[int, float]] = []
    parts = [np.arange(len(sample))]
    for _ in range(depth):
        after = []
        for part in parts:
            points = sample[part]
            side = int((points.max(0) - points.min(0)).argmax()) if len(part) else 0
            border = float(np.median(points[:, side])) if len(part) else 0.0
            splits.append((side, border))
            left = points[:, side] <= border if len(part) else np.zeros(0, bool)
            after += [part[left], part[~left]]
        parts = after
    return splits


def cell_of(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    while len(points) and len(splits) > node[0]:
        sides = np.array([s for s, _ in splits])[node]
        borders = np.array([b for _, b in splits])[node]
        node = 2 * node + 1 + (points[np.arange(len(points)), sides] > borders)
    return node - len(splits)


# ------------------------------------------------------------------------ tree


def build_tree(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Arrays of a tree: points in leaf order, and for each node its box, range and left child (the right one follows)."""
    order = np.argsort(ids)
    lows, highs, ranges, lefts = [], [], [], []

    def add(start: int, stop: int) -> int:
        part = points[order[start:stop]]
        lows.append(part.min(0))
        highs.append(part.max(0))
        ranges.append((start, stop))
        lefts.append(-1)
        return len(ranges) - 1

    todo = [add(0, len(ids))]
    for node in todo:
        start, stop = ranges[node]
        spread = highs[node] - lows[node]
        if stop - start <= leaf or not spread.any():
            continue
        part, middle = order[start:stop], (stop - start) // 2
        order[start:stop] = part[np.argpartition(points[part, int(spread.argmax())], middle)]
        lefts[node] = add(start, start + middle)
        add(start + middle, stop)
        todo += [lefts[node], lefts[node] + 1]
    return {
        "ids": ids[order], "points": points[order], "low": np.array(lows), "high": np.array(highs),
        "range": np.array(ranges), "left": np.array(lefts),
    }


def exact_type(points: np.ndarray, query: np.ndarray) -> type:
    """Doubles where every product sum is exact in them, else 64-bit integers."""
    return np.float64 if float(np.abs(points).max(initial=0)) * float(np.abs(query).max(initial=0)) * points.shape[1] < 2**52 else np.int64


def search_tree(tree: dict[str, np.ndarray], query: np.ndarray, k: int, bound: int = NONE, skip: int | None = None) -> list[tuple[int, int]]:
    """The up to ``k`` best (score, id), none below ``bound``, without the id ``skip``.

    ``bound`` is a k-th score known from elsewhere.  Nodes whose bound equals the
    k-th score are still visited, since a tie may have a smaller id.
    """
    # Upper bounds of the inner product over all boxes; the traversal decides which nodes are opened.
    bounds = np.maximum(tree["low"] * query, tree["high"] * query).sum(1)
    best: list[tuple[int, int]] = []  # a heap of (score, -id)
    heap = [(-bounds[0], 0)]
    while heap:
        reach, node = heapq.heappop(heap)
        worst = max(bound, best[0][0]) if len(best) == k else bound
        if -reach < worst:
            break
        left = tree["left"][node]
        if left >= 0:
            for child in (left, left + 1):
                if bounds[child] >= worst:
                    heapq.heappush(heap, (-bounds[child], child))
            continue
        start, stop = tree["range"][node]
        scores = tree["points"][start:stop] @ query
        for at in np.flatnonzero(scores >= worst).tolist():
            entry = (int(scores[at]), -int(tree["ids"][start + at]))
            if -entry[1] == skip:
                continue
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


# ------------------------------------------------------------------ Spark jobs


def build_shards(rows: DataFrame, shard_rows: int = SHARD_ROWS, max_shards: int = MAX_SHARDS) -> tuple[DataFrame, DataFrame]:
    """Written tables: the rows (id, vec) with their shard, and each shard's tree."""
    total = rows.count()
    shard_rows = max(shard_rows, -(-total // max_shards))
    splits = fit_cells(sample_matrix(rows), -(-total // shard_rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = pa.array(cell_of(matrix(batch.column("vec")), splits), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], ["id", "vec", "cell"])

    placed = materialise(rows.select("id", "vec").mapInArrow(place, "id bigint, vec array<bigint>, cell int"), "cells")
    # At most as many rows as cells.  A cell gets a salt for each shard_rows rows in it.
    salts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("salts"))
    first = {}
    for r in sorted(salts.collect()):
        first[r["cell"]] = (sum(n for _, n in first.values()), r["salts"])
    lookup = F.create_map(*[F.lit(x) for cell, (at, n) in first.items() for x in (cell, at * (1 << 16) + n)]) if first else None
    code = lookup[F.col("cell")] if first else F.lit(1)
    shard = (F.shiftright(code, 16) + F.pmod(F.xxhash64("id"), code.bitwiseAND(0xFFFF))).cast("int")
    members = placed.withColumn("shard", shard).drop("cell")

    def grow(group: pa.Table) -> pa.Table:
        tree = build_tree(group.column("id").to_numpy(), matrix(group.column("vec").combine_chunks()))
        return pa.table({
            "shard": pa.array(group.column("shard")[:1].to_pylist(), pa.int32()), "low": pa.array([tree["low"][0]], pa.list_(pa.int64())),
            "high": pa.array([tree["high"][0]], pa.list_(pa.int64())), "blob": pa.array([pack_arrays(**tree)], pa.binary()),
        })

    trees = members.groupBy("shard").applyInArrow(grow, "shard int, low array<bigint>, high array<bigint>, blob binary")
    return members, materialise(trees, "trees")


def exact_top_k(df: DataFrame, key: str, vector: str, queries: Column, k: int, scale: float = 64.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` rows of highest inner product for each row that ``queries`` selects.

    ``queries`` is a condition on ``id``.  Components x become floor(scale * x);
    scores are their exact integer products as long as these fit 64 bits.  A row
    is no candidate of its own query.  Fewer candidates give fewer rows; ties go
    to the smaller id; an empty table gives none.  Which vectors take part:
    :func:`laneflow.llm.vectors.clean_vectors`.
    """
    clean = clean_vectors(df, key, vector)
    scaled = clean.select("id", F.transform("vec", lambda v: F.floor(v * scale)).alias("vec"))
    members, trees = build_shards(scaled, shard_rows)
    schema = "query_id bigint, vec array<bigint>, ids array<bigint>, scores array<bigint>"

    def search(blob: dict, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        kind = exact_type(blob["points"], vectors)
        tree = blob | {name: blob[name].astype(kind) for name in ("points", "low", "high")}
        finds = [search_tree(tree, v.astype(kind), k, int(b), int(i)) for i, v, b in zip(ids, vectors, bounds, strict=True)]
        yield pa.RecordBatch.from_pydict({
            "query_id": pa.array(ids, pa.int64()), "vec": pa.array(list(vectors), pa.list_(pa.int64())),
            "ids": pa.array([[i for _, i in f] for f in finds], pa.list_(pa.int64())),
            "scores": pa.array([[s for s, _ in f] for f in finds], pa.list_(pa.int64())),
        })

    asked = members.where(queries)
    at_home = materialise(search_blocks(asked.withColumn("bound", F.lit(int(NONE)).cast("long")), trees.select("shard", "blob"), search, schema), "home")

    # At most MAX_SHARDS boxes.
    boxes = trees.select("shard", "low", "high").toArrow()
    numbers, low, high = boxes.column("shard").to_numpy(), matrix(boxes.column("low").combine_chunks()), matrix(boxes.column("high").combine_chunks())

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, scores = matrix(batch.column("vec")), batch.column("scores").to_pylist()
            homes = batch.column("shard").to_numpy()
            rows: dict[str, list] = {"shard": [], "id": [], "vec": [], "bound": []}
            for i, (query, own) in enumerate(zip(batch.column("query_id").to_pylist(), scores, strict=True)):
                bound = own[-1] if len(own) == k else NONE
                kind = exact_type(np.maximum(np.abs(low), np.abs(high)), vectors[i])
                reach = np.maximum(low.astype(kind) * vectors[i].astype(kind), high.astype(kind) * vectors[i].astype(kind)).sum(1)
                for s in numbers[(reach >= bound) & (numbers != homes[i])].tolist():
                    for name, value in (("shard", s), ("id", query), ("vec", vectors[i]), ("bound", bound)):
                        rows[name].append(value)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(rows["shard"], pa.int32()), "id": pa.array(rows["id"], pa.int64()),
                "vec": pa.array(rows["vec"], pa.list_(pa.int64())), "bound": pa.array(rows["bound"], pa.int64()),
            })

    homes = at_home.join(asked.select(F.col("id").alias("query_id"), "shard"), "query_id")
    routed = materialise(homes.mapInArrow(route, "shard int, id bigint, vec array<bigint>, bound bigint"), "routed")
    elsewhere = search_blocks(routed, trees.select("shard", "blob"), search, schema)
    both = at_home.unionByName(elsewhere)
    rows = both.select("query_id", F.inline(F.arrays_zip("ids", "scores"))).select("query_id", F.col("ids").alias("vec_id"), F.col("scores").alias("score"))
    return nearest(rows, k, F.desc("score")).select("query_id", "rank", "vec_id", "score")
