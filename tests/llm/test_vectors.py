import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import SF, needs_tables
from laneflow.llm import hashing, kdtree, queries
from laneflow.llm.vectors import clean_vectors

SCHEMA = "vec_id bigint, embedding array<float>, shard string, id string, vec string"
AWKWARD = [
    (20, [1.0, 2.0]), (40, [1.0, 2.0]), (40, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.5]), (3, None), (60, [0.0, 0.0]), (4, [float("nan"), 1.0]),
    (80, [float("inf"), 1.0]), (5, [None, 1.0]), (100, []), (6, [1.0]), (7, [3.0, -2.0]), (7, [3.0, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0]), (200, [0.5, 0.25]),
]


def table(spark, rows):
    return spark.createDataFrame([(i, v, "?", "?", "?") for i, v in rows], SCHEMA)


def tops(rows, every, k, score, better, zeros=True):
    kept = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and len(v) == 2 and (zeros or any(v)):
            kept[i] = max(tuple(v), kept.get(i, tuple(v)))
    out = []
    for q, a in kept.items():
        if q % every == 0:
            ranked = sorted(((score(a, b), i) for i, b in kept.items() if i != q), key=lambda x: (better * x[0], x[1]))
            out += [(q, rank, i, s) for rank, (s, i) in enumerate(ranked[:k], 1)]
    return sorted(out)


def test_awkward_vectors(spark):
    score = lambda a, b: sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b))
    for k in (1, 3, 50):
        rows = kdtree.exact_top_k(table(spark, AWKWARD), "vec_id", "embedding", F.col("id") % 20 == 0, k).collect()
        assert sorted(map(tuple, rows)) == tops(AWKWARD, 20, k, score, -1)
    assert kdtree.exact_top_k(table(spark, []), "vec_id", "embedding", F.col("id") % 20 == 0, 5).count() == 0
    rows = hashing.approximate_nearest(table(spark, AWKWARD), "vec_id", "embedding", F.col("id") % 100 == 0, 50, bits=16).collect()
    assert sorted(map(tuple, rows)) == tops(AWKWARD, 100, 50, math.dist, 1, zeros=False)
    assert hashing.approximate_nearest(table(spark, []), "vec_id", "embedding", F.col("id") % 100 == 0, 5).count() == 0
    assert clean_vectors(table(spark, []), "vec_id", "embedding").count() == 0


def test_several_shards_and_a_crowded_one(spark):
    rng = np.random.default_rng(1)
    points = np.round(rng.normal(size=(600, 5)), 1)
    points[:200] = points[0]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id bigint, embedding array<float>")
    rows = kdtree.exact_top_k(df, "vec_id", "embedding", F.col("id") % 50 == 0, 7, shard_rows=90).collect()
    whole = np.floor(64 * points.astype(np.float32).astype(np.float64)).astype(int)
    for q in range(0, 600, 50):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(600), -scores)) if i != q][:7]
        assert [(r["vec_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, scores[i]) for i in order]


def test_tree():
    rng = np.random.default_rng(2)
    for points in (rng.integers(-50, 50, (700, 3)), np.ones((600, 3), np.int64), rng.integers(0, 2, (500, 4)), rng.integers(-(2**30), 2**30, (400, 3))):
        tree = kdtree.build_tree(np.arange(len(points)), points, leaf=8)
        for node, (start, stop) in enumerate(tree["range"]):
            part = tree["points"][start:stop]
            assert (part.min(0) == tree["low"][node]).all() and (part.max(0) == tree["high"][node]).all()
        for q in points[:5]:
            scores = points @ q
            order = np.lexsort((np.arange(len(points)), -scores))[:9]
            assert kdtree.search_tree(tree, q, 9) == [(int(scores[i]), int(i)) for i in order]
            bound = int(scores[order[3]])
            assert kdtree.search_tree(tree, q, 9, bound) == [(int(scores[i]), int(i)) for i in order if scores[i] >= bound]
    assert kdtree.exact_type(np.full((2, 4), 2**30), np.full(4, 2**30)) is np.int64


def test_cells_cover_all_points():
    rng = np.random.default_rng(3)
    splits = kdtree.fit_cells(rng.normal(size=(500, 3)), 8)
    cells = kdtree.cell_of(rng.normal(size=(2000, 3)), splits)
    assert set(cells) == set(range(8)) and np.bincount(cells).max() < 500
    assert (kdtree.cell_of(rng.normal(size=(5, 3)), []) == 0).all() and kdtree.fit_cells(np.zeros((0, 0)), 4) == []


@pytest.mark.parametrize("radius", [0, 1, 5, 11, 17, 40, 64])
def test_probing_finds_every_code_within_the_radius(radius):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(800, 64))
    coder = hashing.fit_coder(points, 64, 10)
    index = hashing.build_index(np.arange(800), points, coder)
    for code in coder.encode(points[:4] + 0.2 * rng.normal(size=(4, 64))):
        distance = np.bitwise_count(index["codes"] ^ code).sum(1)
        assert hashing.within_radius(index, code, radius).tolist() == np.flatnonzero(distance <= radius).tolist()


def test_radius_grows_where_too_few_are_near():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(40, 16))
    coder = hashing.fit_coder(points, 16, 5)
    index = hashing.build_index(np.arange(40), points, coder)
    ids, distances = hashing.search_index(index, points[0], coder.encode(points[:1])[0], 39, 0, 0)
    assert sorted(ids) == list(range(1, 40)) and (np.diff(distances) >= 0).all()


@needs_tables
def test_queries(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, points = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float32).astype(np.float64)
    whole = np.floor(64 * points).astype(int)
    top = queries.QUERIES["op9_kd_tree_top_k"](spark, SF).collect()
    near = queries.QUERIES["op10_multi_index_hashing"](spark, SF).collect()
    assert {r["query_id"] for r in top} == set(ids[ids % 20 == 0]) and {r["query_id"] for r in near} == set(ids[ids % 100 == 0])
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:20]
        assert [(r["vec_id"], r["score"]) for r in sorted(top, key=lambda r: r["rank"]) if r["query_id"] == ids[q]] == [(ids[i], scores[i]) for i in order]
    for q in np.flatnonzero(ids % 100 == 0):
        distances = np.sqrt(((points - points[q]) ** 2).sum(1))
        order = {ids[i] for i in np.lexsort((ids, distances)) if i != q}
        best = [ids[i] for i in np.lexsort((ids, distances)) if i != q][:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in near if r["query_id"] == ids[q])
        assert len(mine) == 10 and {v for _, v, _ in mine} <= order
        assert all(s == distances[np.searchsorted(ids, v)] for _, v, s in mine)
        hits += len(set(best) & {v for _, v, _ in mine})
    assert hits / (10 * (ids % 100 == 0).sum()) >= 0.9
