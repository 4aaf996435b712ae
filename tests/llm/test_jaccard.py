import random
import re

import numpy as np
import pytest

from cases import AWKWARD, SF, documents, needs_tables
from laneflow.llm import jaccard, queries
from laneflow.llm.components import connected_components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    run = min(5, len(words))
    return frozenset(tuple(words[i : i + run]) for i in range(len(words) - run + 1)) if run else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    names = {}
    for i, (number, _) in enumerate(rows):
        if number is not None:
            names[find(i)] = min(number, names.get(find(i), number))
    return sorted((-1 if n is None else n, len(sets[i]), -1 if (c := names.get(find(i)) if sets[i] else n) is None else c) for i, (n, _) in enumerate(rows))


def found(spark, rows, clashes=False):
    none = lambda x: -1 if x is None else x
    out = jaccard.jaccard_components(documents(spark, rows, clashes), "doc_id", "text").collect()
    return sorted((none(r["doc_id"]), r["n_shingles"], none(r["component_id"])) for r in out)


def test_sets():
    for text in [None, "", " \n", "a", "A b", "a b c d e f a b c d e", "É x\x1cy \xa0 z w v", "q " * 900]:
        assert len(jaccard.shingle_set(text)) == len(shingles(text))
    assert (jaccard.shingle_set("A B c") == jaccard.shingle_set("a\tb\n C")).all() and len(np.intersect1d(jaccard.shingle_set("a b"), jaccard.shingle_set("b a"))) == 0


def test_awkward_documents(spark):
    assert found(spark, AWKWARD, clashes=True) == brute(AWKWARD)
    assert found(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_against_comparing_all_pairs(spark, seed):
    """Near copies around the border, chains of them, and a passage that many share."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(400)}"
    rows, passage = [], " ".join(word() for _ in range(12))
    for family in range(12):
        text = [word() for _ in range(draw.choice([6, 30, 60]))]
        for _ in range(draw.randint(1, 8)):
            for _ in range(draw.randint(0, 2)):
                text[draw.randrange(len(text))] = word()
            rows.append((draw.randrange(10_000), " ".join(text)))
        rows.append((draw.randrange(10_000), passage + " " + " ".join(word() for _ in range(30))))
    assert found(spark, rows) == brute(rows)


def test_many_near_copies_need_few_comparisons(spark):
    """A group of n members must not cost n * n comparisons."""
    draw = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        text = list(base)
        text[draw.randrange(200)] = f"own{i}"
        rows.append((i, " ".join(text)))
    seen = []
    real = jaccard.count_overlaps

    def counting(pairs, segments, percent):
        seen.append(pairs.count())
        return real(pairs, segments, percent)

    jaccard.count_overlaps = counting
    try:
        assert {c for _, _, c in found(spark, rows)} == {0}
    finally:
        jaccard.count_overlaps = real
    assert sum(seen) < 4 * len(rows)


def test_fragments_follow_the_order():
    order = jaccard.build_order([])
    keys = np.sort(order.keys(jaccard.shingle_set(" ".join(map(str, range(500))))))
    assert (np.diff(order.fragments(keys)) >= 0).all()


def test_components(spark):
    draw = random.Random(3)
    links = [(draw.randrange(80), draw.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    rows = connected_components(spark.createDataFrame(links, "u bigint, v bigint")).collect()
    assert {r["node"]: r["component"] for r in rows} == {n: find(n) for a, b in links if a != b for n in (a, b)}
    assert len(rows) == len({r["node"] for r in rows})
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@needs_tables
def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.QUERIES["op8_vertical_jaccard_join"](spark, SF).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == brute(docs)
