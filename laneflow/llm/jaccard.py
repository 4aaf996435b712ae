"""Jaccard join of word n-gram sets by vertical partitioning of the global n-gram order.

The n-grams have one global order: rare ones first, by a count sketch of all
documents, then by hash.  Two sets of similarity t must share n-grams among the
first of either (the prefix), and at least a number of them that follows from
their sizes; pairs that do are candidates.  For candidates the order is cut into
fragments of equal mass: every set falls into segments, the overlap of each pair
is counted fragment by fragment, and the partial counts are summed per pair.

Equal sets are one class, so exact copies are never paired.  Within a group that
shares an n-gram, members are first compared with the group's most central
member only; what links is one component from then on, and only pairs between
different components are still candidates.  So a group of many near copies costs
about as many comparisons as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import Column, DataFrame, functions as F

from laneflow.llm.common import materialise, release, small_batches
from laneflow.llm.components import connected_components

WORDS, PERCENT = 5, 80
# Cells of the count sketch: what every task adds up, and the size of the order's broadcast in bytes.
CELL_BITS, BLOCKS = 22, 64
# Counts up to this are not told apart.
COMMON = 64
FRAGMENTS = 8
# Prefix entries that one task joins, on average, and that a task holds before it passes them on.
BUCKET_ENTRIES, HELD_ENTRIES = 2_000_000, 1_000_000
# Rounds of comparisons with central members before all pairs of components.
STAR_ROUNDS = 2

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


# ------------------------------------------------------------------- shingles


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base, and of its inverse, modulo 2**64; at least ``1 << bits`` of them."""
    size, inverse = 1 << bits, pow(_BASE, -1, 1 << 64)
    up, down = np.full(size, _BASE, _U), np.full(size, inverse, _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word: runs of other bytes than blanks, with A-Z in lower case."""
    data = np.frombuffer(text.encode().lower(), np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, _U)
    up, down = _powers(max(12, len(data).bit_length()))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)])])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of all runs of ``words`` words, or of the whole sequence if it is shorter."""
    hashes = word_hashes(text) if text else np.zeros(0, _U)
    run = min(words, len(hashes))
    if not run:
        return hashes
    total = np.full(len(hashes) - run + 1, run, _U)
    for i in range(run):
        total = total * _U(_BASE) + hashes[i : i + len(total)]
    return np.unique(mix(total))


def class_of(shingles: np.ndarray) -> int:
    """A number that equal sets share."""
    with np.errstate(over="ignore"):
        total = mix(shingles ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) + _U(len(shingles))
    return int(mix(np.array([total], _U)).view(np.int64)[0])


# ------------------------------------------------------------ the global order


@dataclass
class Order:
    """``ranks``: how common the n-grams of each cell are; ``mass``: the share of all n-grams before each rank and in it."""

    ranks: np.ndarray
    before: np.ndarray
    mass: np.ndarray

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Places in the order: the rank in the upper six bits, then the hash."""
        ranks = self.ranks[shingles >> _U(64 - CELL_BITS)].astype(_U)
        return (ranks << _U(58)) | (shingles >> _U(6))

    def fragments(self, keys: np.ndarray, n: int = FRAGMENTS) -> np.ndarray:
        ranks = (keys >> _U(58)).astype(np.int64)
        within = (keys & _U((1 << 58) - 1)).astype(np.float64) / 2.0**58
        return np.minimum(((self.before[ranks] + self.mass[ranks] * within) * n).astype(np.int64), n - 1)


def build_order(blocks: list[tuple[int, bytes]]) -> Order:
    cells = np.zeros(1 << CELL_BITS, np.int64)
    width = len(cells) // BLOCKS
    for block, data in blocks:
        cells[block * width : (block + 1) * width] = np.frombuffer(zlib.decompress(data), "<u4")
    common = max(COMMON, 2 * cells.mean())
    ranks = np.where(cells > common, np.log2(np.maximum(cells / common, 1)).astype(np.int64) + 1, 0)
    mass = np.bincount(ranks, cells, 64)
    mass = mass / max(mass.sum(), 1)
    return Order(ranks.astype(np.uint8), np.cumsum(mass) - mass, mass)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def needed_overlap(a: Column, b: Column, percent: int = PERCENT) -> Column:
    """The least intersection of two sets of sizes ``a`` and ``b`` that are similar enough."""
    return F.ceil((a + b) * percent / (100 + percent))


# ------------------------------------------------------------------ Spark jobs


def summarise(df: DataFrame, key: str, text: str, words: int = WORDS) -> tuple[DataFrame, Order]:
    """(key, n, cls) of every row, and the order of all n-grams."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    width = (1 << CELL_BITS) // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.uint32)
        empty = lambda n, kind: pa.nulls(n, kind)
        for batch in batches:
            sizes, classes = [], []
            for value in batch.column(1):
                shingles = shingle_set(value.as_py(), words)
                at, n = np.unique(shingles >> _U(64 - CELL_BITS), return_counts=True)
                cells[at] += n.astype(np.uint32)
                sizes.append(len(shingles))
                classes.append(class_of(shingles))
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), empty(m, pa.int32()), empty(m, pa.binary())],
                ["key", "n", "cls", "block", "counts"],
            )
        used = [b for b in range(BLOCKS) if cells[b * width : (b + 1) * width].any()]
        data = [zlib.compress(cells[b * width : (b + 1) * width].astype("<u4").tobytes(), 1) for b in used]
        m = len(used)
        yield pa.RecordBatch.from_arrays(
            [empty(m, pa.int64()), empty(m, pa.int64()), empty(m, pa.int64()), pa.array(used, pa.int32()), pa.array(data, pa.binary())],
            ["key", "n", "cls", "block", "counts"],
        )
        release()

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint32)
        for data in group.column("counts").to_pylist():
            total = np.maximum(total, total + np.frombuffer(zlib.decompress(data), "<u4"))
        return pa.table({"block": group.column("block")[:1], "counts": pa.array([zlib.compress(total.astype("<u4").tobytes(), 1)], pa.binary())})

    both = materialise(rows.mapInArrow(run, "key bigint, n bigint, cls bigint, block int, counts binary"), "summaries")
    sums = both.where("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(add, "block int, counts binary")
    order = build_order([(r["block"], r["counts"]) for r in sums.collect()])  # BLOCKS rows
    return both.where("block IS NULL").select("key", "n", "cls"), order


def shared_prefixes(df: DataFrame, text: str, order: Order, entries: int, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(token, cls, n): prefix n-grams that occur in the prefixes of two classes or more.

    Entries travel in blocks.  A bucket joins those of rare n-grams; n-grams known
    to be common are only unpacked, block by block, for Spark to spread as rows.
    """
    small_batches(df.sparkSession)
    n_buckets = max(8, -(-entries // BUCKET_ENTRIES))
    shared = df.sparkSession.sparkContext.broadcast(order)
    schema = "bucket int, tokens binary, members binary, classes binary, sizes binary"

    def emit(tokens: list, classes: list[int], sizes: list[int]) -> Iterator[pa.RecordBatch]:
        if not classes:
            return
        flat = np.concatenate(tokens)
        member = np.repeat(np.arange(len(classes), dtype=np.int32), [len(t) for t in tokens])
        cls, size = np.array(classes, np.int64), np.array(sizes, np.int32)
        bucket = np.where(flat >> _U(58) > 0, -1 - int(cls[0] % n_buckets), (mix(flat) % _U(n_buckets)).astype(np.int64))
        by = np.argsort(bucket, kind="stable")
        bounds = np.flatnonzero(np.diff(bucket[by], prepend=n_buckets))
        for part in np.split(by, bounds[1:]):
            used, local = np.unique(member[part], return_inverse=True)
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([int(bucket[part[0]])], pa.int32()), "tokens": pa.array([flat[part].tobytes()], pa.binary()),
                "members": pa.array([local.astype(np.int32).tobytes()], pa.binary()), "classes": pa.array([cls[used].tobytes()], pa.binary()),
                "sizes": pa.array([size[used].tobytes()], pa.binary()),
            })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tokens, classes, sizes, held = [], [], [], 0
        for batch in batches:
            for value in batch.column(0):
                shingles = shingle_set(value.as_py(), words)
                cls = class_of(shingles)
                if not len(shingles) or cls in seen:
                    continue
                seen.add(cls)
                keys = shared.value.keys(shingles)
                length = prefix_length(len(keys), percent)
                tokens.append(np.partition(keys, length - 1)[:length] if length < len(keys) else keys)
                classes.append(cls)
                sizes.append(len(keys))
                held += length
            if held >= HELD_ENTRIES:
                yield from emit(tokens, classes, sizes)
                tokens, classes, sizes, held = [], [], [], 0
        yield from emit(tokens, classes, sizes)
        release()

    def expand(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        member = np.frombuffer(row["members"], np.int32)
        return (np.frombuffer(row["tokens"], np.int64), np.frombuffer(row["classes"], np.int64)[member], np.frombuffer(row["sizes"], np.int32)[member])

    def as_rows(token: np.ndarray, cls: np.ndarray, size: np.ndarray) -> pa.Table:
        return pa.table({"token": pa.array(token, pa.int64()), "cls": pa.array(cls, pa.int64()), "n": pa.array(size.astype(np.int64), pa.int64())})

    def join(group: pa.Table) -> pa.Table:
        token, cls, size = (np.concatenate(x) for x in zip(*map(expand, group.to_pylist()), strict=True))
        if group.column("bucket")[0].as_py() < 0:
            return as_rows(token, cls, size)
        by = np.lexsort((cls, token))
        token, cls, size = token[by], cls[by], size[by]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])])
        token, cls, size = token[new], cls[new], size[new]
        follows = np.concatenate([[False], token[1:] == token[:-1], [False]])
        several = follows[:-1] | follows[1:]
        return as_rows(token[several], cls[several], size[several])

    def meet(group: pa.Table) -> pa.Table:
        met = join(group)
        release()
        return met

    blocks = df.select(F.col(f"`{text}`")).mapInArrow(run, schema)
    met = blocks.groupBy("bucket").applyInArrow(meet, "token bigint, cls bigint, n bigint")
    # Common n-grams come once per block.
    met = materialise(met, "met")
    rare = F.shiftrightunsigned("token", 58) == 0
    return met.where(rare).unionByName(met.where(~rare).distinct())


def count_overlaps(pairs: DataFrame, segments: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that are similar enough: partial counts of each fragment, summed per pair.

    ``segments``: cls, n, fragment and the sorted hashes in it.
    """
    one = segments.select(F.col("cls").alias("a"), "fragment", F.col("n").alias("na"), F.col("hashes").alias("ha"))
    two = segments.select(F.col("cls").alias("b"), "fragment", F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    cells = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
    partial = cells.join(one, ["a", "fragment"]).join(two, ["b", "fragment"]).select(
        "a", "b", "fragment", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("part")
    ).distinct()  # rows that are repeated must not count twice
    return partial.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("part").alias("overlap")).where(
        F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * percent
    ).select("a", "b")


def similar_sizes(a: str, b: str, percent: int = PERCENT) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def jaccard_components(df: DataFrame, key: str, text: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row.

    A row's set are the distinct runs of ``words`` words (fewer words: the whole
    sequence).  Rows link when 100 * intersection >= ``percent`` * union, and
    ``component_id`` is the smallest key that a row reaches over links.  Rows
    without a word, null texts too, link with nothing: they keep their own key.
    Repeated rows are rows of one component; null keys are kept and name no
    component.  Texts are read whole; an empty table gives no rows.
    """
    rows, order = summarise(df, key, text, words)
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("key").alias("least"), F.first("n").alias("n"))
    entries = rows.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    shared = shared_prefixes(df, text, order, entries, words, percent)

    central = shared.groupBy("cls").agg(F.count(F.lit(1)).alias("shares"))
    members = materialise(shared.join(central, "cls"), "members")

    # Pairs with the central members, and all others that would be left if these linked: whoever is in them
    # gets its segments, and all are counted.
    stars = materialise(star_pairs(members.withColumn("comp", F.col("cls")), percent, 0), "pairs")
    pairs = stars.unionByName(materialise(remaining_pairs(with_components(members, components_of(stars)), percent), "pairs")).distinct()
    pairs = materialise(pairs, "pairs")
    partners = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    segments = materialise(segment_sets(df, key, text, partners.join(classes, "cls").select("cls", F.col("least").alias("k")), order, words), "segments")
    links = materialise(count_overlaps(pairs, segments, percent), "links")
    labels, tried = components_of(links), pairs
    # Where a star did not hold, its members, which have their segments, meet again.
    for number in range(1, STAR_ROUNDS + 1):
        current = with_components(members, labels)
        again = star_pairs(current, percent, number) if number < STAR_ROUNDS else remaining_pairs(current, percent)
        again = materialise(again.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(again)
        links = links.unionByName(materialise(count_overlaps(again, segments, percent), "links"))
        labels = components_of(links)

    named = classes.join(labels, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cls"))
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    answer = named.join(smallest, "comp").select("cls", "component_id")
    return rows.join(answer, "cls", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id")
    )


def star_pairs(current: DataFrame, percent: int, number: int) -> DataFrame:
    """Each member with the head of most of its groups, if it is in another component and shares enough with it.

    First the heads are the members that share most of their prefix; in later rounds they are drawn anew.
    """
    if number:
        rank = F.xxhash64(F.lit(number), "comp").cast("double")
    else:
        rank = F.col("shares") / (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    heads = current.groupBy("token").agg(F.max(F.struct(rank.alias("rank"), "cls", "n", "comp")).alias("head"))
    met = current.join(heads, "token").where((F.col("head.comp") != F.col("comp")) & similar_sizes("n", "head.n", percent))
    counted = met.groupBy("cls", F.col("head.cls").alias("other")).agg(
        F.count(F.lit(1)).alias("times"), F.first("n").alias("na"), F.first("head.n").alias("nb")
    ).where(F.col("times") >= least_shared("na", "nb", percent))
    best = counted.groupBy("cls").agg(F.max(F.struct("times", "other")).getField("other").alias("other"))
    return best.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()


def least_shared(a: str, b: str, percent: int = PERCENT) -> Column:
    """Prefix n-grams that similar sets of these sizes share at least.

    Those of the intersection behind one prefix are at most all behind it; up to
    the end of the prefix that ends first, the others are in both.
    """
    behind = lambda n: F.ceil(F.col(n) * percent / 100) - 1
    return needed_overlap(F.col(a), F.col(b), percent) - F.greatest(behind(a), behind(b))


def components_of(links: DataFrame) -> DataFrame:
    return materialise(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "labels")


def with_components(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cls")).drop("node", "component")


def remaining_pairs(current: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All pairs of different components that share as many prefix n-grams as similar sets must.

    In each group the members outside its largest component meet all others.
    """
    sizes = current.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("size", "comp")).getField("comp").alias("major"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    mixed = current.join(largest, "token")
    few = mixed.where("comp <> major").select("token", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("shares").alias("sa"))
    all_of = mixed.select("token", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("shares").alias("sb"), (F.col("comp") == F.col("major")).alias("big"))
    # No pair shares more than either of the two shares with anybody.
    enough = F.least("sa", "sb") >= least_shared("na", "nb", percent)
    met = few.join(all_of, "token").where(
        (F.col("ca") != F.col("cb")) & (F.col("big") | (F.col("a") < F.col("b"))) & similar_sizes("na", "nb", percent) & enough
    )
    pairs = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.count(F.lit(1)).alias("times"), F.first("na").alias("na"), F.first("nb").alias("nb")
    )
    return pairs.where(F.col("times") >= least_shared("na", "nb", percent)).select("a", "b")


def segment_sets(df: DataFrame, key: str, text: str, partners: DataFrame, order: Order, words: int = WORDS) -> DataFrame:
    """(cls, n, fragment, hashes) of the rows with key k of each class in ``partners`` (cls, k); repeated rows repeat them."""
    shared = df.sparkSession.sparkContext.broadcast(order)
    docs = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("text"))
    asked = docs.join(partners, docs["k"].eqNullSafe(partners["k"])).select("cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"cls": [], "n": [], "fragment": [], "hashes": []}
            for cls, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shingles = shingle_set(value.as_py(), words)
                if class_of(shingles) != cls:  # another row with the key
                    continue
                keys = np.sort(shared.value.keys(shingles))
                fragment = shared.value.fragments(keys)
                for f in range(FRAGMENTS):
                    rows["cls"].append(cls)
                    rows["n"].append(len(keys))
                    rows["fragment"].append(f)
                    rows["hashes"].append(keys[fragment == f].view(np.int64))
            yield pa.RecordBatch.from_pydict({
                "cls": pa.array(rows["cls"], pa.int64()), "n": pa.array(rows["n"], pa.int64()), "fragment": pa.array(rows["fragment"], pa.int32()),
                "hashes": pa.array(rows["hashes"], pa.list_(pa.int64())),
            })
        release()

    return asked.mapInArrow(run, "cls bigint, n bigint, fragment int, hashes array<bigint>")
