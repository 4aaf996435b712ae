"""Removal of long repeated strings with suffix arrays by linear grouping construction.

A byte goes when it lies in a string of 50 bytes that also starts in a document
with a smaller id.  No task can hold a suffix array of everything, so the work
is cut by content: of the 20-byte strings in each 50-byte string the one with
the smallest hash is its anchor, and equal strings have equal anchors.

1. Anchors of all documents meet by hash; only those in two documents or more
   matter, and their documents learn which, by way of the block of documents that asked.
2. Up to 30 bytes to either side of such an anchor decide all 50-byte strings that
   it is the anchor of.  Distinct contexts of an anchor meet, each with the smallest id it
   comes from.  Where an anchor has one context only, all strings in it are equal.
   Otherwise the suffix array of the contexts tells which strings of different
   contexts are equal.
3. Documents get back, per context, the smallest id of each string, and drop
   what a smaller id than theirs covers.

Whatever many documents share travels once per block of documents, so a string
that a third of all documents hold is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from laneflow.llm.common import fresh, release, small_batches
from laneflow.llm.jaccard import _powers, mix

LENGTH, ANCHOR = 50, 20
SIDE = LENGTH - ANCHOR
# Anchors held by a task before it passes them on, and joined by one task on average.
HELD, BUCKET = 400_000, 500_000
# Bytes of text per distinct anchor, roughly; and symbols in one suffix array.
PER_ANCHOR, SYMBOLS = 16, 200_000
_U = np.uint64
_NEVER = np.iinfo(np.int64).max


# ---------------------------------------------------------------- suffix array


def suffix_array(text: list[int]) -> list[int]:
    """The order of all suffixes of ``text`` (numbers from 0), by linear grouping construction.

    A group holds suffixes with the same Lyndon prefix; its number is where it
    begins in the final order.  First groups are made by first symbol and worked
    off from the largest down: each member points to the nearest suffix on its
    left in a smaller group, and the suffixes pointed at leave their groups for
    new ones just above, those pointed at most often first.  Then every group's
    own order follows from the smallest suffix up: a suffix that is in place
    decides the next places of the groups of those that end where it begins.
    """
    n = len(text)
    if n < 2:
        return list(range(n))
    symbols = np.asarray(text, np.int64)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sizes = np.diff(np.append(begins, n))
    number = np.empty(n, np.int64)
    number[order] = np.repeat(begins, sizes)
    group, members = number.tolist(), order.tolist()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place = place.tolist()
    size = [0] * n
    for b, s in zip(begins.tolist(), sizes.tolist(), strict=True):
        size[b] = s
    smaller = [-1] * n  # previous-smaller pointers

    def rise(chosen: list[int]) -> None:
        """Move suffixes of one group into a new group right above what is left of it."""
        old = group[chosen[0]]
        left = size[old] - len(chosen)
        new = old + left
        if not left:
            return
        last = old + size[old] - 1
        for suffix in chosen:
            other, hole = members[last], place[suffix]
            members[hole], place[other] = other, hole
            members[last], place[suffix] = suffix, last
            group[suffix] = new
            last -= 1
        size[old], size[new] = left, len(chosen)

    end = n
    while end:
        first = group[members[end - 1]]
        if end - first == 1:
            suffix = members[first]
            j = suffix - 1
            while j >= 0 and group[j] >= first:
                j = smaller[j]
            smaller[suffix] = j
            if j >= 0 and size[group[j]] > 1:
                rise([j])
        else:
            times: dict[int, int] = {}
            for suffix in sorted(members[first:end]):
                j = suffix - 1
                while j >= 0 and group[j] >= first:
                    j = smaller[j]
                smaller[suffix] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            sets: dict[tuple[int, int], list[int]] = {}
            for j, count in times.items():
                sets.setdefault((-count, group[j]), []).append(j)
            for key in sorted(sets) if len(sets) > 1 else sets:
                rise(sets[key])
        end = first

    # The empty suffix comes first: what ends at the end of the text is placed before all else.
    result, free, placed = [0] * n, list(range(n)), [False] * n
    at = -1
    while at < n:
        j = (n if at < 0 else result[at]) - 1
        while j >= 0 and not placed[j]:
            number = group[j]
            result[free[number]] = j
            free[number] += 1
            placed[j] = True
            j = smaller[j]
        at += 1
    return result


# --------------------------------------------------------------------- anchors


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors, and the hash of its anchor for each string of 50 bytes.

    Equal strings have equal anchors at equal places.
    """
    span = SIDE + 1
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
    numbers = np.frombuffer(data, np.uint8).astype(_U) + _U(1)
    up, down = _powers(max(12, len(data).bit_length()))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(numbers * up[: len(data)])])
    hashes = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: len(data) - ANCHOR + 1])
    least = _sliding(np.minimum, hashes, span)
    # A string is an anchor if it is the least of some window around it.
    padded = np.concatenate([np.zeros(span - 1, _U), least, np.zeros(span - 1, _U)])
    at = np.flatnonzero(_sliding(np.maximum, padded, span) == hashes)
    return at, hashes[at], least


def _sliding(pick: np.ufunc, values: np.ndarray, span: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= span:
        values, reach = pick(values[:-reach], values[reach:]), reach * 2
    return pick(values[: len(values) - (span - reach)], values[span - reach :]) if reach < span else values


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    edges = np.flatnonzero(values[1:] != values[:-1]) + 1
    return (np.concatenate([[0], edges]), np.append(edges, len(values))) if len(values) else (edges, edges)


# Anchors travel as the upper 48 bits of their hash: those of one bucket, in order, have upper bytes that hardly differ.
_LOWER = _U(16)


def _planes(values: np.ndarray) -> bytes:
    """Numbers as their lowest bytes, then their second bytes, and so on, which Spark's compression shortens."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unplaned(data: bytes | np.ndarray, kind: np.dtype) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def _split48(values: np.ndarray) -> bytes:
    """Numbers of 48 bits, by planes."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _join48(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(6, -1).T
    return wide.reshape(-1).view("<u8")


def _press(records: np.ndarray) -> bytes:
    """Records field by field, numbers by planes, compressed: far smaller than what Spark's compression makes of records."""
    fields = [records[name] for name in records.dtype.names]
    plain = b"".join(f.tobytes() if f.ndim > 1 else _planes(np.ascontiguousarray(f)) for f in fields)
    return len(records).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _unpress(data: bytes, kind: np.dtype) -> np.ndarray:
    n, at = int.from_bytes(data[:8], "little"), 0
    records = np.empty(n, kind)
    plain = np.frombuffer(pa.decompress(data[8:], n * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
    for name in kind.names:
        part = plain[at : at + n * kind[name].itemsize]
        records[name] = part.reshape(n, -1) if kind[name].shape else _unplaned(part, kind[name])
        at += len(part)
    return records


def _block(number: int) -> int:
    """The name of a task's block of rows, mixed one to one, so that blocks spread over the buckets."""
    return int(mix(np.array([TaskContext.get().partitionId() << 32 | number], _U)).view(np.int64)[0])


_SEVERAL = 0xFFFF
_ANNOUNCED = "bucket int, block bigint, hashes binary, owners binary, keys binary"


def _announce(n_buckets: int):
    """Rows (key, data) to the distinct anchors of each block of rows, by bucket."""

    def flush(hashes: list, keys: list[int], number: int) -> Iterator[pa.RecordBatch]:
        if not keys:
            return
        block = _block(number)
        owner = np.repeat(np.arange(len(keys)), [len(h) for h in hashes])
        flat, key = np.concatenate(hashes), np.array(keys, np.int64)
        by = np.argsort(flat, kind="stable")
        flat, owner = flat[by], owner[by]
        begins, ends = _groups(flat)
        counts = ends - begins
        several = counts > 1
        first = np.where(several, _SEVERAL, owner[begins])
        distinct = flat[begins]
        bucket = ((distinct >> _U(40)) * _U(n_buckets) >> _U(24)).astype(np.int64)
        edges = np.searchsorted(bucket, np.arange(n_buckets + 1))
        rows = [(b, distinct[x:y], first[x:y]) for b, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if y > x]
        # What several rows of this block hold needs no answer from elsewhere.
        known = np.repeat(several, counts)
        if known.any():
            rows.append((-1 - block % n_buckets, flat[known], owner[known]))
        for b, h, o in rows:
            used, local = np.unique(o[o != _SEVERAL], return_inverse=True)
            places = np.full(len(o), _SEVERAL, "<u2")
            places[o != _SEVERAL] = local
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([b], pa.int32()), "block": pa.array([block], pa.int64()), "hashes": pa.array([_split48(h >> _LOWER)], pa.binary()),
                "owners": pa.array([_planes(places)], pa.binary()), "keys": pa.array([_planes(key[used])], pa.binary()),
            })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keys, held, block = [], [], 0, 0
        for batch in batches:
            for key, data in zip(batch.column("key").to_pylist(), batch.column("data"), strict=True):
                found = np.unique(anchors(data.as_py())[1])
                if not len(found):
                    continue
                hashes.append(found)
                keys.append(key)
                held += len(found)
                if held >= HELD or len(keys) >= 60_000:
                    yield from flush(hashes, keys, block)
                    hashes, keys, held, block = [], [], 0, block + 1
        yield from flush(hashes, keys, block)
        del hashes
        release()

    return run


_REPLY = "block bigint, hashes binary, keys binary"


def _meet(group: pa.Table) -> pa.Table:
    """The anchors of a bucket that lie in several rows, with the rows, for each block that asked."""
    hashes, keys, known = [], [], []
    blocks = group.column("block").to_numpy()
    for row in group.to_pylist():
        owner, values = _unplaned(row["owners"], "<u2").astype(np.int64), _unplaned(row["keys"], "<i8")
        many = owner == _SEVERAL
        hashes.append(_join48(row["hashes"]))
        keys.append(np.where(many, 0, values[np.where(many, 0, owner)]) if len(values) else np.zeros(len(owner), np.int64))
        known.append(many)
    home = np.repeat(np.arange(len(blocks)), [len(h) for h in hashes])
    flat, key, many = (np.concatenate(x) for x in (hashes, keys, known))
    if group.column("bucket")[0].as_py() >= 0:
        by = np.argsort(flat, kind="stable")
        flat, key, many, home = flat[by], key[by], many[by], home[by]
        begins, ends = _groups(flat)
        low, high = (pick.reduceat(np.where(many, other, key), begins) for pick, other in ((np.minimum, _NEVER), (np.maximum, -_NEVER)))
        shared = np.logical_or.reduceat(many, begins) | (high > low)
        keep = np.repeat(shared, ends - begins) & ~many
        flat, key, home = flat[keep], key[keep], home[keep]
    by = np.lexsort((key, home))
    flat, key, home = flat[by], key[by], home[by]
    begins, ends = _groups(home)
    return pa.table({
        "block": pa.array(blocks[home[begins]], pa.int64()),
        "hashes": pa.array([_split48(flat[a:b]) for a, b in zip(begins, ends, strict=True)], pa.binary()),
        "keys": pa.array([_planes(key[a:b]) for a, b in zip(begins, ends, strict=True)], pa.binary()),
    })


_ASKED = "key bigint, hashes binary"


def _hand_out(group: pa.Table) -> pa.Table:
    """What all buckets answered a block, once per row of the block."""
    flat = np.concatenate([_join48(d) for d in group.column("hashes").to_pylist()])
    key = np.concatenate([_unplaned(d, "<i8") for d in group.column("keys").to_pylist()])
    by = np.lexsort((flat, key))
    flat, key = flat[by], key[by]
    begins, ends = _groups(key)
    return pa.table({
        "key": pa.array(key[begins], pa.int64()),
        "hashes": pa.array([_split48(flat[a:b]) for a, b in zip(begins, ends, strict=True)], pa.binary()),
    })


# -------------------------------------------------------------------- contexts

_OFFSETS = np.arange(SIDE + 1)
_CONTEXTS = "bucket int, block bigint, part int, data binary"
_FIELDS = (("anchor", "<u8"), ("left", f"({SIDE},)u1"), ("right", f"({SIDE},)u1"), ("lefts", "u1"), ("rights", "u1"), ("several", "u1"), ("id", "<i8"), ("at", "<i4"))
_CONTEXT = np.dtype([(n, t) for n, t in _FIELDS])
_PLACE = np.dtype([("row", "<i4"), ("at", "<i4"), ("context", "<i4")])
_ROW = np.dtype([("key", "<i8"), ("id", "<i8")])
_RUN = np.dtype([("at", "<i4"), ("first", "u1"), ("last", "u1"), ("id", "<i8")])
HELD_CONTEXTS = 60_000
# Rows that are unfolded to windows at a time; buckets of contexts for each bucket of anchors.
UNFOLDED, FINER = 20_000, 4


def _weights(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) + _U(salt)) | _U(1)


_WL, _WR = _weights(SIDE, 1000), _weights(SIDE, 2000)


def _weighed(letters: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A hash of each row of letters, column by column to hold little."""
    total = np.zeros(len(letters), _U)
    for j, weight in enumerate(weights):
        total += (letters[:, j].astype(_U) + _U(1)) * weight
    return total


def _digest(contexts: np.ndarray) -> np.ndarray:
    """One number per anchor and context."""
    x = contexts["anchor"] + _weighed(contexts["left"], _WL) + _weighed(contexts["right"], _WR)
    return mix(x + contexts["lefts"].astype(_U) * _U(0x9E3779B97F4A7C15) + contexts["rights"].astype(_U) * _U(0xC2B2AE3D27D4EB4F))


def _cut_contexts(n_buckets: int):
    """Rows (key, id, data, list of repeated anchors) to the distinct contexts of each block, and where they are.

    A block is named by its task and number, not by its rows: copies of one row may begin several blocks.
    """

    def flush(parts: list, places: list, rows: list, number: int) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        contexts, place = np.concatenate(parts), np.concatenate(places)
        digest = _digest(contexts)
        by = np.argsort(digest, kind="stable")
        digest = digest[by]
        begins, ends = _groups(digest)
        distinct = contexts[by[begins]]
        distinct["id"] = np.minimum.reduceat(contexts["id"][by], begins)
        distinct["several"] = distinct["id"] != np.maximum.reduceat(contexts["id"][by], begins)
        # In the order of their anchors, which is that of the buckets.
        order = np.argsort(distinct["anchor"], kind="stable")
        distinct, rank = distinct[order], np.argsort(order)
        distinct["at"] = np.arange(len(distinct))
        place["context"][by] = np.repeat(rank, ends - begins)
        row, block = np.array(rows, _ROW), _block(number)
        bucket = ((distinct["anchor"] >> _U(40)) * _U(n_buckets) >> _U(24)).astype(np.int64)
        edges = np.searchsorted(bucket, np.arange(n_buckets + 1))
        out = [(b, 0, _press(distinct[x:y])) for b, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if y > x]
        spread = -1 - block % n_buckets
        out += [(spread, 1, _press(place)), (spread, 2, _press(row))]
        for b, part, data in out:
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([b], pa.int32()), "block": pa.array([block], pa.int64()), "part": pa.array([part], pa.int32()), "data": pa.array([data], pa.binary()),
            })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, places, rows, held, block = [], [], [], 0, 0
        for batch in batches:
            for r in range(batch.num_rows):
                key, number, data, wanted = (batch.column(c)[r].as_py() for c in ("key", "id", "data", "hashes"))
                at, hashes, least = anchors(data)
                asked = np.isin(hashes >> _LOWER, np.concatenate([_join48(w) for w in wanted]))
                at, hashes = at[asked], hashes[asked]
                if not len(at):
                    continue
                padded = np.concatenate([np.zeros(SIDE, np.uint8), np.frombuffer(data, np.uint8), np.zeros(SIDE, np.uint8)])
                made = np.zeros(len(at), _CONTEXT)
                made["anchor"], made["id"] = hashes, number
                made["left"] = padded[at[:, None] + np.arange(SIDE)]
                made["right"] = padded[at[:, None] + (SIDE + ANCHOR) + np.arange(SIDE)]
                # The strings it is the anchor of are neighbours; what they don't reach is blank.
                begin = at[:, None] - _OFFSETS
                owned = (begin >= 0) & (begin < len(least)) & (least[np.clip(begin, 0, len(least) - 1)] == hashes[:, None])
                made["lefts"] = SIDE - owned[:, ::-1].argmax(1)
                made["rights"] = SIDE - owned.argmax(1)
                made["left"] *= np.arange(SIDE)[::-1] < made["lefts"][:, None]
                made["right"] *= np.arange(SIDE) < made["rights"][:, None]
                where = np.zeros(len(at), _PLACE)
                where["row"], where["at"] = len(rows), at
                parts.append(made)
                places.append(where)
                rows.append((key, number))
                held += len(at)
                if held >= HELD_CONTEXTS:
                    yield from flush(parts, places, rows, block)
                    parts, places, rows, held, block = [], [], [], 0, block + 1
        yield from flush(parts, places, rows, block)
        del parts, places
        release()

    return run


# A window of 50 bytes with ``o`` of them left of the anchor is SIDE + 1 symbols long here, where the
# anchor is one symbol.  Windows are taken in few neighbouring ``o`` at a time, from ``low`` to ``high``: contexts
# share one only if ``low`` letters left and SIDE - ``high`` right of the anchor agree, so these make groups, and a
# context that is alone in its group is done with.  Contexts that agree in all that such windows reach are one.
_STEPS = [(low, min(low + 3, SIDE)) for low in range(0, SIDE + 1, 4)]


def _equal_windows(contexts: np.ndarray, least: np.ndarray, low: int, high: int) -> None:
    """Lower ``least[context, o]`` to the smallest id of any context with an equal window, by suffix arrays, for ``o`` from ``low`` to ``high``."""
    lefts, rights = np.minimum(contexts["lefts"], high).astype(np.int64), np.minimum(contexts["rights"], SIDE - low).astype(np.int64)
    pick = np.flatnonzero((lefts >= low) & (rights >= SIDE - high) & (lefts + rights >= SIDE))
    if len(pick) < 2:
        return
    some, lefts, rights = contexts[pick], lefts[pick], rights[pick]
    reached = _weighed(some["left"][:, SIDE - high :], _WL[:high]) + _weighed(some["right"][:, : SIDE - low], _WR[: SIDE - low])
    reached = mix(some["anchor"] + reached + lefts.astype(_U) * _U(0x9E3779B97F4A7C15) + rights.astype(_U) * _U(0xC2B2AE3D27D4EB4F))
    by = np.argsort(reached, kind="stable")
    begins, ends = _groups(reached[by])
    which = np.empty(len(pick), np.int64)
    which[by] = np.repeat(np.arange(len(begins)), ends - begins)
    ids = np.minimum.reduceat(some["id"][by], begins)
    some, lefts, rights = some[by[begins]], lefts[by[begins]], rights[by[begins]]
    offsets = np.arange(low, high + 1)
    found = np.where((lefts[:, None] >= offsets) & (rights[:, None] >= SIDE - offsets), ids[:, None], _NEVER)
    near = mix(_weighed(some["right"][:, : SIDE - high], _WR[: SIDE - high])) + _weighed(some["left"][:, SIDE - low :], _WL[:low])
    _, group, size = np.unique(mix(some["anchor"] + near), return_inverse=True, return_counts=True)
    several = np.flatnonzero(size[group] > 1)
    several = several[np.argsort(group[several], kind="stable")]
    group = group[several]
    # Whole groups up to a number of symbols make one text.
    stops = np.cumsum(lefts[several] + rights[several] + 2)
    texts, start = [], 0
    for b, e in zip(*_groups(group), strict=True):
        if b > start and stops[e - 1] - (stops[start - 1] if start else 0) > SYMBOLS:
            texts.append((start, b))
            start = b
    if len(several):
        texts.append((start, len(several)))
    for a, b in texts:
        chosen = several[a:b]
        letters, left, right = some[chosen], lefts[chosen], rights[chosen]
        stop = np.cumsum(left + right + 2)
        begin = stop - (left + right + 2)
        text = np.zeros(stop[-1], np.int64)  # 0 parts the contexts
        for j in range(high):
            on = np.flatnonzero(left > j)
            text[begin[on] + left[on] - 1 - j] = letters["left"][on, SIDE - 1 - j].astype(np.int64) + 1
        for j in range(SIDE - low):
            on = np.flatnonzero(right > j)
            text[begin[on] + left[on] + 1 + j] = letters["right"][on, j].astype(np.int64) + 1
        text[begin + left] = 257 + group[a:b]
        # Where windows begin, and whose they are.
        owner, offset = np.full(len(text), -1), np.zeros(len(text), np.int64)
        for o in offsets:
            on = np.flatnonzero((left >= o) & (right >= SIDE - o))
            owner[begin[on] + left[on] - o], offset[begin[on] + left[on] - o] = on, o - low
        order = np.array(suffix_array(text.tolist()), np.int64)
        order = order[owner[order] >= 0]
        if len(order) < 2:
            continue
        same = np.ones(len(order) - 1, bool)
        for j in range(SIDE + 1):
            same &= text[order[1:] + j] == text[order[:-1] + j]
        runs = np.flatnonzero(np.concatenate([[True], ~same]))
        smallest = np.minimum.reduceat(ids[chosen[owner[order]]], runs)
        smallest = np.repeat(smallest, np.diff(np.append(runs, len(order))))
        found[chosen[owner[order]], offset[order]] = smallest
    least[pick[:, None], offsets] = np.minimum(least[pick[:, None], offsets], found[which])


def _compare(group: pa.Table) -> pa.Table:
    """Per block, the runs of windows of its contexts with the smallest id they occur in; other rows go through."""
    if group.column("bucket")[0].as_py() < 0:
        return group.select(["block", "part", "data"])
    parts = [_unpress(d, _CONTEXT) for d in group.column("data").to_pylist()]
    block = np.repeat(group.column("block").to_numpy(), [len(p) for p in parts])
    entries = np.concatenate(parts)
    digest = _digest(entries)
    by = np.argsort(digest, kind="stable")
    entries, block, digest = entries[by], block[by], digest[by]
    begins, ends = _groups(digest)
    distinct = entries[begins]
    distinct["id"] = np.minimum.reduceat(entries["id"], begins)
    which = np.repeat(np.arange(len(begins)), ends - begins)
    least = np.repeat(distinct["id"][:, None], SIDE + 1, axis=1)
    for low, high in _STEPS:
        _equal_windows(distinct, least, low, high)
    # What some document of the block can learn from: an id below the block's own, or several ids in the block.
    told = np.flatnonzero((least.min(1)[which] < entries["id"]) | (entries["several"] > 0))
    entries, block, which = entries[told], block[told], which[told]
    found, homes = [], []
    for i in range(0, len(told), UNFOLDED):
        some = entries[i : i + UNFOLDED]
        valid = (some["lefts"][:, None] >= _OFFSETS) & (some["rights"][:, None] >= SIDE - _OFFSETS)
        values = np.where(valid, least[which[i : i + UNFOLDED]], _NEVER)
        row, first = np.nonzero(np.concatenate([np.ones((len(values), 1), bool), values[:, 1:] != values[:, :-1]], 1))
        last = np.append(first[1:], 0) - 1
        last[np.append(row[1:] != row[:-1], True)] = SIDE
        runs = np.zeros(len(row), _RUN)
        runs["at"], runs["first"], runs["last"], runs["id"] = some["at"][row], first, last, values[row, first]
        useful = runs["id"] != _NEVER
        found.append(runs[useful])
        homes.append(block[i : i + UNFOLDED][row[useful]])
    runs, home = np.concatenate([*found, np.zeros(0, _RUN)]), np.concatenate([*homes, np.zeros(0, np.int64)])
    by = np.argsort(home, kind="stable")
    runs, home = runs[by], home[by]
    begins, ends = _groups(home)
    told = pa.table({
        "block": pa.array(home[begins], pa.int64()), "part": pa.array([0] * len(begins), pa.int32()),
        "data": pa.array([_press(runs[a:b]) for a, b in zip(begins, ends, strict=True)], pa.binary()),
    })
    del parts, entries, distinct, least, runs
    release()
    return told


_RANGES = "key bigint, starts array<bigint>, ends array<bigint>"


def _resolve(group: pa.Table) -> pa.Table:
    """The byte ranges that go, for each document of a block."""
    kinds = (_RUN, _PLACE, _ROW)
    data = [[np.zeros(0, kind)] for kind in kinds]
    for part, value in zip(group.column("part").to_pylist(), group.column("data").to_pylist(), strict=True):
        data[part].append(_unpress(value, kinds[part]))
    runs, places, rows = (np.concatenate(d) for d in data)
    runs = runs[np.argsort(runs["at"], kind="stable")]
    begin, end = (np.searchsorted(runs["at"], places["context"], side) for side in ("left", "right"))
    count = end - begin
    place = np.repeat(np.arange(len(places)), count)
    run = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
    row = places["row"][place].astype(np.int64)
    gone = runs["id"][run] < rows["id"][row]
    place, run, row = place[gone], run[gone], row[gone]
    start = places["at"][place].astype(np.int64) - runs["last"][run]
    stop = places["at"][place].astype(np.int64) - runs["first"][run] + LENGTH
    # All documents on one line, far apart; a range begins where none before it reaches.
    far = row << 34
    by = np.argsort(start + far, kind="stable")
    start, stop, row, far = start[by], stop[by], row[by], far[by]
    reach = np.maximum.accumulate(stop + far) if len(stop) else stop
    first = np.flatnonzero(np.concatenate([[True], (start + far)[1:] > reach[:-1]])) if len(stop) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(stop)) - 1
    starts, ends, row = start[first], reach[last] - far[last], row[first]
    cuts, ends_of = _groups(row)
    bounds = list(zip(cuts, ends_of, strict=True))
    return pa.table({
        "key": pa.array(rows["key"][row[cuts]], pa.int64()), "starts": pa.array([starts[a:b] for a, b in bounds], pa.list_(pa.int64())),
        "ends": pa.array([ends[a:b] for a, b in bounds], pa.list_(pa.int64())),
    })


# ------------------------------------------------------------------ Spark jobs


def repeated_ranges(keyed: DataFrame, own: str, key: str, text: str) -> DataFrame:
    """(key, starts, ends): the maximal byte ranges that go, for every row that loses any.

    ``own`` holds the :func:`row_key` of each row of ``keyed``.
    """
    small_batches(keyed.sparkSession)
    data = F.col(f"`{text}`").cast("binary")
    rows = keyed.where(F.col(f"`{key}`").isNotNull() & (F.length(data) >= LENGTH)).select(F.col(own).alias("key"), data.alias("data"))
    total = rows.agg(F.sum(F.length("data"))).first()[0] or 0
    n_buckets = max(8, -(-total // (PER_ANCHOR * BUCKET)))
    announced = rows.mapInArrow(_announce(n_buckets), _ANNOUNCED)
    replies = announced.groupBy("bucket").applyInArrow(_meet, _REPLY).groupBy("block").applyInArrow(_hand_out, _ASKED)
    # Copies of a row lie in several blocks.
    replies = replies.groupBy("key").agg(F.collect_list("hashes").alias("hashes"))
    # All columns come along: so this and the caller's join deal the texts out in one and the same shuffle.
    numbered = [F.col(f"`{c}`").alias(f"column{i}") for i, c in enumerate(keyed.columns) if c not in (own, key, text)]
    answered, wanted = fresh(keyed, "__answered", "__wanted")
    asked = keyed.join(replies.toDF(answered, wanted), F.col(own) == F.col(answered)).select(
        F.col(own).alias("key"), F.col(f"`{key}`").cast("long").alias("id"), data.alias("data"), F.col(wanted).alias("hashes"), *numbered
    )
    contexts = asked.mapInArrow(_cut_contexts(FINER * n_buckets), _CONTEXTS)
    compared = contexts.groupBy("bucket").applyInArrow(_compare, "block bigint, part int, data binary")
    ranges = compared.groupBy("block").applyInArrow(_resolve, _RANGES)
    # Rows that agree in id and text have one answer.
    return ranges.groupBy("key").agg(F.first(F.struct("starts", "ends")).alias("r")).select("key", "r.starts", "r.ends")


def row_key(key: str, text: str) -> Column:
    """What names a row: ids may repeat, with other texts."""
    return F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))


def whole_characters(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The part of a byte range that cuts no UTF-8 character."""
    while start < end and data[start] & 0xC0 == 0x80:
        start += 1
    while start < end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def remove_repeats(df: DataFrame, key: str, text: str, names: tuple[str, str] = ("removed", "kept"), characters: bool = False) -> DataFrame:
    """All columns of ``df`` with the removed byte ranges and the bytes that stay.

    Strings are judged on the input, matches never cross documents, overlaps
    count.  Rows with one id never remove from each other; rows without an id
    neither remove nor lose anything.  Null and empty texts have no bytes.  With
    ``characters`` a character of which only a part would go stays whole.
    Columns of the two names are replaced.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in names]

    @F.arrow_udf("binary")
    def cut(batch: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for data, first, last in zip(batch.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
            data = data or b""
            gone = list(zip(first or (), last or (), strict=True))
            if characters:
                gone = [whole_characters(data, a, b) for a, b in gone]
            edges = [0, *(x for pair in gone for x in pair), len(data)]
            out.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if first else data)
        return pa.array(out, pa.binary())

    own, other, first, last = fresh(df, "__row", "__other", "__starts", "__ends")
    keyed = df.withColumn(own, row_key(key, text))
    found = repeated_ranges(keyed, own, key, text).toDF(other, first, last)
    joined = keyed.join(found, F.col(own) == F.col(other), "left")
    ranges = F.coalesce(F.transform(F.arrays_zip(first, last), lambda x: F.struct(x[first].alias("start"), x[last].alias("end"))), F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return joined.select(
        *kept, ranges.alias(names[0]), cut(F.col(f"`{text}`").cast("binary"), F.col(first), F.col(last)).alias(names[1]),
    )
