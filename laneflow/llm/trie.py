"""Prefix trie of conversations, from padded matrices of turn ids.

A conversation is a row of turn ids.  Rows are dealt by range of their whole
sequence (then of their id), so every node of the trie, a distinct beginning, is
a run of neighbouring rows.  Within a shard the padded matrices are sorted by
``numpy.lexsort``; the masks of changed columns, accumulated by OR from left to
right, mark where nodes start, and ``reduceat`` sums every depth.  Only nodes on
the path of a shard's first or last row can go on next door.  These boundary
nodes, a few per shard, are merged in order by groups of neighbouring shards,
what the group closes leaves, the rest goes to the next round, until one group
is left.

Turn ids are 128-bit hashes of role and text; texts never travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from laneflow.llm.common import materialise

# Turns (and conversations) per shard, on average, and columns of one padded matrix.
SHARD_CELLS, WIDTH = 500_000, 16
# Neighbouring shards whose boundary nodes meet in one task.
FAN_IN = 128
TURNS = "array<struct<hash:binary,size:bigint>>"

_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, parent_key binary, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
# Beyond nodes: ``kind`` tells closed nodes (0), boundary nodes (1) and lists of ids that end at a boundary node (2).
_SHARD = f"{_NODE}, ends_sha256 string, kind int, part bigint, seq bigint, key binary, turn binary, size bigint, is_left boolean, ends string"
_FIELDS = [f.strip().split() for f in _SHARD.split(",")]
_ARROW = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.large_string(), "binary": pa.large_binary(), "boolean": pa.bool_()}[t]) for n, t in _FIELDS])
_SPARK_ARROW = pa.schema([(f.name, {pa.large_string(): pa.string(), pa.large_binary(): pa.binary()}.get(f.type, f.type)) for f in _ARROW])
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# -------------------------------------------------------------------- sequences


def turn_hash(role: Column, text: Column) -> Column:
    """128 bits of a turn; null role or text counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat_ws(":", F.octet_length(role), role, text).cast("binary")))


def conversation_turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turns): one row per conversation with its turns' hash and bytes of text, in order.

    Null turn numbers come first; equal ones are ordered by hash and stay
    separate turns, repeated rows too.  Rows without a conversation id belong to
    none and are left out.  A conversation is one row of 24 bytes a turn.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"),
        F.struct(F.col(f"`{turn}`").alias("turn"), turn_hash(F.col(f"`{role}`"), body).alias("hash"), F.octet_length(body).cast("long").alias("size")).alias("t"),
    )
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["hash"].alias("hash"), t["size"].alias("size"))).alias("turns"))


# ------------------------------------------------------------------------ shard


@dataclass
class _Rows:
    """Conversations of a shard; turn ids and sizes lie end to end."""

    conv: np.ndarray
    length: np.ndarray
    first: np.ndarray  # of each row in ``ids`` and ``size``
    ids: np.ndarray
    size: np.ndarray

    def padded(self, rows: np.ndarray, column: int) -> np.ndarray:
        """Turn ids of ``rows`` in ``WIDTH`` columns from ``column`` on, -1 behind the end."""
        at = column + np.arange(WIDTH)
        inside = at < self.length[rows][:, None]
        places = np.where(inside, self.first[rows][:, None] + at, 0)
        return np.where(inside, self.ids[places], -1) if len(self.ids) else np.full(places.shape, -1)


def _ranked(hashes: bytes) -> np.ndarray:
    """Dense numbers of 16-byte hashes, in the order of their bytes."""
    halves = np.frombuffer(hashes, ">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (halves[order[1:]] != halves[order[:-1]]).any(axis=1)
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new) - 1
    return ids


def _order(rows: _Rows) -> np.ndarray:
    """Rows by sequence, then id.  Columns are sorted ``WIDTH`` at a time, among rows that are equal so far."""
    n = len(rows.conv)
    place, group, live, column = np.empty(n, np.int64), np.zeros(n, np.int64), np.arange(n), 0
    while len(live):
        ids = rows.padded(live, column)
        order = np.lexsort((rows.conv[live], *ids.T[::-1], group[live]))
        live, ids = live[order], ids[order]
        base = group[live]
        apart = np.ones(len(live), bool)
        apart[1:] = base[1:] != base[:-1]
        starts = np.flatnonzero(apart)
        here = base + np.arange(len(live)) - np.repeat(starts, np.diff(np.append(starts, len(live))))
        place[live] = here
        apart[1:] |= (ids[1:] != ids[:-1]).any(axis=1)
        heads = np.flatnonzero(apart)
        sizes = np.diff(np.append(heads, len(live)))
        group[live] = np.repeat(here[heads], sizes)
        column += WIDTH
        more = (sizes > 1) & np.logical_or.reduceat(rows.length[live] > column, heads)
        live = live[np.repeat(more, sizes)]
    order = np.empty(n, np.int64)
    order[place] = np.arange(n)
    return order


def _levels(rows: _Rows, order: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """The nodes of every depth, from the root on; ``start`` and ``last`` are places in the order."""
    conv, length = rows.conv[order], rows.length[order]
    n = len(order)

    def level(alive: np.ndarray, starts: np.ndarray, depth: int) -> dict[str, np.ndarray]:
        counts = np.diff(np.append(starts, len(alive)))
        ended = length[alive] == depth
        row = alive[starts]
        turn = rows.first[order[row]] + depth - 1
        return {
            "start": row, "last": alive[starts + counts - 1], "n": counts, "conv": np.minimum.reduceat(conv[alive], starts),
            "size": rows.size[turn] if depth else np.zeros(1, np.int64), "turn": turn,
            "ended": np.add.reduceat(ended.astype(np.int64), starts), "ends": conv[alive[ended]],
        }

    yield level(np.arange(n), np.zeros(1, np.int64), 0)
    changed_before, column = np.zeros(n, bool), 0
    while len(live := np.flatnonzero(length > column)):
        ids = rows.padded(order[live], column)
        changed = np.ones(ids.shape, bool)
        changed[1:] = ids[1:] != ids[:-1]
        # A row that ended between two others parts them at its end, left of these columns.
        changed[1:, 0] |= (live[1:] != live[:-1] + 1) | changed_before[live[1:]]
        started = np.logical_or.accumulate(changed, axis=1)
        changed_before[live] = started[:, -1]
        for j in range(WIDTH):
            here = length[live] > column + j
            if not here.any():
                break
            yield level(live[here], np.flatnonzero(started[here, j]), column + j + 1)
        column += WIDTH


def shard_nodes(shard: int, conv: np.ndarray, hashes: bytes, length: np.ndarray, size: np.ndarray) -> pa.Table:
    """Closed nodes, boundary nodes and their ends of one shard, as rows of the shard schema."""
    rows = _Rows(conv, length, np.cumsum(length) - length, _ranked(hashes), size)
    order = _order(rows)
    n, levels = len(order), list(_levels(rows, order))
    for depth, level in enumerate(levels):
        level["open"] = (level["start"] == 0) | (level["last"] == n - 1)
        level["children"] = np.zeros(len(level["n"]), np.int64)
        level["leaves"], level["saved"] = level["children"].copy(), level["children"].copy()
        level["parent"] = np.searchsorted(levels[depth - 1]["start"], level["start"], "right") - 1 if depth else np.zeros(1, np.int64)
    # From the leaves up.  A boundary node counts at its parent only once it is whole.
    for depth in range(len(levels) - 1, 0, -1):
        level, above = levels[depth], levels[depth - 1]
        closed = ~level["open"]
        level["leaves"] += closed & (level["children"] == 0)
        level["saved"] += np.where(closed, (level["n"] - 1) * level["size"], 0)
        at = level["parent"][closed]
        np.add.at(above["children"], at, 1)
        np.add.at(above["leaves"], at, level["leaves"][closed])
        np.add.at(above["saved"], at, level["saved"][closed])

    out: dict[str, list] = {f.name: [] for f in _ARROW}

    def put(**values):
        for name, column in out.items():
            column.append(values.get(name))

    keys: dict[tuple[int, int], bytes] = {}
    for depth, level in enumerate(levels):
        texts = np.cumsum(level["ended"])
        names = np.flatnonzero(level["open"])
        for i in names.tolist():
            at = 16 * int(rows.first[order[level["start"][i]]])
            keys[depth, i] = hashlib.md5(hashes[at : at + 16 * depth]).digest()
        values = {k: level[k].tolist() for k in ("conv", "n", "children", "leaves", "saved", "size", "ended", "open", "parent", "start", "last", "turn")}
        above = levels[depth - 1]["conv"].tolist() if depth else [None]
        for i, is_open in enumerate(values["open"]):
            ended = values["ended"][i]
            ids = ",".join(map(str, level["ends"][texts[i] - ended : texts[i]].tolist())) if ended else ""
            same = {"conv_id": values["conv"][i], "depth": depth, "n_convs": values["n"][i], "n_children": values["children"][i],
                    "n_leaves": values["leaves"][i], "saved_tokens": values["saved"][i], "part": shard}
            if is_open:
                left, right = values["start"][i] == 0, values["last"][i] == n - 1
                at = 16 * values["turn"][i]
                # Before all others stands what both ends share, then the first row's path, then the last one's.
                seq = (0 if left and right else 1 if left else 2) * len(levels) + depth
                put(**same, kind=1, seq=seq, key=keys[depth, i], turn=hashes[at : at + 16] if depth else b"", size=values["size"][i], is_left=left)
                if ended:
                    put(kind=2, part=shard, key=keys[depth, i], ends=ids)
            else:
                parent = values["parent"][i]
                key = keys.get((depth - 1, parent))
                put(**same, kind=0, parent_conv_id=above[parent] if key is None else None, parent_key=key,
                    ends_sha256=hashlib.sha256(ids.encode()).hexdigest() if ended else _EMPTY_SHA)
    return pa.table([pa.array(out[f.name], f.type) for f in _ARROW], schema=_ARROW)


def _run_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held)
    hashes = b"".join(whole.column("sequence").to_pylist())
    length = np.array([len(k) // 16 for k in whole.column("sequence").to_pylist()], np.int64)
    sizes = [np.asarray(chunk.flatten().to_numpy(zero_copy_only=False), np.int64) for chunk in whole.column("sizes").chunks]
    conv = whole.column("conv_id").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    nodes = shard_nodes(TaskContext.get().partitionId(), conv, hashes, length, np.concatenate(sizes))
    yield from nodes.cast(_SPARK_ARROW).to_batches(max_chunksize=10_000)


# --------------------------------------------------------------- boundary nodes


def merge_boundaries(rows: list[dict], final: bool) -> tuple[list[dict], list[dict]]:
    """Closed and boundary nodes of neighbouring shards, from their boundary nodes in order.

    The stack holds the path to the newest node.  A node that comes again is
    added up; one that is left behind is closed and counts at its parent, unless
    it also holds the first row of all and may go on before it.
    """
    stack: list[dict] = []
    closed: list[dict] = []
    left: list[dict] = []
    first = rows[0]["part"] if rows else None

    def leave() -> None:
        node = stack.pop()
        if node["is_left"] and not final:
            left.append(node)
            return
        if not node["n_children"]:
            node["n_leaves"] += 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["size"]
        if stack:
            above = stack[-1]
            above["n_children"] += 1
            above["n_leaves"] += node["n_leaves"]
            above["saved_tokens"] += node["saved_tokens"]
            node["parent_key"] = above["key"]
        closed.append(node)

    for row in rows:
        depth = row["depth"]
        if len(stack) > depth and stack[depth]["turn"] == row["turn"]:
            node = stack[depth]
            node["conv_id"] = min(node["conv_id"], row["conv_id"])
            for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                node[name] += row[name]
            continue
        while len(stack) > depth:
            leave()
        stack.append(row | {"is_left": row["is_left"] and row["part"] == first})
    if final:
        while stack:
            leave()
    both = [n for n in stack if n["is_left"]]
    right = [n for n in stack if not n["is_left"]]
    ordered = [*both, *sorted(left, key=lambda n: n["depth"]), *right]
    return closed, [node | {"seq": seq} for seq, node in enumerate(ordered)]


def _merge_round(boundary: DataFrame, parts: int) -> DataFrame:
    final = parts <= FAN_IN

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by([("part", "ascending"), ("seq", "ascending")]).to_pylist()
        number = rows[0]["part"] // FAN_IN
        closed, still = merge_boundaries(rows, final)
        made = [n | {"kind": 0} for n in closed] + [n | {"kind": 1, "part": number} for n in still]
        return pa.Table.from_pylist(made, schema=_SPARK_ARROW)

    return boundary.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(run, _SHARD)


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per key over its lists of ids, which arrive in order."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k == key:
                state.update(b"," + ids.encode())
                continue
            if state:
                done.append({"key": key, "ends_sha256": state.hexdigest()})
            key, state = k, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_pylist(done)
    if state:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": state.hexdigest()}])


def prefix_trie(df: DataFrame, conv: str = "conv_id", turns: str = "turns", shard_cells: int = SHARD_CELLS) -> DataFrame:
    """All nodes of the trie of the conversations in ``df``, one row per distinct id and sequence of :func:`conversation_turns`.

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null
    for the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    (over the subtree: members but one, times the bytes of the last turn's text)
    and ``ends_sha256`` of the ids, in order, of the members that end here.
    (conv_id, depth) names a node.  Members without turns end at the root.  An
    empty table has no nodes, not even a root.  Null ids must not occur; an id
    that stands in several rows is a member as often.  Other columns are not read.
    """
    sequence = F.unhex(F.array_join(F.transform(F.col(f"`{turns}`"), lambda t: F.hex(t["hash"])), ""))
    rows = materialise(
        df.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), sequence.alias("sequence"), F.transform(F.col(f"`{turns}`"), lambda t: t["size"]).alias("sizes")),
        "sequences",
    )
    cells = rows.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cells // shard_cells))
    dealt = rows.repartitionByRange(parts, "sequence", "conv_id")
    shards = materialise(dealt.mapInArrow(_run_shard, _SHARD), "trie-shards")
    # Spark may have dealt to more parts than asked for; numbers of parts are what counts.
    parts = 1 + (shards.agg(F.max("part")).first()[0] or 0)

    boundary, merged = shards.where("kind = 1"), []
    while True:
        made = materialise(_merge_round(boundary, parts), "trie-boundaries")
        merged.append(made.where("kind = 0"))
        if parts <= FAN_IN:
            break
        boundary, parts = made.where("kind = 1"), -(-parts // FAN_IN)
    whole = merged[0]
    for more in merged[1:]:
        whole = whole.unionByName(more)

    chunks = shards.where("kind = 2").select("key", "part", "ends").repartition("key").sortWithinPartitions("key", "part")
    ends = chunks.select("key", "ends").mapInArrow(_digest_ends, "key binary, ends_sha256 string")
    whole = materialise(whole.drop("ends_sha256").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY_SHA))), "trie-merged")

    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = shards.where("kind = 0")
    nodes = inner.select(*out, "parent_key").unionByName(whole.select(*out, "parent_key"))
    above = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("__above"))
    return nodes.join(above, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "__above")).select(*out)
