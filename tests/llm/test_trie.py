import hashlib
import random
import zlib

import numpy as np
import pytest

import compare
from cases import SF, needs_tables
from laneflow.llm import queries, trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, hash string, ends string, key string, part string"


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, "?", "?", "?", "?") for r in rows], SCHEMA)


def sequences(rows):
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}:{text}".encode()).digest()
            found.setdefault(conv, []).append(((turn is not None, turn or 0), digest, role, text))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in found.items()}


def brute(seqs):
    """(conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends) of every node, from a dictionary of prefixes."""
    members = {}
    for conv, seq in seqs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(conv)
    children, out = {}, []
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[c] for c in below) if below else 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[c] for c in below)
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(seqs[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, [])), leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def answer(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def random_rows(seed, convs=60, longest=40):
    draw = random.Random(seed)
    rows = []
    for c in range(convs):
        n = draw.choice([1, 2, 3, 5, 17, longest])
        same = draw.random() < 0.7
        rows += [(c, t, draw.choice(["user", None]), f"turn {0 if same and t < n - 1 else draw.randint(0, 2)}") for t in range(n)]
    return rows


AWKWARD = [
    (None, 1, "user", "of no conversation"), (1, None, "user", "first"), (1, 0, "user", "second"), (2, 5, None, None), (2, 5, None, None), (3, 1, "", ""), (3, 1, None, ""),
    (-7, 1, "user", "é😀"), (-7, 2, "a", ":b"), (-8, 1, "user", "é😀"), (-8, 2, "a:", "b"), (9, 1, "user", "x" * 100_000), (10, 1, "user", "x" * 100_000),
]


@pytest.mark.parametrize("cells", [10**6, 7])
@pytest.mark.parametrize("fan", [128, 2])
def test_against_brute_force(spark, monkeypatch, cells, fan):
    monkeypatch.setattr(trie, "FAN_IN", fan)
    rows = random_rows(cells) + [(c, t, "user", "hot") for c in range(100, 160) for t in range(3)] + [(1000 + c, t, r, x) for c, t, r, x in AWKWARD if c is not None]
    got = trie.prefix_trie(trie.conversation_turns(turns_frame(spark, rows), "conv_id", "turn", "role", "text"), shard_cells=cells)
    assert answer(got) == brute(sequences(rows))


def test_awkward_rows(spark):
    turns = trie.conversation_turns(turns_frame(spark, AWKWARD), "conv_id", "turn", "role", "text")
    assert answer(trie.prefix_trie(turns)) == brute(sequences(AWKWARD))


def test_members_without_turns_and_empty_tables(spark):
    empty = spark.createDataFrame([], f"conv_id bigint, turns {trie.TURNS}")
    assert trie.prefix_trie(empty).count() == 0
    assert trie.conversation_turns(turns_frame(spark, []), "conv_id", "turn", "role", "text").count() == 0
    bare = spark.createDataFrame([(3, []), (1, [])], f"conv_id bigint, turns {trie.TURNS}")
    assert answer(trie.prefix_trie(bare)) == brute({3: [], 1: []})


def test_shard_of_long_conversations_without_spark():
    draw = random.Random(5)
    turn = [hashlib.md5(bytes([i])).digest() for i in range(3)]
    common = [draw.choice(turn) for _ in range(300)]
    seqs = [common[: draw.choice([0, 16, 17, 100, 299])] + [draw.choice(turn)] * draw.choice([0, 1, 40]) for _ in range(80)]
    nodes = trie.shard_nodes(0, np.arange(80), b"".join(h for s in seqs for h in s), np.array([len(s) for s in seqs]), np.ones(sum(map(len, seqs)), np.int64))
    rows = nodes.to_pylist()
    closed, rest = trie.merge_boundaries(sorted((r for r in rows if r["kind"] == 1), key=lambda r: r["seq"]), True)
    want = {tuple(s[:d]) for s in seqs for d in range(len(s) + 1)}
    assert not rest and len(closed) + sum(r["kind"] == 0 for r in rows) == len(want)
    root = next(n for n in closed if n["depth"] == 0)
    assert root["n_convs"] == 80 and root["n_leaves"] == len(want - {p[:-1] for p in want if p})


@needs_tables
def test_query(spark):
    con = compare.connect("sf0.001")
    frame = queries.QUERIES["op12_conversation_prefix_trie"](spark, SF)
    result = con.execute(queries.ORACLES["op12_conversation_prefix_trie"])
    names = [d[0] for d in result.description]
    got = frame.collect()
    assert compare.rows_of(frame.columns, got) == compare.rows_of(names, result.fetchall())
    own = sequences([tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()])
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    rebuilt = {c: own.get(c - c % 5, [])[: heads[c]] + own[c][heads[c] :] for c in own}
    assert sorted((tuple(r) for r in got), key=repr) == brute(rebuilt)
