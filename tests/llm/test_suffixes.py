import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from cases import PROSE, SF, documents, needs_tables
from laneflow.llm import queries, suffixes


def brute(rows):
    """The bytes that go, by comparing every string of 50 bytes."""
    first = {}
    for number, data in rows:
        if number is not None:
            for s in range(len(data) - 49):
                w = data[s : s + 50]
                first[w] = min(number, first.get(w, number))
    out = []
    for number, data in rows:
        gone = bytearray(len(data))
        if number is not None:
            for s in range(len(data) - 49):
                if first[data[s : s + 50]] < number:
                    gone[s : s + 50] = b"\1" * 50
        out.append(bytes(gone))
    return out


def spans(gone):
    edges = np.flatnonzero(np.diff(np.frombuffer(b"\0" + gone + b"\0", np.uint8).astype(int)))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


def test_order_of_suffixes():
    draw = random.Random(2)
    for _ in range(3000):
        size = draw.choice([1, 2, 3, 20])
        text = [draw.randrange(size) for _ in range(draw.randint(0, 40))]
        assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffixes.suffix_array([0] * 500) == list(range(499, -1, -1))


def test_equal_strings_have_equal_anchors():
    draw = random.Random(5)
    for alphabet in (b"ab", bytes(range(97, 123))):
        shared = bytes(draw.choice(alphabet) for _ in range(50))
        for _ in range(40):
            left, right = (bytes(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(2))
            at, hashes, _ = suffixes.anchors(left + shared + right)
            inside = {(a - len(left), h) for a, h in zip(at.tolist(), hashes.tolist()) if len(left) <= a <= len(left) + 30}
            alone = {(a, h) for a, h in zip(*(x.tolist() for x in suffixes.anchors(shared)[:2]))}
            assert alone & inside == alone


def test_windows_across_characters():
    data = "aé日b".encode()
    assert suffixes.whole_characters(data, 2, 5) == (3, 3) and suffixes.whole_characters(data, 1, 6) == (1, 6)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_comparing_everything(spark, seed, monkeypatch):
    draw = random.Random(seed)
    words = ["ab", "ba", "é", "日本", " ", "abc", "zz"][: 3 + 2 * seed]
    make = lambda n: "".join(draw.choice(words) for _ in range(n))
    pool = [make(draw.randint(15, 80)) for _ in range(8)]
    rows = [(draw.choice([*range(40), None]), "".join(draw.choice([*pool, make(6)]) for _ in range(draw.randint(0, 5)))) for _ in range(60)]
    check(spark, rows)


def check(spark, rows, clashes=False):
    out = suffixes.remove_repeats(documents(spark, rows, clashes), "doc_id", "text").collect()
    expected = sorted(
        (-1 if n is None else n, t or "", spans(g)) for (n, t), g in zip(rows, brute([(n, (t or "").encode()) for n, t in rows]), strict=True)
    )
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "", [(x["start"], x["end"]) for x in r["removed"]]) for r in out)
    assert found == expected
    for r in out:
        data, at, kept = (r["text"] or "").encode(), 0, b""
        for x in r["removed"]:
            kept, at = kept + data[at : x["start"]], x["end"]
        assert bytes(r["kept"]) == kept + data[at:]


def test_awkward_documents(spark):
    rows = [(1, None), (2, ""), (3, PROSE), (4, PROSE), (4, PROSE), (4, "Other " + PROSE), (5, PROSE[:49]), (6, PROSE[:50]), (7, PROSE[3:60]), (None, PROSE),
            (8, "é" * 30), (9, "x" + "é" * 30), (10, PROSE * 2), (11, "z" * 3000), (12, "z" * 120)]
    check(spark, rows, clashes=True)
    assert suffixes.remove_repeats(documents(spark, []), "doc_id", "text").count() == 0


def test_small_blocks(spark, monkeypatch):
    """Shared strings meet whichever block, bucket or text they are in."""
    for name, value in (("HELD", 50), ("HELD_CONTEXTS", 40), ("SYMBOLS", 200)):
        monkeypatch.setattr(suffixes, name, value)
    check(spark, [(i, f"{i * 7919} " + PROSE[i % 11 : 40 + i % 60] + f" {i * 31}") for i in range(50)])


def test_one_row_repeated_in_many_blocks(spark, monkeypatch):
    """Blocks that begin with copies of one row stay apart."""
    monkeypatch.setattr(suffixes, "HELD_CONTEXTS", 40)
    others = [(1000 + i, f"{i * 7919} " + PROSE[i % 11 : 60 + i % 60] + f" {i * 31}") for i in range(40)]
    check(spark, [*[(7, PROSE)] * 300, (3, PROSE[10:90]), *others])


@needs_tables
def test_query(spark):
    docs = sorted((r["doc_id"], r["text"].encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = {r["doc_id"]: r for r in queries.QUERIES["op6_suffix_array_dedup"](spark, SF).collect()}
    assert len(rows) == len(docs)
    for (number, data), gone in zip(docs, brute(docs), strict=True):
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        r = rows[number]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(data), sum(gone), len(spans(gone)))
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("kind", [suffixes._CONTEXT, suffixes._PLACE, suffixes._ROW, suffixes._RUN])
def test_records_come_back_from_compression(kind):
    draw = np.random.default_rng(3)
    for n in (1, 2, 500):
        records = np.frombuffer(draw.bytes(n * kind.itemsize), kind)
        assert (suffixes._unpress(suffixes._press(records), kind) == records).all()
    numbers = draw.integers(0, 1 << 48, 300).astype(np.uint64)
    assert (suffixes._join48(suffixes._split48(numbers)) == numbers).all()


def test_answers_do_not_grow_with_buckets():
    """A bucket answers once per block that asked, not once per row of it; every row learns its own anchors."""
    rows, keys = 200, np.arange(200, dtype=np.int64)
    anchor = np.arange(rows, dtype=np.uint64) << np.uint64(20)

    def asked(block, first):
        return {"bucket": 0, "block": block, "hashes": suffixes._split48(anchor), "owners": suffixes._planes(np.arange(rows).astype("<u2")),
                "keys": suffixes._planes(keys + first)}

    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("owners", pa.binary()), ("keys", pa.binary())])
    met = suffixes._meet(pa.Table.from_pylist([asked(5, 0), asked(9, 1000)], schema))
    assert met.num_rows == 2
    for block, first in ((5, 0), (9, 1000)):
        own = met.filter(pa.compute.equal(met.column("block"), block))
        out = suffixes._hand_out(own).to_pylist()
        assert [(r["key"], suffixes._join48(r["hashes"]).tolist()) for r in out] == [(int(k) + first, [int(a)]) for k, a in zip(keys, anchor)]


def test_suffix_arrays_hold_only_contexts_that_may_share_windows(monkeypatch):
    """Contexts that differ only beyond a window's reach are one; the smallest ids are those of comparing everything."""
    draw, side = random.Random(4), suffixes.SIDE
    made = np.zeros(400, suffixes._CONTEXT)
    base = bytes(draw.randrange(97, 123) for _ in range(2 * side))
    for i in range(len(made)):
        text = bytearray(base)
        for _ in range(draw.randint(0, 2)):
            text[draw.randrange(2 * side)] = draw.randrange(97, 100)
        lefts, rights = draw.choice([side, side, 12]), draw.choice([side, side, 20])
        made["left"][i], made["right"][i] = np.frombuffer(text[:side], "u1"), np.frombuffer(text[side:], "u1")
        made["left"][i][: side - lefts], made["right"][i][rights:] = 0, 0
        made["anchor"][i], made["id"][i], made["lefts"][i], made["rights"][i] = draw.randint(1, 2), draw.randrange(10**6), lefts, rights
    seen, build = [], suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda text: seen.append(len(text)) or build(text))
    least = np.repeat(made["id"][:, None], side + 1, axis=1)
    for low, high in suffixes._STEPS:
        suffixes._equal_windows(made, least, low, high)
    first = {}
    windows = [
        [(c["anchor"], o, c["left"][side - o :].tobytes(), c["right"][: side - o].tobytes()) if c["lefts"] >= o and c["rights"] >= side - o else None
         for o in range(side + 1)] for c in made
    ]
    for of, c in zip(windows, made, strict=True):
        for w in of:
            first[w] = min(first.get(w, 10**9), c["id"])
    for i, of in enumerate(windows):
        assert all(w is None or least[i, o] == first[w] for o, w in enumerate(of))
    # In two halves, each context in a text of its own, there were more.
    assert 0 < sum(seen) < 2 * 400 * (side + side // 2)
    shifted = made[:2].copy()
    shifted["anchor"], shifted["lefts"], shifted["rights"] = 1, side, side
    shifted["left"], shifted["right"] = 65, 66
    shifted["left"][1][0] = 67  # reached only by the window that is all left
    seen.clear()
    for low, high in suffixes._STEPS[:-1]:
        suffixes._equal_windows(shifted, np.repeat(shifted["id"][:, None], side + 1, axis=1), low, high)
    assert not seen
