import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cases import SF, documents, needs_tables
from laneflow.llm import bpe, packing, queries, unit_ids

JSON = public_tokenizers.path("byte_bpe_50k.json")


def brute(sizes, window):
    """Try every level and count the squares anew."""
    levels, places = [], []
    for size in sizes:
        counts = defaultdict(int)
        for level in levels:
            counts[level] += level < window
        best = None
        for level in {0} | {h for h in levels if h + size <= window}:
            after = dict(counts)
            if level:
                after[level] -= 1
            if level + size < window:
                after[level + size] = after.get(level + size, 0) + 1
            score = sum(n * n for n in after.values())
            if best is None or (score, -level) < best:
                best = (score, -level)
        level = -best[1]
        places.append(level)
        if level:
            levels[levels.index(level)] += size
        else:
            levels.append(size)
    return places


def test_level_array_makes_the_least_squares():
    draw = random.Random(4)
    for window in (1, 7, 16):
        for _ in range(60):
            sizes = [draw.randint(1, window) for _ in range(draw.randint(0, 40))]
            packer = packing.SumOfSquares(window)
            assert [packer.place(s)[1] for s in sizes] == brute(sizes, window)
            assert (packer.counts[1:window] == [len(x) for x in packer.open[1:window]]).all()


def test_sizes_that_fit_no_window():
    for size in (0, -1, 9):
        with pytest.raises(ValueError):
            packing.SumOfSquares(8).place(size)


def check(rows, window=2048):
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return docs


def test_awkward_documents(spark):
    rows = packing.pack_documents(documents(spark, clashes=True), "text", bpe.read_tokenizer(JSON), 1).collect()
    docs = check(rows)
    assert docs[1] == docs[2] == [(0, 1, 1)] and len(docs[6]) == 2 and len(docs[None]) == 2
    assert sum(n for _, n, _ in docs[10]) == docs[10][0][2]
    assert packing.pack_documents(documents(spark, []), "text", bpe.read_tokenizer(JSON), 1).count() == 0


@pytest.mark.parametrize("special", [True, False])
def test_ids_are_those_of_the_library(special):
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = not special
    encoder = unit_ids.UnitEncoder(bpe.read_tokenizer(JSON), special)
    draw = random.Random(6)
    parts = [" ", "  ", "\n", "\t", "a", "word", "'s", "don't", ",", ".", "!!", "12", "é", "日本", "\x1c", "\x85", "😀", " A", "ß", "<|endoftext|>", "#", "\r\n", "\xa0", "²"]
    for _ in range(300):
        texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(draw.randint(1, 8))]
        got = encoder(pa.array([t.encode() for t in texts], pa.binary())).to_pylist()
        assert got == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts], texts
    assert encoder(pa.array([], pa.binary())).to_pylist() == [] and encoder(pa.array([b"", b""], pa.binary())).to_pylist() == [b"", b""]
    sliced = pa.array([b"x", b"two words", b"y"], pa.binary()).slice(1, 1)
    assert encoder(sliced).to_pylist() == [np.array(tokenizer.encode("two words").ids, "<u4").tobytes()]


def test_special_tokens_in_a_document(spark):
    rows = packing.cut_documents(documents(spark, [(1, "a <|endoftext|> b")]), "text", bpe.read_tokenizer(JSON), 1).collect()
    assert 50256 in np.frombuffer(rows[0]["ids"], "<u4").tolist()


def test_memory_of_texts_without_spaces():
    encoder = unit_ids.UnitEncoder(bpe.read_tokenizer(JSON), True)
    for i in range(20):
        encoder(pa.array([("日本語" * 300 + str(i * 500 + j)).encode() for j in range(500)], pa.binary()))
    assert not encoder.known and encoder.held == 0


def test_memory_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(unit_ids, "REMEMBERED_BYTES", 100_000)
    encoder = unit_ids.UnitEncoder(bpe.read_tokenizer(JSON), True)
    for i in range(30):
        encoder(pa.array([f"w{i * 100 + j} v{j}".encode() for j in range(100)], pa.binary()))
        assert encoder.held < 100_000 + 100 * 400


def test_several_lanes(spark):
    df = spark.createDataFrame([(i, 1 + i * 37 % 100, 1) for i in range(500)], "doc_id int, size int, offset int")
    rows = packing.pack(df, "size", 128, lane_rows=100).collect()
    assert len(rows) == 500 and len({r["sequence_id"] >> 32 for r in rows}) == 5


@needs_tables
def test_query(spark):
    rows = queries.QUERIES["op2_sum_of_squares_packing"](spark, SF).collect()
    docs = check(rows)
    tokenizer = Tokenizer.from_file(JSON)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(docs) == set(texts)
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(piece.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    tokens = sum(map(len, ids.values()))
    assert sum(r["length"] for r in rows) == tokens
    assert tokens / (2048 * len({r["sequence_id"] for r in rows})) > 0.85


def test_freed_memory_goes_back():
    """A worker that has encoded lives on beside those of the next stage."""
    import numpy as np
    import psutil

    from laneflow.llm.common import release

    held = lambda: psutil.Process().memory_info().rss
    release()
    before, kept = held(), []
    small = [np.zeros(100_000, np.uint8) + 1 for _ in range(2000)]
    kept.append(np.ones(100_000, np.uint8))
    del small
    release()
    assert held() - before < 50 << 20
