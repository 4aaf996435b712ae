"""Alignment of two tokenizers over a corpus, with inverted bitmaps of token pairs.

Both tokenizers cut the same bytes.  Where their tokens end at the same byte a
group of tokens closes; tokens whose bytes overlap are linked.  How often a pair
of ids is linked in the corpus, and in how many documents, comes from an
inverted index: a pair's row in a block of documents holds compressed bitmaps,
one per binary digit of the number of links in a document (multiplicity planes).
Bitmaps are merged by OR and counted by popcount.  Documents get the scores of
their pairs back through the postings, block by block.

Texts are cut where neither tokenizer can join what stands on both sides: before
a blank or line break between two visible characters.  Each distinct unit is
encoded and aligned once; a worker's memory of units is bounded in bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from laneflow.llm import bpe
from laneflow.llm.common import materialise

# Documents in a block (12 bits in a bitmap's slots) and bitmap words after which a block is closed early.
BLOCK_DOCS, BLOCK_WORDS = 4096, 4_000_000
# Bytes of units that a worker remembers, and limits of one Arrow batch.
REMEMBERED_BYTES, BATCH_ROWS, BATCH_BYTES = 48 << 20, 1024, 8 << 20

_DOCUMENT = "block bigint, position int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_POSTING = "a int, b int, n_docs bigint, pair_links bigint, planes binary"
_OUT = pa.schema([("block", pa.int64()), ("position", pa.int32()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()),
                  ("a", pa.int32()), ("b", pa.int32()), ("n_docs", pa.int64()), ("pair_links", pa.int64()), ("planes", pa.binary())])


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """Bound the Arrow batches of what runs inside; the session's own settings come back afterwards."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


# ------------------------------------------------------------------- alignment


class _Growing:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.room, self.n = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(max(len(values), self.n) + 1024, self.room.dtype)])
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def data(self) -> np.ndarray:
        return self.room[: self.n]


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of every piece: a byte for a byte piece, else its UTF-8 with the space sign as a blank."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def overlaps(ends_a: np.ndarray, size_a: np.ndarray, ends_b: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of A and B tokens that share bytes, in order, and the number of them per A token."""
    first = np.searchsorted(ends_b, ends_a - size_a, "right")
    counts = np.searchsorted(ends_b - size_b, ends_a, "left") - first
    total = np.cumsum(counts)
    return np.repeat(np.arange(len(ends_a)), counts), np.arange(total[-1] if len(total) else 0) + np.repeat(first - total + counts, counts), counts


class Aligner:
    """Alignments of units, each made once and remembered until the memory's bound is reached."""

    def __init__(self, byte_tokenizer: str, piece_model: bytes):
        self.a = Tokenizer.from_str(byte_tokenizer)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.flat_a, self.starts_a = bpe._byte_table(byte_tokenizer)
        pieces = piece_bytes(self.b)
        self.flat_b, self.starts_b = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)])
        self.blank = self.b.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.strings: list[bytes] = []
        self.held = 0
        self.valid, self.counts = _Growing(bool), {k: _Growing(np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        self.pairs = _Growing(np.uint64)
        self.first = _Growing(np.int64)

    def __call__(self, units: list[bytes]) -> np.ndarray:
        """The numbers of units.  Numbers given before are void when the memory was full."""
        if self.held > REMEMBERED_BYTES:
            self.forget()
        missing = [u for u in units if u not in self.index]
        # In parts, so that what is made at a time stays small beside the memory.
        part: list[bytes] = []
        size = 0
        for unit in missing:
            part.append(unit)
            size += len(unit)
            if size > 1 << 20:
                self._make(part)
                part, size = [], 0
        if part:
            self._make(part)
        return np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))

    def _bytes(self, ids: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> tuple[bytes, np.ndarray]:
        size = starts[ids + 1] - starts[ids]
        ends = np.cumsum(size)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[ids] - ends + size, size)
        return flat[places].tobytes(), size

    def _make(self, units: list[bytes]) -> None:
        texts = [u.decode("utf-8", "replace") for u in units]
        ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # B puts a blank before whatever it encodes: it stands for the unit's own, or goes.
        ids_b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        ids_b = [i if t[0] == " " else i[1:] if i[0] == self.blank else [] for t, i in zip(texts, ids_b, strict=True)]
        a, b = (np.fromiter((i for u in ids for i in u), np.int64) for ids in (ids_a, ids_b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(units)) for ids in (ids_a, ids_b))
        bytes_a, size_a = self._bytes(a, self.flat_a, self.starts_a)
        bytes_b, size_b = self._bytes(b, self.flat_b, self.starts_b)
        valid = np.ones(len(units), bool)
        joined = b"".join(units)
        if bytes_a != joined or bytes_b != joined:
            ends = [np.concatenate([[0], np.cumsum(s)])[np.concatenate([[0], np.cumsum(n)])].tolist() for s, n in ((size_a, n_a), (size_b, n_b))]
            for k, unit in enumerate(units):
                valid[k] = bytes_a[ends[0][k] : ends[0][k + 1]] == unit == bytes_b[ends[1][k] : ends[1][k + 1]]
            keep_a, keep_b = np.repeat(valid, n_a), np.repeat(valid, n_b)
            a, size_a, b, size_b = a[keep_a], size_a[keep_a], b[keep_b], size_b[keep_b]
            n_a, n_b = n_a * valid, n_b * valid

        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        of_a, of_b, links = overlaps(ends_a, size_a, ends_b, size_b)
        closes = np.intersect1d(ends_a, ends_b, assume_unique=True)
        stops_a, stops_b = np.searchsorted(ends_a, closes, "right").tolist(), np.searchsorted(ends_b, closes, "right").tolist()
        shown_a, shown_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, p, q = [], 0, 0
        for stop_a, stop_b in zip(stops_a, stops_b, strict=True):
            groups.append(",".join(shown_a[p:stop_a]) + "|" + ",".join(shown_b[q:stop_b]) + ";")
            p, q = stop_a, stop_b
        unit_ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)) * valid)
        n_groups = np.diff(np.searchsorted(closes, unit_ends, "right"), prepend=0)
        links = np.concatenate([[0], np.cumsum(links)])
        n_links = np.diff(links[np.cumsum(n_a)], prepend=0)
        at = 0
        for unit, n in zip(units, n_groups.tolist(), strict=True):
            self.index[unit] = len(self.strings)
            self.strings.append("".join(groups[at : at + n]).encode())
            at += n
        self.held += 2 * len(joined) + 200 * len(units) + 8 * len(of_a)
        self.first.add(self.pairs.n + np.cumsum(n_links) - n_links)
        self.pairs.add(a[of_a].astype(np.uint64) << np.uint64(24) | b[of_b].astype(np.uint64))
        self.valid.add(valid)
        for name, values in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links)):
            self.counts[name].add(values)


@cache
def _aligner(byte_tokenizer: str, piece_model: bytes) -> Aligner:
    return Aligner(byte_tokenizer, piece_model)


_BREAK = np.zeros(256, bool)
_BREAK[[10, 32]] = True
# Bytes of visible ASCII, and lead and second bytes of U+00C0 to U+027F.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xCA] = True


def unit_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units begin in the bytes of texts that begin with a blank at ``starts``."""
    cut = np.zeros(len(data), bool)
    if len(data) > 2:
        after = _VISIBLE[data] | _LEAD[data]
        before = _VISIBLE[data]
        before[1:] |= ((data[1:] & 0xC0) == 0x80) & _LEAD[data[:-1]]
        cut[1:-1] = _BREAK[data[1:-1]] & before[:-2] & after[2:]
    cut[starts] = True
    return np.flatnonzero(cut)


# -------------------------------------------------------------------- bitmaps

_U = np.uint64


def bitmap_words(pair: np.ndarray, position: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of (pair, document, links) entries as sorted (pair, plane, word) keys and 16 bits each.

    Entries of one pair and document are added up first.  A key is the pair, 8
    bits of plane and 8 bits of word.
    """
    key = pair << _U(16) | position.astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    heads = np.flatnonzero(np.concatenate([np.ones(1, bool), key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    links = np.add.reduceat(links[order], heads) if len(heads) else links
    key = key[heads]
    words, bits, plane = [], [], 0
    while (links >> plane).any():
        held = key[(links >> plane) & 1 == 1]
        place = held & _U(0xFFFF)
        words.append(held >> _U(16) << _U(16) | _U(plane << 8) | place >> _U(4))
        bits.append((_U(1) << (place & _U(15))).astype(np.uint16))
        plane += 1
    return merge_words(words, bits)


def merge_words(words: list[np.ndarray], bits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The OR of bitmaps."""
    key = np.concatenate([*words, np.zeros(0, np.uint64)])
    if not len(key):
        return key, np.zeros(0, np.uint16)
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.concatenate([np.ones(1, bool), key[1:] != key[:-1]]))
    return key[heads], np.bitwise_or.reduceat(np.concatenate(bits)[order], heads)


def postings_table(block: int, words: np.ndarray, bits: np.ndarray) -> pa.Table:
    """One row per pair of a block: documents and links, by popcount, and the bitmaps."""
    pair = words >> _U(16)
    heads = np.flatnonzero(np.concatenate([np.ones(1, bool), pair[1:] != pair[:-1]]))
    plane = (words >> _U(8) & _U(0xFF)).astype(np.int64)
    links = np.add.reduceat(np.bitwise_count(bits).astype(np.int64) << plane, heads)
    # A document has a pair if any plane has its bit.
    anywhere, either = merge_words([pair << _U(8) | words & _U(0xFF)], [bits])
    pair_of = anywhere >> _U(8)
    docs = np.add.reduceat(np.bitwise_count(either).astype(np.int64), np.flatnonzero(np.concatenate([np.ones(1, bool), pair_of[1:] != pair_of[:-1]])))
    data = ((words & _U(0xFFFF)) << _U(16) | bits.astype(np.uint64)).astype("<u4")
    offsets = (np.append(heads, len(words)) * 4).astype(np.int32)
    pair = pair[heads]
    n = len(heads)
    made = {
        "block": pa.array(np.full(n, block), pa.int64()), "a": pa.array((pair >> _U(24)).astype(np.int32)), "b": pa.array((pair & _U(0xFFFFFF)).astype(np.int32)),
        "n_docs": pa.array(docs), "pair_links": pa.array(links),
        "planes": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)]),
    }
    return pa.table([made.get(f.name, pa.nulls(n, f.type)) for f in _OUT], schema=_OUT)


def expand_planes(planes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The set bits of a column of bitmaps: row, position in the block, and what the bit counts."""
    values = planes.to_pylist()
    words = np.frombuffer(b"".join(values), "<u4")
    row = np.repeat(np.arange(len(values)), [len(v) // 4 for v in values])
    base, plane = ((words >> 16) & 0xFF).astype(np.int64) * 16, (words >> 24).astype(np.int64)
    rows, places, weights = [], [], []
    for j in range(16):
        held = np.flatnonzero(words >> j & 1)
        rows.append(row[held])
        places.append(base[held] + j)
        weights.append(np.int64(1) << plane[held])
    return np.concatenate(rows), np.concatenate(places), np.concatenate(weights)


# ----------------------------------------------------------------------- index


class _Block:
    """Documents and bitmaps of one block, until it is full."""

    def __init__(self, number: int):
        self.number, self.docs, self.size = number, 0, 0
        self.words: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []

    def rows(self) -> Iterator[pa.RecordBatch]:
        words, bits = merge_words(self.words, self.bits)
        if len(words):
            yield from postings_table(self.number, words, bits).to_batches(max_chunksize=10_000)


def _align_rows(aligner: Aligner, texts: pa.Array, block: _Block) -> pa.Table:
    """Documents' rows, their pairs added to the block."""
    n = len(texts)
    whole = texts.cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + n + 1]
    base = int(offsets[0])
    offsets = offsets - base
    held = whole.buffers()[2]
    data = np.frombuffer(held, np.uint8)[base : base + int(offsets[-1])] if held else np.zeros(0, np.uint8)
    starts = unit_starts(data, offsets[:-1][np.diff(offsets) > 0])
    bounds = np.append(starts, len(data)).astype(np.int64)
    units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    coded = units.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known = aligner(coded.dictionary.to_pylist())
    doc = np.searchsorted(offsets, starts, "right") - 1

    good = np.bincount(doc, ~aligner.valid.data[known][codes], n) == 0
    good &= np.diff(offsets) > 0
    columns = {k: np.bincount(doc, v.data[known][codes], n).astype(np.int64) * good for k, v in aligner.counts.items()}
    strings = pa.array([aligner.strings[i] for i in known.tolist()], pa.large_binary()).take(pa.array(codes))
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(codes) + 1] if len(codes) else np.zeros(1, np.int64)
    joined = memoryview(strings.buffers()[2]) if len(codes) and strings.buffers()[2] else memoryview(b"")
    first = np.searchsorted(doc, np.arange(n + 1))
    cuts = ends[first].tolist()
    digests = [hashlib.sha256(joined[s : e - 1]).hexdigest() if ok else "" for s, e, ok in zip(cuts, cuts[1:], good.tolist(), strict=False)]

    wanted = good[doc]
    size = max(len(known), 1)
    seen, times = np.unique(doc[wanted] * size + codes[wanted], return_counts=True)
    unit = known[seen % size] if len(known) else seen
    counts = aligner.counts["n_links"].data[unit]
    total = np.cumsum(counts)
    places = np.arange(total[-1] if len(total) else 0) + np.repeat(aligner.first.data[unit] - total + counts, counts)
    words, bits = bitmap_words(aligner.pairs.data[places], np.repeat(seen // size + block.docs, counts), np.repeat(times, counts))
    block.words.append(words)
    block.bits.append(bits)
    block.size += len(words)
    position = np.arange(n, dtype=np.int32) + np.int32(block.docs)
    block.docs += n
    made = {"block": pa.array(np.full(n, block.number), pa.int64()), "position": pa.array(position), **{k: pa.array(v) for k, v in columns.items()}, "groups_sha256": pa.array(digests, pa.string())}
    return pa.table([made.get(f.name, pa.nulls(n, f.type)) for f in _OUT], schema=_OUT)


@dataclass
class AlignmentIndex:
    """``documents``: id, block, position and counts, a row per document.  ``postings``: a row per (block, pair)."""

    id: str
    documents: DataFrame
    postings: DataFrame

    def pair_scores(self) -> DataFrame:
        """(a, b, n_docs, n_links, best): all linked pairs, and whether no other A id has more links with this B id."""
        sums = self.postings.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("pair_links").alias("n_links"))
        # A B id's row has at most as many pairs as A has ids.
        return sums.withColumn("best", F.col("n_links") == F.max("n_links").over(Window.partitionBy("b")))

    def document_scores(self, scores: DataFrame) -> DataFrame:
        """``documents`` with ``n_best`` and ``count_sum``: over a document's links, those best for their B id, and the pairs' counts added up."""

        def run(group: pa.Table) -> pa.Table:
            row, place, times = expand_planes(group.column("planes").combine_chunks())
            total, best = np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
            np.add.at(total, place, group.column("n_links").to_numpy()[row] * times)
            np.add.at(best, place, group.column("best").to_numpy()[row] * times)
            held = np.flatnonzero(total)
            block = np.full(len(held), group.column("block")[0].as_py())
            return pa.table({"block": block, "position": held.astype(np.int32), "n_best": best[held], "count_sum": total[held]})

        scored = self.postings.select("block", "a", "b", "planes").join(scores.select("a", "b", "n_links", "best"), ["a", "b"])
        sums = scored.select("block", "planes", "n_links", "best").groupBy("block").applyInArrow(run, "block bigint, position int, n_best bigint, count_sum bigint")
        return self.documents.join(sums, ["block", "position"], "left").fillna(0, ["n_best", "count_sum"])

    def pair_documents(self, pairs: DataFrame) -> DataFrame:
        """(a, b, id, links): the documents of pairs (columns a and b), from their postings."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, place, times = expand_planes(batch.column("planes"))
                columns = [batch.column(c).to_numpy()[row] for c in ("a", "b", "block")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(place.astype(np.int32)), pa.array(times)], ["a", "b", "block", "position", "times"])

        wanted = self.postings.join(pairs.select("a", "b").distinct(), ["a", "b"]).select("a", "b", "block", "planes")
        bits = wanted.mapInArrow(run, "a int, b int, block bigint, position int, times bigint")
        links = bits.groupBy("a", "b", "block", "position").agg(F.sum("times").alias("links"))
        return links.join(self.documents, ["block", "position"]).select("a", "b", F.col(f"`{self.id}`"), "links")


def build_index(df: DataFrame, id: str, text: str, byte_tokenizer: str, piece_model: bytes) -> AlignmentIndex:
    """Align every text of ``df`` and index its token pairs.

    ``byte_tokenizer`` is the JSON of a byte-level BPE (A), ``piece_model`` a
    sentencepiece model with byte fallback (B); both see the text behind a
    blank, special tokens are ordinary text.  Null and empty texts, and those
    that a tokenizer does not give back byte for byte, have no tokens: zeros and
    an empty digest.  Every row is a document of its own, also where ids or
    texts repeat.  Ids must be below 2**24 in either vocabulary.  Other columns
    are not read; ``id`` must not be named as a result.
    """
    if id.lower() in {f.name.lower() for f in _OUT}:
        raise ValueError(f"{id} is the name of a result")
    kind = df.schema[id].dataType
    schema = T.StructType([T.StructField(id, kind), *T.StructType.fromDDL(f"{_DOCUMENT}, {_POSTING}").fields])
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_tokenizer, piece_model)
        part, blocks = TaskContext.get().partitionId() << 32, 0
        block = _Block(part)

        def named(rows: pa.Table | pa.RecordBatch, ids: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
            ids = pa.nulls(rows.num_rows, arrow) if ids is None else ids.cast(arrow)
            yield from pa.table([ids, *rows.columns], names=[id, *_OUT.names]).to_batches()

        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                rows = batch.slice(start, BATCH_ROWS)
                if block.docs + rows.num_rows > BLOCK_DOCS or block.size > BLOCK_WORDS:
                    for full in block.rows():
                        yield from named(full)
                    blocks += 1
                    block = _Block(part + blocks)
                yield from named(_align_rows(aligner, rows.column(1), block), rows.column(0))
        for full in block.rows():
            yield from named(full)

    content = F.col(f"`{text}`")
    bytes_of = F.when(F.length(content) > 0, F.concat(F.lit(" "), content)).otherwise(F.lit("")).cast("binary")
    with batches_of(df.sparkSession, BATCH_ROWS, BATCH_BYTES):
        made = materialise(df.select(F.col(f"`{id}`"), bytes_of.alias("__bytes")).mapInArrow(run, schema), "alignment")
    documents = made.where("a IS NULL").select(F.col(f"`{id}`"), *[f.split()[0] for f in _DOCUMENT.split(", ")])
    return AlignmentIndex(id, documents, made.where("a IS NOT NULL").select("block", *[f.split()[0] for f in _POSTING.split(", ")]))
