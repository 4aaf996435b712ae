"""Sum-of-squares online packing of documents into windows of a fixed number of tokens.

A document is cut into pieces of at most one window.  Pieces arrive one by one; a
piece of s tokens goes to the fill level h (0 for a new window) that makes the
sum over all levels of the squared number of partially filled windows least.
The numbers are kept in a level array, so a step costs one pass over the levels
and no search among windows.

Pieces are dealt evenly to lanes, each packed by one task as a stream: the state
is the level array and the windows still open, whatever the number of pieces.
More pieces make more lanes, and a lane's few windows left open are all the
padding there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from laneflow.llm import unit_ids
from laneflow.llm.alignment import batches_of
from laneflow.llm.common import materialise

WINDOW = 2048
# Limits of one Arrow batch of texts.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20
# Pieces per lane, on average.
LANE_ROWS = 200_000


class SumOfSquares:
    """One lane's packer."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        # What it adds to the sum of squares when a window leaves or reaches a level.  No window
        # can leave a level that has none; new and full windows do not count.
        self.leave = np.full(window + 1, np.iinfo(np.int64).max // 4)
        self.leave[0] = 0
        self.reach = np.ones(window + 1, np.int64)
        self.reach[window] = 0
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.windows = 0

    def place(self, size: int) -> tuple[int, int]:
        """The window of a piece and its offset there.  Ties go to the fullest level."""
        if not 1 <= size <= self.window:
            raise ValueError(f"a piece of {size} tokens doesn't fit a window of {self.window}")
        change = self.leave[: self.window - size + 1] + self.reach[size:]
        level = len(change) - 1 - int(change[::-1].argmin())
        if level:
            window = self.open[level].pop()
            self._count(level, -1)
        else:
            window, self.windows = self.windows, self.windows + 1
        if level + size < self.window:
            self.open[level + size].append(window)
            self._count(level + size, 1)
        return window, level

    def _count(self, level: int, by: int) -> None:
        n = self.counts[level] = self.counts[level] + by
        self.leave[level] = 1 - 2 * n if n else np.iinfo(np.int64).max // 4
        self.reach[level] = 2 * n + 1


def cut_documents(df: DataFrame, text: str, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """The columns of ``df`` but ``text``, once per piece of at most ``window`` ids.

    Adds ``doc_tokens`` (ids of the document with the end id), ``start``,
    ``length``, ``ids`` (little-endian unsigned 32-bit) and their ``ids_crc32``.
    Names of special tokens in a text become their ids, as the tokenizers library
    has it.  Null and empty texts make one piece, the end id; columns of these
    names are replaced.
    """
    new = {"doc_tokens", "start", "length", "ids", "ids_crc32"}
    kept = [F.col(f"`{c}`") for c in df.columns if c != text and c not in new]
    ids = F.concat(unit_ids.encode(F.col(f"`{text}`"), tokenizer), F.lit(int(end_id).to_bytes(4, "little")))
    whole = df.select(*kept, ids.alias("ids")).withColumn("doc_tokens", (F.length("ids") / 4).cast("long"))

    def piece(start: Column) -> Column:
        part = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), F.lit(window * 4))
        return F.struct(start.alias("start"), (F.length(part) / 4).cast("long").alias("length"), part.alias("ids"), F.crc32(part).alias("ids_crc32"))

    starts = F.sequence(F.lit(0).cast("long"), F.col("doc_tokens") - 1, F.lit(window).cast("long"))
    return whole.select(*kept, "doc_tokens", F.transform(starts, piece).alias("piece")).select(
        *kept, "doc_tokens", F.inline("piece")
    )


def pack(df: DataFrame, size: str, window: int = WINDOW, lane_rows: int = LANE_ROWS) -> DataFrame:
    """All columns of ``df``, one row per piece, with ``sequence_id`` and ``offset``.

    ``size`` must be 1 to ``window`` in every row; anything else, null too, is an
    error.  Equal rows are separate pieces.  A sequence's offsets have no gaps.
    The numbers of the sequences are unique but not consecutive: the lane's
    number stands in the upper bits.  ``df`` is counted first, so it should be a
    written table.  Columns of the two names are replaced.
    """
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("sequence_id", "offset")])
    schema = T.StructType([*kept.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    lanes = max(1, -(-kept.count() // lane_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, packer = TaskContext.get().partitionId(), SumOfSquares(window)
        for batch in batches:
            places = [packer.place(s or 0) for s in batch.column(size).to_pylist()]
            sequences = pa.array([lane << 32 | w for w, _ in places], pa.int64())
            offsets = pa.array([o for _, o in places], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sequences, offsets], [*batch.schema.names, "sequence_id", "offset"])

    # Dealt row by row, so no key can fill a lane.  Spark sorts rows before it deals them: a task that
    # runs again sees the same stream.
    return kept.repartition(lanes).mapInArrow(run, schema)


def pack_documents(df: DataFrame, text: str, tokenizer: str, end_id: int, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Cut all documents and pack the pieces; see :func:`cut_documents` and :func:`pack`."""
    pieces = cut_documents(df, text, tokenizer, end_id, window)
    with batches_of(df.sparkSession, BATCH_ROWS, BATCH_BYTES):
        written = materialise(pieces if keep_ids else pieces.drop("ids"), "pieces")
    return pack(written, "length", window)
