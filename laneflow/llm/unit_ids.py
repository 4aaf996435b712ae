"""Byte-level BPE by whole Arrow batches: each distinct unit of a batch is looked up once.

The bytes of a batch's texts are cut into units where the split pattern always
cuts (before a blank or line break between two visible characters), units are
numbered by Arrow's dictionary encoding, and the ids of the numbered units are
gathered into the texts again.  No Python step runs per word.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from tokenizers import Tokenizer

from laneflow.llm.alignment import unit_starts
from laneflow.llm.common import forgettable, utf8

# Bytes of units and ids that a worker remembers, and the longest unit that it does.
REMEMBERED_BYTES, LONGEST = 128 << 20, 64
# Bytes of units encoded at a time.
SLICE = 1 << 16


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(","), ord(".")]] = True


def _starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where units begin: also at a comma or full stop behind a letter, which the pattern always parts."""
    cut = np.zeros(len(data), bool)
    cut[1:] = _STOP[data[1:]] & _LETTER[data[:-1]]
    cut[unit_starts(data, texts)] = True
    return np.flatnonzero(cut)


class UnitEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    ``special`` makes the names of special tokens in a text into their ids, as the
    tokenizers library does on its own; else they are ordinary text.
    """

    def __init__(self, tokenizer: str, special: bool):
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.encode_special_tokens = not special
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def _encode(self, units: list[bytes]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast([u.decode("utf-8", "replace") for u in units], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in made]

    def units(self, units: list[bytes]) -> list[bytes]:
        """Ids of distinct units; short ones are remembered until the memory's bound is reached, which costs time only."""
        if self.held > REMEMBERED_BYTES:
            self.known, self.held = {}, 0
        passing: dict[bytes, bytes] = {}
        part: list[bytes] = []
        size = 0

        def flush() -> None:
            for unit, ids in zip(part, self._encode(part), strict=True):
                if len(unit) > LONGEST:
                    passing[unit] = ids
                else:
                    self.known[unit] = ids
                    self.held += len(unit) + len(ids) + 150

        for unit in units:
            if unit not in self.known:
                part.append(unit)
                size += len(unit)
                if size > SLICE:
                    flush()
                    part, size = [], 0
        if part:
            flush()
        return [passing[u] if len(u) > LONGEST else self.known[u] for u in units]

    def __call__(self, texts: pa.Array) -> pa.Array:
        """The ids of every text of a batch of bytes."""
        n = len(texts)
        whole = texts.cast(pa.large_binary())
        offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + n + 1] if n else np.zeros(1, np.int64)
        base = int(offsets[0])
        offsets = offsets - base
        held = whole.buffers()[2] if n else None
        data = np.frombuffer(held, np.uint8)[base : base + int(offsets[-1])] if held else np.zeros(0, np.uint8)
        starts = _starts(data, offsets[:-1][np.diff(offsets) > 0])
        bounds = np.append(starts, len(data)).astype(np.int64)
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(self.units(units.dictionary.to_pylist()), pa.large_binary()).take(units.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        # A text's ids are those of its units, which lie side by side already.
        cuts = ends[np.searchsorted(starts, offsets)]
        joined = ids.buffers()[2] if len(ids) else None
        return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(cuts.astype(np.int64)), joined or pa.py_buffer(b"")]).cast(pa.binary())


@forgettable
def _encoder(tokenizer: str, special: bool) -> UnitEncoder:
    # Spark has a worker per core; threads inside of it would only hold more memory.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return UnitEncoder(tokenizer, special)


def encode(text: str | Column, tokenizer: str, special: bool = True) -> Column:
    """The ids of a text as a binary column; null and empty texts have none.

    ``tokenizer`` is the JSON of a byte-level BPE with the split pattern of its
    family, special tokens among them; see :class:`UnitEncoder` for ``special``.
    """

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return _encoder(tokenizer, special)(texts)

    # Else Spark may copy the call into every expression that uses the ids.
    return run.asNondeterministic()(utf8(text))
