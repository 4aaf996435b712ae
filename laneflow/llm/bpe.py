"""Byte-level BPE over Arrow batches: encoding with offsets, and exact decoding.

Encoding uses the tokenizers library.  A text falls into the matches of the
split pattern, and a match never spans a space that stands before a visible
character, so words can be encoded apart from each other: each distinct word is
encoded once per Python worker and then looked up.  Decoding inverts the byte
alphabet of the vocabulary and joins bytes; a character whose bytes lie in
several tokens comes out whole again.
"""

from __future__ import annotations

import base64
import codecs
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from laneflow.llm.common import forgettable, release

# Distinct words, and bytes of them and their ids, in a worker's newer memory.  When it is full it becomes the older
# one, from which words come back on use, and the former older one is forgotten.  Words of more characters than
# LONGEST are not remembered.  This costs time only.
REMEMBERED, REMEMBERED_BYTES, LONGEST = 500_000, 40 << 20, 64
# Tokens expanded at a time while decoding.
SLICE = 1 << 17

# Bytes that a dictionary takes per entry, about.
_ENTRY = 100
# A space before anything but these is not taken for a border.  Fixed value.
_VISIBLE = "!-~À-ɏ"
_BORDER = re.compile(f" (?=[{_VISIBLE}])")
_LINES = re.compile(f"(.*[{_VISIBLE}])\n([{_VISIBLE}].*)")
_ODD_SPACE = re.compile(f" (?![{_VISIBLE}])")


# ------------------------------------------------------------------ vocabulary


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves; the other bytes, in order,
    take the code points from 256 on.
    """
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(hidden)}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes ``token``: what is left when only lower ranks may merge."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    if len(parts) != 2:
        raise ValueError(f"{token!r} can't be made from tokens of lower rank")
    return parts[0], parts[1]


def tokenizer_from_ranks(path: str, pattern: str) -> str:
    """A tokenizer, in the tokenizers library's JSON, from a file of ranked tokens and the pattern that splits texts."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    alphabet = byte_alphabet()
    shown = {token: "".join(map(alphabet.__getitem__, token)) for token in ranks}
    merges = [tuple(shown[h] for h in _halves(t, ranks)) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    tokenizer = Tokenizer(models.BPE({shown[t]: r for t, r in ranks.items()}, merges))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tokenizer.to_str()


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


# -------------------------------------------------------------------- encoding


class _Words(dict):
    """Ids, as bytes, of words behind a prefix; missing words are encoded on first use.

    ``plain``: the same without a prefix, for what stands behind a line break.
    """

    def __init__(self, tokenizer: Tokenizer, prefix: str, plain: _Words | None = None):
        super().__init__()
        self.tokenizer, self.prefix, self.plain, self.older = tokenizer, prefix, self if plain is None else plain, {}
        self.held = 0

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._made(word)
        if len(word) > LONGEST:
            return ids
        if len(self) >= REMEMBERED or self.held >= REMEMBERED_BYTES:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self[word] = ids
        self.held += getsizeof(word) + getsizeof(ids) + _ENTRY
        return ids

    def _made(self, word: str) -> bytes:
        # Borders of every split pattern in use here: a letter before a comma or full stop, and
        # either side of a line break that stands between visible characters.
        if len(word) > 1 and word[-1] in ",." and word[-2].isascii() and word[-2].isalpha():
            return self[word[:-1]] + self.plain[word[-1]]
        if "\n" in word and (lines := _LINES.fullmatch(word)):
            return self[lines[1]] + self._encode("\n") + self.plain[lines[2]]
        return self._encode(self.prefix + word)

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class Encoder:
    """Whole texts to ids, as little-endian unsigned 32-bit integers; special tokens are ordinary text."""

    def __init__(self, tokenizer: str):
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.encode_special_tokens = True
        self.first = _Words(self.tokenizer, "")
        self.later = _Words(self.tokenizer, " ", self.first)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, *later = _BORDER.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        return (self.first[first] if first else b"") + b"".join(map(self.later.__getitem__, later))


@forgettable
def _encoder(tokenizer: str) -> Encoder:
    return Encoder(tokenizer)


def encode(text: Column, tokenizer: str) -> Column:
    """The ids of a text as a binary column (little-endian unsigned 32-bit); null and empty texts have none.

    ``tokenizer`` is the JSON of :func:`tokenizer_from_ranks` or :func:`read_tokenizer`.
    """

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        encoder = _encoder(tokenizer)
        return pa.array([encoder(t.as_py()) for t in texts], pa.binary())

    # Else Spark may copy the call into every expression that uses the ids.
    return run.asNondeterministic()(text)


# -------------------------------------------------------------------- decoding


@cache
def _byte_table(tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in a row by id, and where each begins (and the last one ends)."""
    table = _read_bytes(tokenizer)
    release()  # what reading the vocabulary took
    return table


def _read_bytes(tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    back = {char: byte for byte, char in byte_alphabet().items()}
    spec = json.loads(tokenizer)
    special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    tokens = {i: bytes(map(back.__getitem__, t)) for t, i in spec["model"]["vocab"].items() if i not in special} | special
    rows = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])


def decode_ids(ids: np.ndarray, tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the tokens, and the end of each token in them."""
    flat, starts = _byte_table(tokenizer)
    begins = starts[ids]
    lengths = starts[ids + 1] - begins
    ends = np.cumsum(lengths)
    parts = []
    for i in range(0, len(ids), SLICE):
        cut = slice(i, i + SLICE)
        before = ends[cut] - lengths[cut]
        places = np.arange(before[0], ends[cut][-1]) if len(before) else np.zeros(0, np.int64)
        parts.append(flat[places + np.repeat(begins[cut] - before, lengths[cut])])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8), ends


def decode(ids: Column, tokenizer: str) -> Column:
    """The bytes behind a binary column of ids; no ids give no bytes."""

    @F.arrow_udf("binary")
    def run(batch: pa.Array) -> pa.Array:
        rows = [b"" if v is None else v for v in batch.to_pylist()]
        counts = np.array([len(r) // 4 for r in rows], np.int64)
        data, ends = decode_ids(np.frombuffer(b"".join(rows), "<u4").astype(np.int64), tokenizer)
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        whole = data.tobytes()
        return pa.array([whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())

    return run(ids)


def decode_stream(pieces: Iterable[bytes], tokenizer: str) -> Iterator[str]:
    """Text of successive pieces of ids; a character split between pieces comes with the later one."""
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    for piece in pieces:
        yield reader.decode(decode_ids(np.frombuffer(piece, "<u4").astype(np.int64), tokenizer)[0].tobytes())
    yield reader.decode(b"", True)


def token_offsets(text: str, ids: bytes, tokenizer: str) -> list[tuple[int, int]]:
    """The characters [start, end) that each token touches; tokens that share a character both name it."""
    data, ends = decode_ids(np.frombuffer(ids, "<u4").astype(np.int64), tokenizer)
    if data.tobytes() != text.encode():
        raise ValueError("these ids are not those of this text")
    character = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
    starts = np.concatenate([[0], ends]).astype(np.int64)[:-1]
    return [(int(character[a]), int(character[b - 1]) + 1) for a, b in zip(starts, ends, strict=True)]


def offsets(text: Column, ids: Column, tokenizer: str) -> Column:
    """For each token the characters it touches: an array of (start, end)."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(texts: pa.Array, batch: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), batch.to_pylist(), strict=True)
        return pa.array([[{"start": s, "end": e} for s, e in token_offsets(t or "", i or b"", tokenizer)] for t, i in rows], kind)

    return run(text, ids)
