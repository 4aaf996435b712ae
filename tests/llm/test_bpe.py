import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from cases import SF, documents, needs_tables
from pyspark.sql import functions as F

from laneflow.llm import bpe, common, queries, unit_ids

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.tokenizer_from_ranks(RANKS, P.PATTERN)


def test_byte_alphabet_is_one_to_one():
    alphabet = bpe.byte_alphabet()
    assert len(set(alphabet.values())) == 256 and alphabet[ord("A")] == "A" and alphabet[32] == "Ġ" and alphabet[10] == "Ċ"


def test_against_another_library(reference, tokenizer):
    draw = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "word", "'s", "'", "'ll", "don't", ",", ".", "!!", "12", "é", "É", "日本", "᠎", "\x1c", "\x85", "😀", "́", " A", "ß",
             "<|endoftext|>", "#", "\r\n", "\xa0", " \n", "²", "ǅ"]
    encoder = bpe.Encoder(tokenizer)
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))
        assert encoder(text) == np.array(reference.encode_ordinary(text), "<u4").tobytes(), repr(text)


def test_forgetting_changes_nothing(reference, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    encoder = bpe.Encoder(tokenizer)
    text = "one two three, four two one. five six two three, one"
    for _ in range(3):
        assert encoder(text) == np.array(reference.encode_ordinary(text), "<u4").tobytes()


def test_memory_is_bounded_in_bytes(reference, tokenizer, monkeypatch):
    """Texts without spaces are one word each, and words may be many."""
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 50_000)
    encoder = bpe.Encoder(tokenizer)
    for i in range(1500):
        text = f"word{i} other{i} " + chr(0x4E00 + i) * 300
        assert encoder(text) == np.array(reference.encode_ordinary(text), "<u4").tobytes()
    held = [len(k) + len(v) for words in (encoder.first, encoder.later) for part in (words, words.older) for k, v in part.items()]
    assert sum(held) < 4 * 50_000 and max(held) < 1000


def test_release_forgets_what_encoders_remember(tokenizer):
    before = bpe._encoder(tokenizer), unit_ids._encoder(tokenizer, True)
    assert bpe._encoder(tokenizer) is before[0]
    common.release()
    assert bpe._encoder(tokenizer) is not before[0] and unit_ids._encoder(tokenizer, True) is not before[1]


def test_split_characters_and_offsets(tokenizer):
    text = "a😀日b é"
    ids = bpe.Encoder(tokenizer)(text)
    pieces = [ids[i : i + 4] for i in range(0, len(ids), 4)]
    assert "".join(bpe.decode_stream(pieces, tokenizer)) == text and len(pieces) > 5
    spans = bpe.token_offsets(text, ids, tokenizer)
    assert spans[0] == (0, 1) and spans.count((1, 2)) == 2 and spans[-1][1] == len(text)
    with pytest.raises(ValueError):
        bpe.token_offsets("other", ids, tokenizer)


def test_awkward_documents(spark, tokenizer, reference):
    df = documents(spark, clashes=True).withColumn("ids", bpe.encode(F.col("text"), tokenizer)).withColumn("back", bpe.decode(F.col("ids"), tokenizer))
    for r in df.withColumn("spans", bpe.offsets(F.col("text"), F.col("ids"), tokenizer)).collect():
        text = r["text"] or ""
        assert bytes(r["ids"]) == np.array(reference.encode_ordinary(text), "<u4").tobytes() and bytes(r["back"]) == text.encode()
        assert len(r["spans"]) == len(r["ids"]) // 4
    assert documents(spark, []).withColumn("ids", bpe.encode(F.col("text"), tokenizer)).count() == 0


@needs_tables
def test_query(spark, reference):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_byte_level_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(reference.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
