import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cases import AWKWARD, SF, documents, needs_tables
from laneflow.llm import alignment, bpe, queries


@pytest.fixture(scope="module")
def files():
    return bpe.read_tokenizer(P.path("byte_bpe_50k.json")), open(P.path("piece_bpe_32k.model"), "rb").read()


@pytest.fixture(scope="module")
def libraries(files):
    a = Tokenizer.from_str(files[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_proto=files[1])


def cut(text, libraries):
    """Tokens of the whole text as (id, bytes) under both tokenizers; none if they don't give it back."""
    a, b = libraries
    back = {char: byte for byte, char in bpe.byte_alphabet().items()}
    left = [(e, bytes(map(back.__getitem__, a.id_to_token(e)))) for e in a.encode(" " + (text or ""), add_special_tokens=False).ids]
    right = []
    for i in b.encode(text or ""):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + (text or "")).encode()
    whole = text and b"".join(x for _, x in left) == want == b"".join(x for _, x in right)
    return (left, right) if whole else ([], [])


def aligned(text, libraries):
    left, right = cut(text, libraries)
    groups, links, i, j, at_a, at_b, ga, gb = [], [], 0, 0, 0, 0, [], []
    spans = [[], []]
    for side, tokens in enumerate((left, right)):
        at = 0
        for id, data in tokens:
            spans[side].append((at, at + len(data), id))
            at += len(data)
    for s, e, x in spans[0]:
        while j < len(spans[1]) and spans[1][j][1] <= s:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < e:
            links.append((x, spans[1][k][2]))
            k += 1
    both = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
    i = j = 0
    for end in sorted(both):
        ga, gb = [], []
        while i < len(spans[0]) and spans[0][i][1] <= end:
            ga.append(str(spans[0][i][2]))
            i += 1
        while j < len(spans[1]) and spans[1][j][1] <= end:
            gb.append(str(spans[1][j][2]))
            j += 1
        groups.append(",".join(ga) + "|" + ",".join(gb))
    return len(left), len(right), groups, links


def brute(rows, libraries):
    found = [(id, *aligned(text, libraries)) for id, text in rows]
    counts = Counter(pair for *_, links in found for pair in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for id, n_a, n_b, groups, links in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        out.append((id, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=repr), counts


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
PARTS = [" ", "  ", "\n", "\r\n", "\t", "a", "word", "'s", "don't", ",", ".", "!!", "12", "é", "É", "日本", "▁", "\x00", "\x85", "😀", "́", " A", "ß", "<|endoftext|>",
         "<s>", "<0x0A>", "<unk>", "#", "\xa0", " ", " the", "\nThe", "à la", "ɿ ɿ", "x\ny"]


def test_units_align_as_whole_texts(files, libraries):
    draw = random.Random(8)
    aligner = alignment.Aligner(*files)
    for _ in range(1500):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(1, 14)))
        data = np.frombuffer((" " + text).encode(), np.uint8)
        starts = alignment.unit_starts(data, np.zeros(1, np.int64)).tolist()
        units = [data[s:e].tobytes() for s, e in zip(starts, [*starts[1:], len(data)], strict=True)]
        known = aligner(units)
        n_a, n_b, groups, links = aligned(text, libraries)
        if not aligner.valid.data[known].all():
            assert (n_a, n_b) == (0, 0), repr(text)
            continue
        assert b"".join(aligner.strings[i] for i in known).decode() == "".join(g + ";" for g in groups), repr(text)
        assert [int(aligner.counts[k].data[known].sum()) for k in ("n_a", "n_b", "n_links")] == [n_a, n_b, len(links)]


def test_memory_is_bounded_in_bytes(files, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED_BYTES", 200_000)
    aligner = alignment.Aligner(*files)
    for i in range(40):
        aligner([f" {'日本語' * 50}{i}-{j}".encode() for j in range(50)])
        assert aligner.held < 200_000 + 250_000
    assert len(aligner.index) < 2000


def test_bitmaps_against_counting():
    draw = np.random.default_rng(2)
    pair, place, links = draw.integers(0, 40, 5000).astype(np.uint64), draw.integers(0, 4096, 5000), draw.integers(1, 300, 5000)
    halves = [alignment.bitmap_words(pair[place % 2 == k], place[place % 2 == k], links[place % 2 == k]) for k in (0, 1)]
    rows = alignment.postings_table(7, *alignment.merge_words(*map(list, zip(*halves, strict=True))))
    want = Counter()
    for p, d, n in zip(pair.tolist(), place.tolist(), links.tolist(), strict=True):
        want[p, d] += n
    row, at, times = alignment.expand_planes(rows.column("planes").combine_chunks())
    got = Counter()
    for r, d, n in zip(row.tolist(), at.tolist(), times.tolist(), strict=True):
        got[rows.column("b")[r].as_py(), d] += n
    assert got == want
    for r in rows.to_pylist():
        assert r["n_docs"] == sum(p == r["b"] for p, _ in want) and r["pair_links"] == sum(n for (p, _), n in want.items() if p == r["b"])


@pytest.mark.parametrize("docs", [4096, 3])
def test_awkward_documents(spark, files, libraries, monkeypatch, docs):
    monkeypatch.setattr(alignment, "BLOCK_DOCS", docs)
    monkeypatch.setattr(alignment, "BATCH_ROWS", min(docs, 1024))
    rows = [*AWKWARD, (20, "▁ blank sign"), (21, "the <s> </s> <|endoftext|>"), (22, "a " * 3000)]
    df = documents(spark, rows).selectExpr("*", "'?' AS a", "'?' AS planes", "'?' AS n_links", "'?' AS best")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    index = alignment.build_index(df, "doc_id", "text", *files)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    scores = index.pair_scores()
    want, counts = brute(rows, libraries)
    assert sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in index.document_scores(scores).collect()), key=repr) == want
    assert {(r["a"], r["b"]): r["n_links"] for r in scores.collect()} == dict(counts)
    (pair, n), *_ = counts.most_common(1)
    held = index.pair_documents(spark.createDataFrame([pair, pair], "a int, b int")).collect()
    assert sum(r["links"] for r in held) == n and len(held) == next(r["n_docs"] for r in scores.collect() if (r["a"], r["b"]) == pair)


def test_empty_table_and_clashing_id(spark, files):
    index = alignment.build_index(documents(spark, []), "doc_id", "text", *files)
    assert index.document_scores(index.pair_scores()).count() == 0
    with pytest.raises(ValueError):
        alignment.build_index(documents(spark).withColumnRenamed("doc_id", "planes"), "planes", "text", *files)


@needs_tables
def test_query(spark, libraries):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op13_cross_tokenizer_alignment"](spark, SF).collect()
    assert sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got), key=repr) == brute(rows, libraries)[0]
