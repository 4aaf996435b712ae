import itertools
import zlib

import numpy as np
import pytest

from cases import SF, documents, needs_tables
from laneflow.llm import language, queries


@pytest.mark.parametrize("n", [2, 3, 4, 5, 7, 8, 20])
def test_codewords(n):
    code = language.codewords(n)
    assert set(np.unique(code)) <= {-1.0, 1.0} and not (np.abs(code.sum(0)) == n).any()
    assert min((code[a] != code[b]).sum() for a, b in itertools.combinations(range(n), 2)) >= 2 ** max(n - 2, 0) if n <= 7 else 16


def test_code_corrects_a_wrong_bit():
    code = language.codewords(4)
    model = language.Model(list("abcd"), code, np.zeros((4, code.shape[1])), np.ones(code.shape[1]), np.full(code.shape, 1 / code.shape[1]))
    for i, word in enumerate(code):
        assert model.decode(word)[0] == "abcd"[i] and not model.decode(word)[2]
        for j in range(len(word)):
            wrong = word.copy()
            wrong[j] *= -0.5
            assert model.decode(wrong)[0] == "abcd"[i]
    assert model.decode(np.zeros(code.shape[1]))[2]


def test_slices_see_every_gram(monkeypatch):
    text = "Some words, é and more; " * 30
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "SLICE", 17)
    assert (language.gram_counts(text) == whole).all()
    assert (language.gram_counts("A  b!!c") == language.gram_counts("a b c")).all()


def test_awkward_documents(spark):
    texts = {"x": "alpha beta gamma delta alpha", "y": "ünö düö trëš quättrö ünö"}
    taught = spark.createDataFrame([(i, t, la) for i, (la, t) in enumerate(texts.items())] * 3 + [(9, None, "x"), (9, "123", "z"), (9, "quiet", None)], "doc_id int, text string, lang string")
    model = language.train(taught)
    assert model.languages == ["x", "y"]
    rows = language.identify(documents(spark, clashes=True).selectExpr("*", "'?' lang_pred", "'?' __language"), model).collect()
    assert len(rows) == 15
    for r in rows:
        if not any(map(str.isalpha, r["text"] or "")):
            assert (r["lang_pred"], r["score"], r["ambiguous"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in ("x", "y") and 0 < r["score"] <= 1
    for la, t in texts.items():
        assert model.predict(t)[0] == la
    assert language.identify(documents(spark, []), model).count() == 0


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert language.train(empty).predict("text") == ("und", 0.0, True)
    one = language.train(spark.createDataFrame([("only this", "x")], "text string, lang string"))
    assert one.predict("anything")[0] == "x"


@needs_tables
def test_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op5_error_correcting_language_id"](spark, SF).collect()
    assert len(rows) == len(docs)
    right = []
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if r["held_out"]:
            right.append(r["lang_pred"] == docs[r["doc_id"]]["lang"])
    assert sum(right) / len(right) > 0.95
