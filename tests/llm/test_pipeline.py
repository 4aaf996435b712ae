from collections import defaultdict

import corpus_pipeline
from cases import AWKWARD, PROSE, SF, needs_tables

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def stage(spark, name, rows):
    docs = spark.createDataFrame([(i, t, la, "src", len(t or "")) for i, t, la in rows], SCHEMA)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert name == "packing" or out.columns == docs.columns
    return sorted(out.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] if "text" in out.columns and r["text"] else ""))


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "suffix_array_dedup", "secret_scan", "packing"]


def test_language_stage(spark):
    taught = [(i, t, la) for i, (t, la) in enumerate([(PROSE, "en"), ("ünö düö trëš quättrö çinque", "xx")] * 4)]
    out = stage(spark, "language_id", [*taught, (90, None, "en"), (91, "12 34", "en"), (92, PROSE, None)])
    assert [r["doc_id"] for r in out] == [*range(8), 92] and out[-1]["lang"] == "en"


def test_near_duplicate_stage(spark):
    out = stage(spark, "ngram_jaccard_join", [(i, t, "en") for i, t in AWKWARD])
    # 6 stands for 7, 8, 11 and its own repetition; documents without words and rows without an id stay.
    assert [r["doc_id"] for r in out if r["doc_id"] is not None] == [1, 2, 3, 4, 5, 6, 9, 10, 12] and sum(r["doc_id"] is None for r in out) == 2


def test_repeat_stage(spark):
    out = {r["doc_id"]: r for r in stage(spark, "suffix_array_dedup", [(1, PROSE, "en"), (2, "Own. " + PROSE + "日本", "en"), (3, PROSE, "en"), (4, None, "en"), (5, "", "en")])}
    assert sorted(out) == [1, 2, 4, 5] and out[2]["text"] == "Own. 日本" and out[2]["n_chars"] == 7 and out[1]["text"] == PROSE


def test_secret_stage(spark):
    out = {r["doc_id"]: r for r in stage(spark, "secret_scan", [(1, "é password: hunter2222", "en"), (2, None, "en"), (3, "clean", "en")])}
    assert out[1]["text"] == "é [assign]" and out[1]["n_chars"] == 10 and out[2]["text"] is None and out[3]["text"] == "clean"


@needs_tables
def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    windows, docs = defaultdict(int), defaultdict(int)
    for r in rows:
        windows[r["sequence_id"]] += r["length"]
        docs[r["doc_id"]] += r["length"]
    assert max(windows.values()) <= 2048
    assert all(docs[r["doc_id"]] == r["doc_tokens"] for r in rows)
    assert 100 < len(docs) < spark.read.parquet(f"{SF}/documents.parquet").count()
