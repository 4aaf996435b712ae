import hashlib

import pytest
from pyspark.sql import functions as F

import compare
from cases import AWKWARD, SF, documents, needs_tables
from laneflow.llm import exact, queries


def brute(rows, keep):
    groups = {}
    for id, text in rows:
        groups.setdefault(text or "", []).append(id)
    out, done = [], set()
    for id, text in rows:
        ids = groups[text or ""]
        known = [i for i in ids if i is not None]
        best = keep(known) if known else None
        first = id == best and (text or "") not in done
        done |= {text or ""} if first else set()
        out.append((id, best, len(ids), first))
    return sorted(out, key=repr)


def answer(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()), key=repr)


def weak(text):
    return F.md5((F.length(text) % 3).cast("string").cast("binary"))


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("digest", [exact.content_hash, weak])
def test_against_brute_force(spark, keep, digest):
    """Also with a hash that collides all the time: bytes decide."""
    rows = [*AWKWARD, *[(20 + i % 7, f"text {i % 5}") for i in range(60)], *[(100 + i, "copy") for i in range(50)]]
    found = exact.exact_duplicates(documents(spark, rows, clashes=True), "doc_id", "text", keep, digest=digest)
    assert answer(found) == brute(rows, min if keep == "smallest" else max)


def test_long_runs(spark, monkeypatch):
    monkeypatch.setattr(exact, "RUN", 4)
    rows = [(1, "same")] * 23 + [(2, "same")]
    assert answer(exact.exact_duplicates(documents(spark, rows), "doc_id", "text")) == brute(rows, min)


def test_kept_rows(spark):
    df = documents(spark, [*AWKWARD, (6, "another text of an id"), (5, None)], clashes=True)
    kept = exact.drop_exact_duplicates(df, "doc_id", "text")
    rows = kept.collect()
    texts = {r["text"] or "" for r in df.collect()}
    assert kept.columns == df.columns and len(rows) == len(texts) == len({r["text"] or "" for r in rows})
    assert {r["doc_id"] for r in rows if not r["text"]} == {1}


def test_empty_and_bad_arguments(spark):
    assert exact.exact_duplicates(documents(spark, []), "doc_id", "text").count() == 0
    assert exact.drop_exact_duplicates(documents(spark, []), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        exact.exact_duplicates(documents(spark), "doc_id", "text", "first")
    with pytest.raises(ValueError):
        exact.exact_duplicates(documents(spark), "doc_id", "text", derived={"kept": F.lit(1)})


def test_no_python_in_the_plan(spark, capsys):
    exact.exact_duplicates(documents(spark), "doc_id", "text").explain("formatted")
    plan = capsys.readouterr().out
    assert not any(node in plan for node in ("EvalPython", "MapIn", "FlatMap", "CartesianProduct", "BroadcastNestedLoop"))


@needs_tables
def test_query(spark):
    con = compare.connect("sf0.001")
    frame = queries.QUERIES["op11_exact_dedup"](spark, SF)
    result = con.execute(queries.ORACLES["op11_exact_dedup"])
    names = [d[0] for d in result.description]
    assert compare.rows_of(frame.columns, frame.collect()) == compare.rows_of(names, result.fetchall())
    one = frame.where("group_size = 1").first()
    text = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") == one["doc_id"]).first()["text"]
    assert one["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
