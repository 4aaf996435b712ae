"""From raw documents to packed token windows, in five stages.

Every stage takes the documents that its predecessor kept, as a written table,
and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from laneflow.llm import bpe, jaccard, language, packing, secrets, suffixes
from laneflow.llm.common import materialise, table

# The stages rest on a trained model, tokenizers and byte hashes, which SQL can't express.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known beyond doubt; texts without a letter go, and those between two languages.

    Learned from all documents with a language; a missing language is filled in.
    """
    found = language.identify(docs, language.train(docs, "text", "lang"), "text", ("__lang", "__score", "__ambiguous"))
    kept = found.where((F.col("__lang") != language.UNDETERMINED) & ~F.col("__ambiguous"))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates; rows without an id stay."""
    groups = jaccard.jaccard_components(docs, "doc_id", "text")
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 50 bytes that a document with a smaller id holds; documents of which nothing is left go."""
    cut = suffixes.remove_repeats(docs, "doc_id", "text", ("__removed", "__kept"), characters=True)
    changed = F.size("__removed") > 0
    kept = F.when(changed, F.decode("__kept", "UTF-8")).otherwise(F.col("text"))
    out = cut.where(~changed | (F.length("__kept") > 0)).withColumn("text", kept)
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by their kind in brackets; every document stays."""
    redacted = secrets.redact_secrets(docs, "text")
    return redacted.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of all documents in windows of 2048: one row per piece."""
    tokenizer = bpe.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_documents(docs.select("doc_id", "text"), "text", tokenizer, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("secret_scan", redact_secrets),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
