"""Small tables with every awkward row, and the standard tables where they exist."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not glob.glob(f"{SF}/documents.parquet"), reason="no test tables")
PROSE = "the quick brown fox jumps over the lazy dog and then sleeps under the old oak tree until the evening comes"
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, "é"), (6, PROSE), (6, PROSE), (7, PROSE), (8, PROSE + " again"),
    (None, PROSE), (None, None), (9, "日本語 " * 40), (10, "x" * 200_000), (11, PROSE.upper()), (12, "\x00\x1c a b"),
]
# Names that operators use inside, and of their results.
CLASHES = ("shard", "slot", "key", "cls", "n", "bucket", "block", "id", "vec", "sequence_id", "offset", "row_key", "start", "length", "payload", "secrets", "kept")


def documents(spark: SparkSession, rows: list | None = None, clashes: bool = False) -> DataFrame:
    rows = AWKWARD if rows is None else rows
    extra = CLASHES if clashes else ()
    schema = "doc_id bigint, text string" + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([(*r, *("?" for _ in extra)) for r in rows], schema)
