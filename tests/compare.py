"""Run queries next to their SQL and compare the rows.

``python tests/compare.py [sf] [name-prefix …]`` prints one line per query.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = os.environ.get("LANEFLOW_TESTDATA", "/root/testdata")


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{TESTDATA}/{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _text(value) -> str:
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(row[i]) for i in order) for row in rows)


def differences(spark, con, name: str, sf: str) -> tuple[str, int]:
    from laneflow.catalog import ORACLES, QUERIES

    frame = QUERIES[name](spark, f"{TESTDATA}/{sf}")
    got = frame.collect()
    if name not in ORACLES:
        return ("rows only" if got else "EMPTY"), len(got)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"COLUMNS {sorted(frame.columns)} != {sorted(names)}", len(got)
    left, right = rows_of(frame.columns, got), rows_of(names, want)
    if left == right:
        return "ok", len(got)
    a, b = set(left), set(right)
    only_got, only_want = sorted(a - b)[:2], sorted(b - a)[:2]
    return f"DIFF rows {len(left)} vs {len(right)}, {len(a - b)} / {len(b - a)} unmatched: {only_got} <> {only_want}", len(got)


def main() -> None:
    import functools

    from laneflow.catalog import QUERIES, registry
    from laneflow.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = build_session("compare", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.log.level": "ERROR",
        "spark.ui.showConsoleProgress": "false",
    })
    con = connect(sf)
    # One set of fixtures for the whole run: the feature table is built once.
    registry.Fixtures = functools.cache(registry.Fixtures)
    bad = 0
    for name in [n for n in QUERIES if n.startswith(prefixes)]:
        begin = time.monotonic()
        try:
            verdict, n = differences(spark, con, name, sf)
        except Exception as error:  # noqa: BLE001  (a report of all queries is wanted)
            verdict, n = f"ERROR {type(error).__name__}: {str(error)[:600]}", -1
        bad += verdict not in ("ok", "rows only")
        print(f"{name:40s} {time.monotonic() - begin:6.1f}s {n:8d}  {verdict}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
