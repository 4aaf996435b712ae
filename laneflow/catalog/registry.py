"""Registration of queries and composition of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from laneflow.catalog.fixtures import Fixtures, with_clause

# Added before rounding on both sides, so that exact decimal ties (x.xxxxxx5) round alike.
TIE_SHIFT = 1.3e-9

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def presentable(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, no negative zero; timestamps as plain wall clock."""
    columns = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.round(value.cast("double") + F.lit(TIE_SHIFT), 6) + F.lit(0.0)
        elif isinstance(field.dataType, T.TimestampType):
            value = value.cast("timestamp_ntz")
        columns.append(value.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None, uses: str = "", doubles: str = ""):
    """Register ``fn(fixtures) -> DataFrame`` as a query.

    ``sql`` is the body of the oracle, ``uses`` the fixture tables it reads, and
    ``doubles`` the columns rounded as in :func:`presentable`.
    """

    def register(fn: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return presentable(fn(Fixtures(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            rounded = ", ".join(f"round(CAST({c} AS DOUBLE) + CAST({TIE_SHIFT} AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS {c}" for c in doubles.split())
            replace = f" REPLACE ({rounded})" if rounded else ""
            ORACLES[name] = f"{with_clause(uses.split())}SELECT *{replace} FROM ({sql.strip()}) AS answer"
        return fn

    return register
