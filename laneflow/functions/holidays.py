"""Major US holidays as a small date dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _observed(day: Column) -> Column:
    """Saturday holidays move to Friday, Sunday ones to Monday."""
    return (
        F.when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)
    )


def _nth(year: Column, month: int, day_name: str, n: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), day_name), (n - 1) * 7)


def _last(year: Column, month: int, day_name: str) -> Column:
    end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.next_day(F.date_sub(end, 7), day_name)


def us_holidays(spark: SparkSession, start: Column | str, end: Column | str) -> DataFrame:
    """Seven holidays between two dates (inclusive); one name per date, calendar order wins.

    ``start`` and ``end`` may be literals or scalar subqueries over the data.
    """
    low = F.to_date(F.lit(start)) if isinstance(start, str) else start
    high = F.to_date(F.lit(end)) if isinstance(end, str) else end
    years = spark.range(1).select(low.alias("low"), high.alias("high"))
    years = years.select("low", "high", F.explode(F.sequence(F.year("low"), F.year("high"))).alias("y"))
    y = F.col("y")

    def fixed(month: int, day: int) -> Column:
        return _observed(F.make_date(y, F.lit(month), F.lit(day)))

    named = [
        (fixed(1, 1), "New Year's Day"),
        (_nth(y, 1, "Mon", 3), "MLK Day"),
        (_last(y, 5, "Mon"), "Memorial Day"),
        (fixed(7, 4), "Independence Day"),
        (_nth(y, 9, "Mon", 1), "Labor Day"),
        (_nth(y, 11, "Thu", 4), "Thanksgiving"),
        (fixed(12, 25), "Christmas"),
    ]
    rows = F.array(*[
        F.struct(day.alias("date"), F.lit(name).alias("holiday"), (y * 10 + i).alias("rank"))
        for i, (day, name) in enumerate(named)
    ])
    exploded = years.select("low", "high", F.explode(rows).alias("h")).select("low", "high", "h.*")
    inside = exploded.where(F.col("date").between(F.col("low"), F.col("high")))
    return inside.groupBy("date").agg(F.min_by("holiday", "rank").alias("holiday"))
