"""Scalar column library: time, calendar, speed, text and geometry expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from laneflow.schemas import POLYLINE, as_column

# Representable range of nanosecond timestamps, in epoch seconds; anything
# outside is an invalid date.
EPOCH_LIMIT_SECONDS = 9_223_372_036
_UNIT_SECONDS = {
    "s": 1, "sec": 1, "second": 1, "min": 60, "t": 60, "m": 60, "minute": 60, "h": 3600, "hour": 3600,
    "d": 86_400, "day": 86_400, "w": 604_800, "week": 604_800,
}


def interval_seconds(interval: str) -> int:
    """``'1h'``, ``'15min'``, ``'3 hours'`` … as seconds."""
    match = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+?)s?\s*", interval)
    if interval.strip().lower() in _UNIT_SECONDS:
        return _UNIT_SECONDS[interval.strip().lower()]
    if not match or match.group(2).lower() not in _UNIT_SECONDS:
        raise ValueError(f"unknown interval {interval!r}")
    return int(match.group(1) or 1) * _UNIT_SECONDS[match.group(2).lower()]


# --- time -----------------------------------------------------------------


def epoch_is_millis(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    """Per column, whether its median exceeds 1e12; one pass, one row to the driver.

    The median is compared without sorting: it lies above the threshold when
    more than half of the values do, and on an exact half the two middle values
    are the largest below and the smallest above.
    """
    threshold = 1e12
    parts = []
    for name in columns:
        value = F.col(name).cast("double")
        parts += [
            F.count_if(value > threshold).alias(f"above|{name}"), F.count(value).alias(f"total|{name}"),
            F.max(F.when(value <= threshold, value)).alias(f"low|{name}"), F.min(F.when(value > threshold, value)).alias(f"high|{name}"),
        ]
    row = df.agg(*parts).first()

    def decide(name: str) -> bool:
        above, total = row[f"above|{name}"], row[f"total|{name}"]
        if total and above * 2 == total:
            return (row[f"low|{name}"] + row[f"high|{name}"]) / 2 > threshold
        return above * 2 > total

    return {name: decide(name) for name in columns}


def epoch_to_timestamp(value: Column, is_millis: bool = False) -> Column:
    """Epoch seconds or milliseconds as a timestamp, NULL outside the nanosecond range."""
    unit = 1000 if is_millis else 1
    inside = value.between(-EPOCH_LIMIT_SECONDS * unit, EPOCH_LIMIT_SECONDS * unit)
    return F.when(inside, F.timestamp_micros((value * (1_000_000 // unit)).cast("bigint")))


def to_utc(df: DataFrame, columns: list[str]) -> DataFrame:
    """Epoch seconds or milliseconds, text, or naive timestamps to UTC timestamps; bad values become NULL."""
    kinds = dict(df.dtypes)
    numeric = [c for c in columns if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    millis = epoch_is_millis(df, numeric) if numeric else {}
    replaced = {}
    for name in columns:
        if name in numeric:
            value = F.col(name) if kinds[name] in ("float", "double") else F.col(name).cast("bigint")
            replaced[name] = epoch_to_timestamp(value, millis[name])
        elif kinds[name] == "string":
            replaced[name] = F.try_to_timestamp(F.col(name))
        else:
            replaced[name] = ensure_utc(name)
    return df.withColumns(replaced)


def ensure_utc(column: str | Column, source_tz: str = "UTC") -> Column:
    """Naive timestamps are read as ``source_tz`` wall clock; aware ones pass."""
    stamp = as_column(column).cast("timestamp")
    return stamp if source_tz == "UTC" else F.to_utc_timestamp(stamp, source_tz)


def iso_text_timestamp(column: str | Column) -> Column:
    """First 19 characters of an ISO-8601 text as a timestamp, NULL when malformed."""
    return F.try_to_timestamp(F.translate(F.substring(as_column(column), 1, 19), "T", " "))


def bin_number(column: str | Column, width_seconds: int) -> Column:
    """Index of the epoch-aligned bin that holds the instant."""
    micros = F.unix_micros(as_column(column))
    width = F.lit(width_seconds * 1_000_000).cast("bigint")
    return F.floor((micros - F.pmod(micros, width)) / width).cast("bigint")


def bin_start(number: str | Column, width_seconds: int) -> Column:
    return F.timestamp_seconds(as_column(number) * width_seconds)


def floor_time(column: str | Column, interval: str = "1h") -> Column:
    micros = F.unix_micros(as_column(column))
    width = F.lit(interval_seconds(interval) * 1_000_000).cast("bigint")
    return F.timestamp_micros(micros - F.pmod(micros, width))


def to_local_time(epoch: str | Column, hours: int = -7, out_of_range: str = "null") -> Column:
    """Epoch seconds to fixed-offset local wall clock.

    ``out_of_range='sentinel'`` maps unrepresentable values to the largest
    representable instant instead of NULL.
    """
    seconds = as_column(epoch)
    inside = seconds.between(-EPOCH_LIMIT_SECONDS, EPOCH_LIMIT_SECONDS)
    local = F.when(inside, F.timestamp_seconds(seconds + hours * 3600))
    if out_of_range == "sentinel":
        local = local.when(seconds.isNotNull(), sentinel_time(hours))
    return local


def sentinel_time(hours: int = -7) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH_LIMIT_SECONDS + hours * 3600))


# --- calendar -------------------------------------------------------------


def cyclic_features(column: str | Column = "time_bin") -> dict[str, Column]:
    stamp = as_column(column)
    hour, dow = F.hour(stamp), F.weekday(stamp)
    hour_of_week = dow * 24 + hour
    turn = F.lit(2.0) * F.pi()
    return {
        "hour_sin": F.sin(turn * hour / 24),
        "hour_cos": F.cos(turn * hour / 24),
        "dow_sin": F.sin(turn * dow / 7),
        "dow_cos": F.cos(turn * dow / 7),
        "hour_of_week": hour_of_week,
        "hour_of_week_sin": F.sin(turn * hour_of_week / 168),
        "hour_of_week_cos": F.cos(turn * hour_of_week / 168),
        "is_weekend": (dow >= 5).cast("int"),
    }


def calendar_features(column: str | Column = "hour") -> dict[str, Column]:
    stamp = as_column(column)
    week, year = F.weekofyear(stamp), F.extract(F.lit("YEAROFWEEK"), stamp)
    return {
        "date": F.to_date(stamp),
        "month": F.month(stamp),
        "month_name": F.date_format(stamp, "MMMM"),
        "day": F.dayofmonth(stamp),
        "day_of_week": F.date_format(stamp, "EEEE"),
        "hour_of_day": F.hour(stamp),
        "week": week,
        "year": year,
        "year_week": F.concat(year.cast("string"), F.lit("-"), F.lpad(week.cast("string"), 2, "0")),
    }


def season(month: str | Column = "month") -> Column:
    m = as_column(month)
    return (
        F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring")
        .when(m.isin(6, 7, 8), "Summer").when(m.isin(9, 10, 11), "Fall")
    )


def rush_flags(hour: str | Column = "hour_of_day", day_name: str | Column = "day_of_week") -> dict[str, Column]:
    h = as_column(hour)
    morning, evening = h.between(7, 9), h.between(16, 18)
    return {
        "is_morning_rush": morning,
        "is_evening_rush": evening,
        "is_peak": morning | evening,
        "is_weekend": as_column(day_name).isin("Saturday", "Sunday"),
    }


def iso_week_label(year_week: str | Column) -> Column:
    """``'2024-39'`` → ``'Week 39 (Sep 23 - Sep 29, 2024)'``; malformed labels fall back to ``'Week <label>'``."""
    text = as_column(year_week)
    year = F.try_element_at(F.split(text, "-"), F.lit(1)).try_cast("int")
    week = F.try_element_at(F.split(text, "-"), F.lit(2)).try_cast("int")
    # 4 January always falls in ISO week 1.
    monday = F.date_add(F.to_date(F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4)))), (week - 1) * 7)
    sunday = F.date_add(monday, 6)
    valid = F.size(F.split(text, "-")).eqNullSafe(2) & week.between(1, 53)
    valid = valid & F.extract(F.lit("YEAROFWEEK"), monday).eqNullSafe(year)
    label = F.concat(
        F.lit("Week "), week.cast("string"), F.lit(" ("), F.date_format(monday, "MMM dd"), F.lit(" - "),
        F.date_format(sunday, "MMM dd, yyyy"), F.lit(")"),
    )
    return F.when(F.coalesce(valid, F.lit(False)), label).otherwise(F.concat(F.lit("Week "), text))


def hour_label_12h(hour: str | Column) -> Column:
    h = as_column(hour)
    twelve = F.when(h % 12 == 0, 12).otherwise(h % 12)
    return F.concat(twelve.cast("string"), F.when(h < 12, " AM").otherwise(" PM"))


# --- targets, speeds, flows ----------------------------------------------


def per_mile(lags: tuple[int, ...] = (1, 2, 3)) -> dict[str, Column]:
    miles = F.col("miles")
    out = {"tt_per_mile": F.try_divide(F.col("travel_time_seconds"), miles)}
    out.update({f"lag{k}_tt_per_mile": F.try_divide(F.col(f"lag{k}"), miles) for k in lags})
    return out


def speed_ratio() -> Column:
    return F.try_divide(F.col("speed"), F.col("reference_speed"))


def log_features(df: DataFrame, kind: str = "eps") -> DataFrame:
    """Log of the per-mile target and its lags, only where not there already.

    ``kind='eps'`` is ``ln(x + 1e-6)``; ``kind='log1p'`` is ``ln(1 + x)``.
    """
    bases = ["tt_per_mile", "lag1_tt_per_mile", "lag2_tt_per_mile", "lag3_tt_per_mile"]
    new = {}
    for base in bases:
        if base in df.columns and f"log_{base}" not in df.columns:
            value = F.col(base).cast("double")
            new[f"log_{base}"] = F.log1p(value) if kind == "log1p" else F.ln(value + F.lit(1e-6))
    return df.withColumns(new) if new else df


def clip_log(value: str | Column, floor: float = 1e-8) -> Column:
    return F.when(as_column(value).isNotNull(), F.ln(F.greatest(as_column(value), F.lit(floor))))


def speed_band(speed: str | Column, variant: str = "strict") -> Column:
    """Right-closed bands.

    ``strict``: (0, 100], NULL outside.  ``open``: [0, 1000] with 0 included.
    ``default``: everything at or below 20, NULL too, is ``0-20``; no top edge.
    """
    s = as_column(speed)
    if variant == "default":
        return (
            F.when(s > 60, "60+").when(s > 50, "50-60").when(s > 40, "40-50").when(s > 30, "30-40")
            .when(s > 20, "20-30").otherwise("0-20")
        )
    if variant not in ("strict", "open"):
        raise ValueError(f"unknown speed band variant {variant!r}")
    low = s >= 0 if variant == "open" else s > 0
    top = 1000 if variant == "open" else 100
    return (
        F.when(low & (s <= 20), "0-20").when((s > 20) & (s <= 30), "20-30").when((s > 30) & (s <= 40), "30-40")
        .when((s > 40) & (s <= 50), "40-50").when((s > 50) & (s <= 60), "50-60").when((s > 60) & (s <= top), "60+")
    )


def flow_ratio(current: str | Column, free_flow: str | Column) -> Column:
    cur, free = as_column(current), as_column(free_flow)
    return F.when(free > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(cur, free)))).otherwise(0.5)


def flow_tier(current: str | Column, free_flow: str | Column) -> Column:
    ratio = flow_ratio(current, free_flow)
    return (
        F.when(ratio > 0.9, "excellent").when(ratio > 0.7, "good").when(ratio > 0.5, "moderate")
        .when(ratio > 0.3, "slow").otherwise("stopped")
    )


def speed_class(speed: str | Column) -> Column:
    s = as_column(speed)
    return F.when(s < 35, "congested").when(s < 50, "critical").otherwise("free-flow")


# --- events ---------------------------------------------------------------


def event_minutes() -> Column:
    """Duration in minutes by event type over epoch-second columns, else NULL."""
    kind = F.col("EventType")
    return (
        F.when(kind.isin("closures", "roadwork"), (F.col("PlannedEndDate") - F.col("StartDate")) / 60.0)
        .when(kind == "accidentsAndIncidents", (F.col("LastUpdated") - F.col("Reported")) / 60.0)
    )


def duration_days(start: str | Column, end: str | Column, cap: float | None = None) -> Column:
    days = (F.unix_micros(as_column(end)) - F.unix_micros(as_column(start))) / F.lit(86_400_000_000.0)
    return days if cap is None else F.when(days > cap, F.lit(float(cap))).otherwise(days)


def event_label(planned: str | Column = "plnd_evt", unplanned: str | Column = "un_plnd_evt") -> Column:
    return F.when(as_column(planned) == 1, "planned").when(as_column(unplanned) == 1, "unplanned").otherwise("none")


def evt_total(columns: list[str]) -> Column:
    total = F.coalesce(F.col(columns[0]), F.lit(0))
    for name in columns[1:]:
        total = total + F.coalesce(F.col(name), F.lit(0))
    return total


# --- geometry and text ----------------------------------------------------


def point_segment_distance(
    px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column
) -> dict[str, Column]:
    """Distance, projection and position ``t`` in [0, 1] of a point on a segment (planar)."""
    vx, vy = bx - ax, by - ay
    length2 = vx * vx + vy * vy
    t = F.try_divide((px - ax) * vx + (py - ay) * vy, length2)
    # least/greatest skip NULLs, so an unknown t is kept apart.
    t = F.when(length2 == 0, 0.0).when(t.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))
    proj_x, proj_y = ax + t * vx, ay + t * vy
    return {
        "distance": F.sqrt((px - proj_x) * (px - proj_x) + (py - proj_y) * (py - proj_y)),
        "proj_x": proj_x,
        "proj_y": proj_y,
        "t": t,
    }


def parse_polyline(text: str | Column) -> Column:
    """Points of a JSON polyline; NULL below two points, every third point above ten."""
    points = F.from_json(as_column(text), POLYLINE)
    thinned = F.filter(points, lambda _, i: i % 3 == 0)
    return F.when(F.size(points) > 10, thinned).when(F.size(points) >= 2, points)


def describe_flow() -> dict[str, Column]:
    frc, confidence = F.col("frc"), F.col("confidence")
    return {
        "Description": F.format_string(
            "Traffic Flow (%s) - Speed: %.1f/%.1f mph", frc, F.col("currentSpeed"), F.col("freeFlowSpeed")
        ),
        "RoadwayName": F.coalesce(F.concat(frc, F.lit(" Road")), F.lit("Unknown Road")),
        "Severity": F.when(confidence.isNotNull(), F.format_string("Confidence: %.2f", confidence)).otherwise("N/A"),
    }


def text_preview(text: str | Column, length: int = 80) -> Column:
    return F.substring(F.coalesce(as_column(text), F.lit("")), 1, length)


def segment_midpoint() -> dict[str, Column]:
    return {
        "lat": (F.col("start_latitude") + F.col("end_latitude")) / 2.0,
        "lon": (F.col("start_longitude") + F.col("end_longitude")) / 2.0,
    }


def segment_label(speed: str | Column = "speed_mean") -> Column:
    rounded = F.bround(as_column(speed), 1).cast("string")
    return F.concat(F.concat_ws(" ", F.col("road"), F.col("direction")), F.lit(" - "), rounded, F.lit(" mph"))
