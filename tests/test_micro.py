"""Hand-checked small tables and edge cases."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from laneflow import schemas
from laneflow.functions import columns as C
from laneflow.functions.fixed_values import EVENT_CATEGORIES, IMPACT_CLASSES, PLANNED_CLASSES, SEGMENT_ORDER, SEGMENT_TAG_ROWS
from laneflow.functions.holidays import us_holidays
from laneflow.operators import aggregates, filters, grid, intervals, quadtree, ranking, sampling, spatial, stats, topk, windows
from laneflow.operators.ordering import POS, with_position


def stamp(text):
    return dt.datetime.fromisoformat(text)


def hours(n, start="2024-01-01"):
    return [stamp(start) + dt.timedelta(hours=i) for i in range(n)]


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, t, v) for t, v in zip(hours(len(values)), values)], "tmc_code string, time_bin timestamp, v double")


def column(df, name, order="time_bin"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("block", [2, 4, 4096])
def test_interpolation(spark, block):
    df = with_position(series(spark, [None, 10.0, None, None, 40.0, None]), "time_bin", ["tmc_code"])
    assert column(grid.interpolate_linear(df, ["v"], block_rows=block), "v") == [10, 10, 20, 30, 40, 40]


def test_interpolation_matches_pandas(spark):
    rng = np.random.default_rng(5)
    values = [None if rng.random() < 0.6 else float(rng.integers(0, 100)) for _ in range(200)]
    df = with_position(series(spark, values), "time_bin", ["tmc_code"])
    want = pd.Series(values, dtype=float).interpolate(method="linear", limit_direction="both").tolist()
    assert column(grid.interpolate_linear(df, ["v"], block_rows=7), "v") == pytest.approx(want)


def test_all_missing_stays_missing(spark):
    df = with_position(series(spark, [None, None, None]), "time_bin", ["tmc_code"])
    assert column(grid.interpolate_linear(df, ["v"]), "v") == [None] * 3


def overlap(spark, events, bins=("2024-01-01 10:00:00",)):
    cells = spark.createDataFrame([("a", stamp(b)) for b in bins], "tmc_code string, time_bin timestamp")
    rows = [("a", stamp(s), stamp(e), c) for s, e, c in events]
    table = spark.createDataFrame(rows, "near_tmc string, event_start timestamp, event_end timestamp, cat_event_type string")
    return intervals.interval_overlap_counts(cells, table)


@pytest.mark.parametrize("start,end,count", [
    ("10:00:00", "10:00:00", 0), ("10:30:00", "10:30:00", 1), ("09:30:00", "10:00:00", 0), ("10:59:00", "12:00:00", 1),
])
def test_overlap_edges(spark, start, end, count):
    got = overlap(spark, [(f"2024-01-01 {start}", f"2024-01-01 {end}", "cat_planned")]).first()
    assert (got["evt_cat_planned"], got["evt_cat_unplanned"]) == (count, 0)


def test_overlap_open_ended_and_unknown_category(spark):
    got = overlap(spark, [("2020-01-01 00:00:00", "2262-01-01 00:00:00", "cat_planned"), ("2024-01-01 09:00:00", "2024-01-01 11:00:00", "x")])
    assert got.first().asDict() | {"time_bin": 0} == {"tmc_code": "a", "time_bin": 0, "evt_cat_planned": 1, "evt_cat_unplanned": 1}


def test_event_window_rules(spark):
    t = [stamp(f"2024-01-01 0{i}:00:00") for i in range(4)]
    rows = [(" Closures ", *t), ("roadwork", t[0], t[1], t[2], None), ("accidentsAndIncidents", *t), ("specialEvents", *t)]
    df = spark.createDataFrame(rows, "EventType string, Reported timestamp, LastUpdated timestamp, StartDate timestamp, PlannedEndDate timestamp")
    got = {r["EventType"].strip(): (r["event_start"].hour, r["event_end"].hour) for r in intervals.event_window_rules(df).collect()}
    assert got == {"Closures": (2, 3), "roadwork": (2, 2), "accidentsAndIncidents": (0, 1)}


SEGMENT = "tmc string, direction string, start_latitude double, start_longitude double, end_latitude double, end_longitude double"
EVENT = "ID int, Latitude double, Longitude double, DirectionOfTravel string"


def brute_nearest(events, segments):
    lat0 = np.mean([e[1] for e in events if e[1] is not None])
    k = 111_320.0 * np.cos(np.radians(lat0))
    names = {"east": "EASTBOUND", "west": "WESTBOUND", "north": "NORTHBOUND", "south": "SOUTHBOUND"}
    out = {}
    for i, la, lo, d in events:
        if la is None:
            out[i] = None
            continue
        wanted = names.get(d.lower())
        pool = [s for s in segments if wanted and wanted in s[1]] or segments
        best = None
        for s in sorted(pool):
            ax, ay, bx, by = s[3] * k, s[2] * 110_540.0, s[5] * k, s[4] * 110_540.0
            vx, vy = bx - ax, by - ay
            n = vx * vx + vy * vy or 1e-12
            t = min(1.0, max(0.0, ((lo * k - ax) * vx + (la * 110_540.0 - ay) * vy) / n))
            d2 = (lo * k - ax - t * vx) ** 2 + (la * 110_540.0 - ay - t * vy) ** 2
            if best is None or d2 < best[0] - 1e-6:
                best = (d2, s[0])
        out[i] = best[1]
    return out


@pytest.mark.parametrize("seed,length,spread", [(1, 0.002, 0.1), (2, 0.3, 0.3), (3, 0.0, 0.2), (4, 0.01, 5.0)])
@pytest.mark.parametrize("outliers", [False, True])
def test_nearest_segment_against_brute_force(spark, seed, length, spread, outliers):
    rng = random.Random(seed)
    directions = ["EASTBOUND", "WESTBOUND", "NORTHBOUND"]
    segments = []
    for i in range(60):
        la, lo = 33 + rng.uniform(0, spread), -112 + rng.uniform(0, spread)
        segments.append((f"s{i:02d}", rng.choice(directions), la, lo, la + rng.uniform(-length, length), lo + rng.uniform(-length, length)))
    events = [(i, 33 + rng.uniform(-spread, 2 * spread), -112 + rng.uniform(-spread, 2 * spread), rng.choice(["east", "West", "south", "unknown"]))
              for i in range(80)]
    # A hot point, and one without coordinates.
    events += [(100 + i, 33.01, -111.99, "east") for i in range(30)] + [(999, None, -112.0, "east")]
    if outliers:  # one end, and one event, at a default coordinate
        segments.append(("far", "EASTBOUND", 33.05, -112.0, 0.0, 0.0))
        events.append((998, 0.0, 0.0, "east"))
    got = spatial.nearest_segment_join(spark.createDataFrame(events, EVENT), spark.createDataFrame(segments, SEGMENT))
    assert {r["ID"]: r["near_tmc"] for r in got.collect()} == brute_nearest(events, segments)


def test_many_leaves_against_brute_force(spark, monkeypatch):
    """Small leaves, from a sample of a tenth: the shape of the tree does not change the answer."""
    monkeypatch.setattr(quadtree, "CAPACITY", 2)
    monkeypatch.setattr(spatial, "TREE_SAMPLE", 30)
    rng = random.Random(12)
    place = lambda: (33 + rng.gauss(0, 0.1), -112 + rng.gauss(0, 0.1))
    segments = [(f"s{i:03d}", rng.choice(["EASTBOUND", "WESTBOUND"]), *place(), *place()) for i in range(150)]
    segments += [(f"t{i:03d}", "EASTBOUND", la, lo, la + 0.001, lo) for i, (la, lo) in enumerate(place() for _ in range(150))]
    events = [(i, *place(), rng.choice(["east", "west", "north"])) for i in range(300)]
    got = spatial.nearest_segment_join(spark.createDataFrame(events, EVENT), spark.createDataFrame(segments, SEGMENT))
    assert {r["ID"]: r["near_tmc"] for r in got.collect()} == brute_nearest(events, segments)


def compared_pairs(segments, points):
    """Pairs that a search would compare: a point's first leaf, and the leaves nearer than what it finds there."""
    extent = (segments[:, ::2].min(), segments[:, 1::2].min(), segments[:, ::2].max(), segments[:, 1::2].max())
    tree = quadtree.QuadTree.grown(extent, segments)
    owner, leaves = tree.crossed(segments)
    tree.fill(np.unique(leaves))
    sizes = np.bincount(leaves, minlength=len(tree.child))
    home = tree.home(points)
    bound = np.empty(len(points))
    for i, (px, py) in enumerate(points):
        ax, ay, bx, by = segments[owner[leaves == home[i]]].T
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = np.clip(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / np.where(n == 0, 1e-12, n), 0, 1)
        bound[i] = ((px - ax - t * (bx - ax)) ** 2 + (py - ay - t * (by - ay)) ** 2).min()
    rows, near = tree.within(points, bound, home)
    assert len(set(zip(rows, near))) == len(rows)
    return np.bincount(rows, sizes[near], len(points)), len(leaves)


def test_one_bad_coordinate_does_not_pair_everything():
    """Compared pairs grow with the events, not with events x segments."""
    rng = np.random.default_rng(9)
    at = rng.uniform(0, 100_000, (3000, 2))
    segments = np.vstack([np.hstack([at, at + 200]), [[0, 0, 1e7, -4e6]]])
    pairs, registered = compared_pairs(segments, rng.uniform(0, 100_000, (400, 2)))
    assert pairs.mean() < 60 and registered < 12 * len(segments)


def test_crowded_and_empty_areas():
    """One dense town, one far-off road, points in both, between them and outside of all."""
    rng = np.random.default_rng(4)
    town = rng.uniform(0, 2_000, (4000, 2))
    segments = np.vstack([np.hstack([town, town + rng.uniform(-50, 50, town.shape)]), [[400_000, 300_000, 400_500, 300_000]]])
    inside, empty = rng.uniform(0, 2_000, (200, 2)), rng.uniform(3_000, 390_000, (100, 2))
    outside = rng.uniform(-900_000, -100_000, (100, 2))
    for points in (inside, empty, outside):
        pairs, _ = compared_pairs(segments, points)
        assert pairs.mean() < 150 and pairs.max() < 1000


def test_tree_is_bounded(monkeypatch):
    """Segments on top of each other, as often as one likes, and a tree out of leaves."""
    monkeypatch.setattr(quadtree, "MAX_LEAVES", 64)
    segments = np.tile([[0.0, 0.0, 1.0, 1.0]], (500, 1))
    tree = quadtree.QuadTree.grown((0.0, 0.0, 1.0, 1.0), segments)
    assert (tree.child < 0).sum() <= 64
    assert set(tree.crossed(segments)[0]) == set(range(500))


def test_nearest_tie_and_degenerate(spark):
    twins = [("b", "EASTBOUND", 33.0, -112.0, 33.0, -111.9), ("a", "EASTBOUND", 33.0, -112.0, 33.0, -111.9)]
    event = spark.createDataFrame([(1, 33.01, -111.95, "east")], EVENT)
    assert spatial.nearest_segment_join(event, spark.createDataFrame(twins, SEGMENT)).first()["near_tmc"] == "a"
    point = spark.createDataFrame([("p", "EASTBOUND", 33.0, -111.95, 33.0, -111.95)], SEGMENT)
    assert spatial.nearest_segment_join(event, point).first()["near_distance"] == pytest.approx(0.01 * 110_540.0)
    assert spatial.nearest_segment_join(event, point.limit(0)).first()["near_tmc"] is None


def test_point_segment_distance(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0, 0.0, 2.0, 0.0), (3.0, 4.0, 0.0, 0.0, 0.0, 0.0)], "px double, py double, ax double, ay double, bx double, by double")
    got = [(r["distance"], r["t"]) for r in spatial.with_projection(df).collect()]
    assert got == [(1.0, 0.5), (5.0, 0.0)]


def test_infer_direction(spark):
    rows = [("I-10 West", "Unknown"), ("I-10", "unknown"), ("I-10 North", "east"), (None, "Unknown")]
    df = filters.infer_direction(spark.createDataFrame(rows, "RoadwayName string, DirectionOfTravel string"))
    assert [r[1] for r in df.collect()] == ["west", "unknown", "east", "unknown"]


def test_latest_per_key(spark):
    rows = [("a", None, 1), ("a", stamp("2024-01-01"), 2), ("a", stamp("2025-01-01"), 3), ("b", None, 4)]
    df = windows.latest_per_key(spark.createDataFrame(rows, "k string, d timestamp, n int"), "k", "d")
    assert {r["k"]: r["n"] for r in df.collect()} == {"a": 3, "b": 4}


@pytest.mark.parametrize("block", [3, 4096])
def test_buffer_mask(spark, block):
    df = series(spark, [0.0, 0.0, 1.0] + [0.0] * 7)
    assert column(windows.buffer_mask(df, F.col("v") > 0, 3, "near", block_rows=block), "near") == [True] * 6 + [False] * 4


def test_splits(spark):
    df = series(spark, [float(i) for i in range(10)])
    assert column(windows.chronological_split(df, 0.2), "split") == ["train"] * 8 + ["test"] * 2
    assert column(windows.chronological_split_per_key(df, 0.05), "split") == ["train"] * 9 + ["test"]


def test_sequences(spark):
    rows = windows.sliding_sequences(series(spark, [1.0, 2.0, 3.0, 4.0, 5.0]), ["v"], "v", 3, 1, block_rows=1).orderBy("time_bin").collect()
    assert [(r["y"], [s[0] for s in r["x"]]) for r in rows] == [(4.0, [1.0, 2.0, 3.0]), (5.0, [2.0, 3.0, 4.0])]


def test_circular_shift(spark):
    got = windows.shift_circular(series(spark, [1.0, 0.0, 0.0, 0.0]), "v", [1, -1]).orderBy("lag", "time_bin").collect()
    assert [r["shifted"] for r in got] == [0, 0, 0, 1, 0, 1, 0, 0]


@pytest.mark.parametrize("block", [1, 5, 4096])
def test_lags_match_plain_window_on_a_hot_key(spark, block):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 50}", stamp("2024-01-01") + dt.timedelta(minutes=17 * i), rng.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "tmc_code string, time_bin timestamp, v double")
    got = windows.add_lags(df, "v", (1, 4), block_rows=block, drop_missing=False)
    frame = pd.DataFrame(rows, columns=["k", "t", "v"]).sort_values(["k", "t"])
    frame["l1"], frame["l4"] = frame.groupby("k")["v"].shift(1), frame.groupby("k")["v"].shift(4)
    want = {(r.k, r.t): (r.l1, r.l4) for r in frame.itertuples()}
    for r in got.collect():
        a, b = want[(r["tmc_code"], r["time_bin"])]
        assert (r["lag1"] is None and np.isnan(a) or r["lag1"] == a) and (r["lag4"] is None and np.isnan(b) or r["lag4"] == b)


def test_speed_bands(spark):
    df = spark.createDataFrame([(0.0,), (20.0,), (20.1,), (60.0,), (101.0,)], "s double")
    got = [tuple(r) for r in df.select(*[C.speed_band("s", v) for v in ("strict", "open", "default")]).collect()]
    assert [g[0] for g in got] == [None, "0-20", "20-30", "50-60", None]
    assert [g[1] for g in got] == ["0-20", "0-20", "20-30", "50-60", "60+"]
    assert [g[2] for g in got] == ["0-20", "0-20", "20-30", "50-60", "60+"]


def test_holidays(spark):
    days = {str(r["date"]): r["holiday"] for r in us_holidays(spark, "2021-01-01", "2021-12-31").collect()}
    assert days["2021-07-05"] == "Independence Day" and days["2021-12-24"] == "Christmas" and days["2021-11-25"] == "Thanksgiving"
    assert days["2021-05-31"] == "Memorial Day" and len(days) == 7
    # 1 January 2022 is a Saturday: observed the day before, and only known once 2022 is in range.
    assert [str(r["date"]) for r in us_holidays(spark, "2021-12-31", "2022-01-02").collect()] == ["2021-12-31"]


def test_iso_week(spark):
    df = spark.createDataFrame([(stamp("2024-12-30"),)], "t timestamp").select(*[e.alias(n) for n, e in C.calendar_features("t").items()])
    assert (df.first()["year"], df.first()["week"], df.first()["year_week"]) == (2025, 1, "2025-01")
    labels = spark.createDataFrame([("2024-39",), ("2024-60",), ("junk",)], "y string").select(C.iso_week_label("y"))
    assert [r[0] for r in labels.collect()] == ["Week 39 (Sep 23 - Sep 29, 2024)", "Week 2024-60", "Week junk"]


def test_two_planned_events_are_none_but_with_event(spark):
    rows = [(2, 0, 1.0), (0, 0, 2.0), (1, 0, 4.0)]
    df = spark.createDataFrame(rows, "plnd_evt int, un_plnd_evt int, diff double").withColumns({"hour": F.lit(0), "label": C.event_label()})
    assert [r["label"] for r in df.orderBy("diff").collect()] == ["none", "none", "planned"]
    assert aggregates.extra_delay_profile(df, ["hour"]).first()["no_event"] == 2.0
    assert aggregates.spatial_event_rate(df.withColumn("tmc_code", F.lit("a"))).first()["n_events"] == 1
    assert aggregates.spatial_event_rate(df.withColumn("tmc_code", F.lit("a")), "any").first()["n_events"] == 2


@pytest.mark.parametrize("scale,unit", [(1, "s"), (1000, "ms")])
def test_epoch_unit(spark, scale, unit):
    good = 1_700_000_000
    df = spark.createDataFrame([(good * scale,), (None,), (10**14 * scale,), (good * scale,), (good * scale,)], "t long")
    got = [r["t"] for r in C.to_utc(df, ["t"]).collect()]
    when = dt.datetime.fromtimestamp(good, dt.UTC).replace(tzinfo=None)
    assert got == [when, None, None, when, when]


def test_text_times(spark):
    df = spark.createDataFrame([("2024-05-01 10:00:00",), ("nope",)], "t string")
    assert [r["t"] for r in C.to_utc(df, ["t"]).collect()] == [stamp("2024-05-01 10:00:00"), None]


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.normal(size=3000).round(2)] + [("cold", float(v)) for v in rng.normal(size=7)] + [("cold", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["a"], r["b"]) for r in ranking.grouped_quantiles(df, ["k"], "v", {"a": 0.01, "b": 0.75}).collect()}
    for k in ("hot", "cold"):
        values = [v for n, v in rows if n == k and v is not None]
        assert got[k] == pytest.approx(tuple(np.quantile(values, [0.01, 0.75])))


def test_average_rank_matches_pandas(spark):
    values = [3.0, 1.0, 3.0, 2.0, 3.0, 1.0]
    df = ranking.average_rank(spark.createDataFrame([(v,) for v in values], "v double"), "v", "r")
    want = dict(zip(values, pd.Series(values).rank()))
    assert all(r["r"] == want[r["v"]] for r in df.collect())


def test_welch_p_value(spark):
    p = spark.createDataFrame([(2.228139, 10.0), (0.0, 5.0), (-1.959964, 1e7)], "t double, d double").select(stats.t_two_sided_p("t", "d"))
    assert [r[0] for r in p.collect()] == pytest.approx([0.05, 1.0, 0.05], abs=1e-5)


def test_partial_autocorrelation_of_an_ar1(spark):
    acf = spark.createDataFrame([(k, 0.6**k) for k in range(6)], "lag int, acf double")
    got = [r["pacf"] for r in stats.partial_autocorrelation(acf).orderBy("lag").collect()]
    assert got == pytest.approx([1.0, 0.6, 0, 0, 0, 0], abs=1e-9)


def test_sampling_keeps_everything_outside_the_open_interval(spark):
    df = spark.range(1000).withColumn("evt_total", (F.col("id") % 100 == 0).cast("int"))
    assert sampling.balance_by_event(df, ["id"], fraction=0).count() == 1000
    assert sampling.balance_by_event(df, ["id"], "absent").count() == 1000
    kept = sampling.balance_by_event(df, ["id"], fraction=0.1)
    assert kept.where("evt_total > 0").count() == 10 and 60 < kept.count() < 160
    assert sampling.sample_rows(df, 30, ["id"]).count() == 30


def test_grid_is_observed_or_regular(spark):
    rows = [("a", t, 1.0) for t in hours(5) if t.hour != 2] + [("b", hours(5)[0], 1.0)]
    df = spark.createDataFrame(rows, "tmc_code string, time_bin timestamp, v double")
    assert grid.densify_grid(df).count() == 8 and grid.densify_grid(df, grid="regular").count() == 10
    dense = grid.densify_grid(df).drop(POS)
    assert grid.densify_grid(dense).count() == 8


def test_schema_helpers(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1)], "tmc string, n int")
    assert set(schemas.SEGMENTS.fieldNames()) <= set(schemas.with_optional_columns(df, schemas.SEGMENTS).columns)
    assert schemas.duplicate_keys(df, ["tmc"]).count() == 1
    with pytest.raises(ValueError):
        schemas.require_columns(df, ["missing"])


def test_fixed_tables():
    assert set(PLANNED_CLASSES.values()) == set(EVENT_CATEGORIES) and IMPACT_CLASSES["patching"] == "cat_closure"
    assert len(SEGMENT_TAG_ROWS) == 50 and [len(SEGMENT_ORDER[d]) for d in ("WB", "EB")] == [25, 25]
    # Sums of every column by direction, and single rows that are easy to get wrong.
    sums = [tuple(sum(row[i] for row in rows) for i in (1, 2, 3)) for rows in (SEGMENT_TAG_ROWS[:25], SEGMENT_TAG_ROWS[25:])]
    assert sums == [(12, 13, 9), (15, 12, 7)]
    assert {row[0]: row[1:] for row in SEGMENT_TAG_ROWS}["115-04183"] == (0, 0, 1)


def test_chain_needs_two_nodes(spark):
    df = spark.createDataFrame([("E", 1.0, "a")], "d string, x double, tmc string")
    with pytest.raises(ValueError):
        windows.chain_edges(df, "d", "x", "tmc")


def test_priority_limit(spark):
    df = spark.createDataFrame([(i, "FRC5" if i % 2 else None, i) for i in range(1500)], "id int, frc string, timestamp int")
    assert topk.priority_sort_limit(df, ["FRC5"], local_limit=1000).count() == 1000 and topk.priority_sort_limit(df, ["FRC5"]).count() == 1500
    assert topk.priority_sort_limit(df, ["FRC0"]).count() == 1500
    assert topk.priority_sort_limit(df, ["FRC0"], 5).first()["id"] == 1499


def test_intermediate_tables_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from laneflow.session import shared_dir

    def session(master, conf, default_fs="file:///"):
        hadoop = SimpleNamespace(get=lambda key, default=None: default_fs)
        context = SimpleNamespace(master=master, _jsc=SimpleNamespace(hadoopConfiguration=lambda: hadoop))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)), sparkContext=context)

    own = {"spark.sql.warehouse.dir": "file:/home/me/spark-warehouse"}
    assert shared_dir(session("local[8]", own), "t").startswith("file:/home/me/spark-warehouse/_intermediate/t-")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master, own), "t")
        assert shared_dir(session(master, own | {"spark.checkpoint.dir": "hdfs://n/c"}), "t").startswith("hdfs://n/c/t-")
        assert shared_dir(session(master, {"spark.sql.warehouse.dir": "s3a://b/w"}), "t").startswith("s3a://b/w/_intermediate/t-")
