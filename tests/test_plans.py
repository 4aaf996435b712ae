"""Physical plans, sinks, streams and models."""

import datetime as dt
import glob
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from laneflow.models import estimators as E, evaluation as V
from laneflow.operators import aggregates, filters, forecast, grid, intervals, stats, topk, windows
from laneflow.operators.ordering import BLOCK
from laneflow.plans.feature_table import build_feature_table
from laneflow.sources import readers, writers
from laneflow.streaming import feeds


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def binned(spark):
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"s{k}", start + dt.timedelta(hours=h), rng.random() * 80, 5 + rng.random() * 60, 60.0) for k in range(4) for h in range(300) if rng.random() < 0.4]
    return spark.createDataFrame(rows, "tmc_code string, time_bin timestamp, speed double, travel_time_seconds double, reference_speed double")


@pytest.fixture(scope="module")
def raw(spark):
    rng = random.Random(11)
    start = 1_704_067_200
    events = []
    for i in range(200):
        s = start + rng.randrange(0, 300 * 3600)
        kind = rng.choice(["roadwork", "closures", "accidentsAndIncidents", "specialEvents"])
        events.append((str(i), f"I-10 {rng.choice(['West', 'East'])}", "Unknown", kind, rng.choice(["patching", "crashHOV", None]), s, s + 1800, s,
                       s + rng.choice([0, 7200, 10**11]), 33.3 + rng.random() * 0.1, -112.0 + rng.random() * 0.05))
    names = "ID string, RoadwayName string, DirectionOfTravel string, EventType string, EventSubType string, Reported long, LastUpdated long, " \
            "StartDate long, PlannedEndDate long, Latitude double, Longitude double"
    segments = [(f"s{k}", "I-10", "WESTBOUND" if k % 2 else "EASTBOUND", "x", 33.3 + k * 0.02, -112.0, 33.32 + k * 0.02, -111.98, 1.5, float(k), None) for k in range(4)]
    schema = "tmc string, road string, direction string, intersection string, start_latitude double, start_longitude double, end_latitude double, " \
             "end_longitude double, miles double, road_order double, active_start_date timestamp"
    readings = [(f"s{rng.randrange(4)}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(300 * 60)), rng.random() * 80, 5 + rng.random() * 60, 60.0)
                for _ in range(2500)]
    return (
        spark.createDataFrame(events, names), spark.createDataFrame(segments, schema),
        spark.createDataFrame(readings, "tmc_code string, measurement_tstamp timestamp, speed double, travel_time_seconds double, reference_speed double"),
    )


def test_no_cross_join_and_pruned_scans(spark, binned, tmp_path):
    path = str(tmp_path / "binned")
    binned.withColumn("unused", F.lit("x")).write.parquet(path)
    table = spark.read.parquet(path)
    dense = grid.densify_grid(table.drop("unused"))
    for text in (plan(dense), plan(grid.interpolate_linear(dense, ["speed"])), plan(windows.add_lags(dense))):
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "unused" not in text
    hot = table.where(F.col("time_bin") >= "2024-01-05").groupBy("tmc_code").agg(F.avg("speed"))
    text = plan(hot)
    assert "PushedFilters: [IsNotNull(time_bin), GreaterThanOrEqual(time_bin" in text and "ReadSchema: struct<tmc_code:string,time_bin:timestamp,speed:double>" in text


def test_windows_partition_by_key_and_block(binned):
    for df in (windows.add_lags(binned), windows.buffer_mask(binned, F.col("speed") > 70, 3, "near")):
        text = plan(df)
        assert f"hashpartitioning(tmc_code" in text and BLOCK in text
        # No window may gather a whole segment: each is partitioned by a chunk or block as well.
        for line in text.splitlines():
            if "Window [lag" in line or "Window [max" in line:
                assert BLOCK in line


def test_top_k_uses_take_ordered(binned):
    assert "TakeOrderedAndProject" in plan(topk.worst_segments(binned.select(
        F.col("tmc_code").alias("tmc"), F.lit("r").alias("road"), F.lit("E").alias("direction"), F.col("speed").alias("peak_speed_drop"))))


def test_feature_table_end_to_end(spark, raw):
    from laneflow.functions.columns import to_utc

    events, segments, readings = raw
    utc = to_utc(events, ["Reported", "LastUpdated", "StartDate", "PlannedEndDate"])
    table = build_feature_table(utc, segments, readings, "2024-01-01 00:00:00", "2024-01-20 00:00:00", "2h", (33.2, 33.5, -112.1, -111.9), "I-10").persist()
    bins = grid.bin_readings(readings, "2h").select("time_bin").distinct().count()
    assert table.count() == 4 * (bins - 3)
    nulls = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("speed", "lag3", "miles", "evt_total", "tt_per_mile")]).first()
    assert sum(nulls) == 0
    assert table.where("evt_total != evt_cat_planned + evt_cat_unplanned").count() == 0
    assert table.agg(F.sum("evt_total")).first()[0] > 0
    table.unpersist()


def test_feature_table_round_trip(spark, binned, tmp_path):
    report = writers.write_feature_table(binned, str(tmp_path / "f")).first()
    assert report["n_rows"] == report["n_pairs"] == binned.count()
    assert readers.read_feature_table(spark, str(tmp_path / "f"), ["speed"]).columns == ["tmc_code", "time_bin", "speed"]
    binned.unionByName(binned).write.parquet(str(tmp_path / "dup"))
    with pytest.raises(ValueError):
        readers.read_feature_table(spark, str(tmp_path / "dup"))


def test_rollup_cache_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for force in (False, False, True):
        assert writers.rollup_cache(spark, str(tmp_path / "c"), build, force).count() == 3
    assert len(calls) == 2


def test_geojson_collection(spark, tmp_path):
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"LineString","coordinates":[[-112.0,33.0],[-111.9,33.1]]},' \
           '"properties":{"tmc":"a"}},{"type":"Feature","geometry":{"type":"Point","coordinates":[1.0,2.0]},"properties":{}}]}'
    (tmp_path / "roads.json").write_text(text)
    rows = readers.from_geojson(spark, str(tmp_path / "roads.json")).orderBy("point").collect()
    assert [(r["lon"], r["lat"]) for r in rows] == [(-112.0, 33.0), (-111.9, 33.1)]


@pytest.mark.parametrize("columns", [("model", "cv_rmse_mean"), ("name", "cv"), ("model_feat", "rmse_cv")])
def test_metric_aliases(spark, tmp_path, columns):
    spark.createDataFrame([("lr_full", 2.5)], list(columns)).write.json(str(tmp_path / "m"))
    assert readers.read_metrics(spark, str(tmp_path / "m")).collect() == [("lr_full", 2.5)]


def test_profile_quantiles_are_exact(binned):
    numbers = [f.name for f in binned.schema.fields if f.dataType.typeName() in ("double", "integer", "long", "bigint")]
    profile = {r["column"]: r for r in writers.table_profile(binned).collect()}
    for c in numbers:
        exact = binned.select(F.percentile(F.col(c).cast("double"), F.array(F.lit(0.5), F.lit(0.95))).alias("q")).first()["q"]
        got = profile[c]
        assert (got["p50"], got["p95"]) == (pytest.approx(exact[0]), pytest.approx(exact[1])) if exact else got["p50"] is None


def test_quantiles_of_a_null_key(spark):
    from laneflow.operators.ranking import grouped_quantiles

    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", None), ("b", None)], "k string, v double")
    assert {r["k"]: r["m"] for r in grouped_quantiles(df, ["k"], "v", {"m": 0.5}).collect()} == {None: 2.0, "a": 5.0}


def test_corridor_without_a_time_range(spark):
    """Box and road alone keep other segments out of the feature table, in every combination of conditions."""
    from laneflow.plans.feature_table import build_feature_table, corridor_segments

    place = "tmc string, road string, direction string, intersection string, start_latitude double, start_longitude double, end_latitude double, end_longitude double, miles double, road_order double, active_start_date timestamp"
    segments = spark.createDataFrame([
        ("in", "I-10", "E", "x", 33.1, -112.0, 33.2, -112.0, 1.0, 1.0, None), ("out", "I-10", "E", "x", 35.1, -112.0, 35.2, -112.0, 1.0, 2.0, None),
        ("other", "US-60", "E", "x", 33.1, -112.0, 33.2, -112.0, 1.0, 3.0, None),
    ], place)
    box = (33.0, 34.0, -113.0, -111.0)
    names = lambda **k: {r["tmc"] for r in corridor_segments(segments, **k).collect()}
    assert names(bbox=box, road="I-10") == {"in"} and names(bbox=box) == {"in", "other"} and names(road="I-10") == {"in", "out"} and len(names()) == 3
    readings = spark.sql("select t tmc_code, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,h) measurement_tstamp, 50d speed, 60d travel_time_seconds, 60d reference_speed from (select explode(array('in','out','other')) t), (select explode(sequence(0, 5)) h)")
    events = spark.createDataFrame([], "ID string, RoadwayName string, DirectionOfTravel string, EventType string, EventSubType string, StartDate timestamp, PlannedEndDate timestamp, Reported timestamp, LastUpdated timestamp, Latitude double, Longitude double")
    table = build_feature_table(events, segments, readings, bbox=box, road="I-10")
    assert {r["tmc_code"] for r in table.select("tmc_code").distinct().collect()} == {"in"}


def test_stream_upsert_replay_and_empty_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    first = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (1, 11, "c")], "id int, poll int, payload string")
    feeds.write_upserts(first, 0, path)
    feeds.write_upserts(first, 0, path)
    feeds.write_upserts(first.limit(0), 1, path)
    feeds.write_upserts(spark.createDataFrame([(2, 12, "d"), (3, 12, "e")], first.schema), 2, path)
    assert sorted(tuple(r) for r in feeds.current_state(spark, path).collect()) == [(1, 11, "c"), (2, 12, "d"), (3, 12, "e")]
    assert feeds.compact_log(spark, path, str(tmp_path / "compact")).count() == 3


def stored_rows(path):
    return sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True))


def test_store_grows_with_keys_not_with_batches(spark, tmp_path):
    path, want = str(tmp_path / "store"), {}
    for n in range(24):
        rows = [(i, n, f"{i}-{n}") for i in range(200) if n == 0 or (i * 7 + n) % 10 == 0]
        want |= {i: x for i, _, x in rows}
        feeds.write_upserts(spark.createDataFrame(rows, "id int, poll int, payload string"), n, path, buckets=4)
        assert stored_rows(path) <= 4 * 200
    assert {r["id"]: r["payload"] for r in feeds.current_state(spark, path).collect()} == want
    assert len(glob.glob(f"{path}/manifest/*")) == 2
    parts = spark.read.parquet(f"{path}/manifest/batch_id=23").groupBy("bucket").count().collect()
    assert max(r["count"] for r in parts) <= 5


def test_interrupted_and_replayed_batches(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "store"), "id int, poll int, payload string"
    feeds.write_upserts(spark.createDataFrame([(i, 1, "old") for i in range(50)], schema), 0, path, buckets=3)
    batch = spark.createDataFrame([(i, 2, "new") for i in range(40, 60)], schema)
    with monkeypatch.context() as broken:
        broken.setattr(spark, "createDataFrame", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            feeds.write_upserts(batch, 1, path)
    assert feeds.current_state(spark, path).where("payload = 'new'").count() == 0
    for _ in range(2):
        feeds.write_upserts(batch, 1, path)
    # An older row that arrives later changes nothing.
    feeds.write_upserts(spark.createDataFrame([(41, 0, "stale")], schema), 2, path)
    counts = {r["payload"]: r["count"] for r in feeds.current_state(spark, path).groupBy("payload").count().collect()}
    assert counts == {"old": 40, "new": 20}
    with pytest.raises(FileNotFoundError):
        feeds.current_state(spark, str(tmp_path / "nothing"))


def test_open_bins_are_provisional_and_late_rows_dropped(spark, tmp_path):
    folder, schema = str(tmp_path), "tmc_code string, measurement_tstamp timestamp, speed double"
    at = lambda text: dt.datetime.fromisoformat(f"2024-01-01 {text}")
    files = [
        [("a", at("00:10"), 10.0), ("a", at("01:10"), 20.0)],
        [("a", at("00:50"), 30.0), ("a", at("05:00"), 50.0)],  # the first bin is still open
        [("a", at("00:55"), 99.0), ("a", at("05:30"), 70.0), ("b", at("04:10"), 5.0)],  # the first bin is past the watermark
    ]
    seen = []
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        feeds.write_binned(feeds.stream_bin_readings(stream), f"{folder}/out", f"{folder}/check").awaitTermination()
        rows = feeds.current_bins(spark, f"{folder}/out").collect()
        seen.append({(r["tmc_code"], r["time_bin"].hour): (r["speed"], r["n"], r["is_final"]) for r in rows})
    assert seen[0] == {("a", 0): (10.0, 1, False), ("a", 1): (20.0, 1, False)}
    assert seen[1] == {("a", 0): (20.0, 2, True), ("a", 1): (20.0, 1, True), ("a", 5): (50.0, 1, False)}
    assert seen[2] == {("a", 0): (20.0, 2, True), ("a", 1): (20.0, 1, True), ("a", 5): (60.0, 2, False), ("b", 4): (5.0, 1, False)}


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_files_are_bounded_in_bytes(spark, tmp_path, fmt):
    rng = random.Random(2)
    rows = [(i, "x," * rng.randint(0, 60) + "é\"", None if i % 7 else 1.5) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, text string, v double").repartition(3, "id")
    path = str(tmp_path / fmt)
    files = writers.rewrite_bounded_files(df, path, 2_000, fmt).collect()
    on_disk = glob.glob(f"{path}/**/part-*", recursive=True)
    assert len(files) == len(on_disk) and max(os.path.getsize(f) for f in on_disk) <= 2_000 and max(r["n_bytes"] for r in files) <= 2_000
    # Files are well filled but for the last one of a partition.
    assert len(files) < 1.6 * sum(r["n_bytes"] for r in files) / 2_000 + 3
    back = spark.read.schema(df.schema).format(fmt).option("header", True).load(path).select("id", "text", "v")
    assert sorted(map(tuple, back.collect())) == rows
    assert writers.rewrite_bounded_files(df.limit(1), path, 2_000, fmt).count() == len(files)  # kept
    with pytest.raises(ValueError):
        writers.rewrite_bounded_files(df, str(tmp_path / "small"), 100, fmt)


def test_poll_log(spark):
    lines = ["[2025-01-01 00:00:01] Updated+Inserted: 5, total: 10 events in database", "Error fetching data: x", "No valid events data received",
             "[2025-01-01 09:00:01] Updated+Inserted: 7, total: 12 events in database"]
    log = feeds.parse_poll_log(spark.createDataFrame([(t,) for t in lines], "value string"))
    row = feeds.poll_health(log).first()
    assert (row["polls"], row["missed_polls"], row["fetch_errors"], row["no_data"], row["max_upserts"]) == (2, 2, 1, 1, 7)


def linear_data(spark, n=600):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        a, b = rng.random() * 4, rng.random() * 2
        rows.append((f"s{i % 5}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), a, b, 3.0 + 2.0 * a - 1.0 * b + rng.gauss(0, 0.01)))
    return spark.createDataFrame(rows, "tmc_code string, time_bin timestamp, a double, b double, y double").persist()


def test_known_coefficients(spark):
    df = linear_data(spark)
    model = E.TargetModel("lr", ["a", "b"], E.linear_regression(), log_target=False).fit(df, "y")
    assert list(model.fitted.stages[-1].coefficients) == pytest.approx([2.0, -1.0], abs=0.01)
    assert V.evaluate_regression(model, df, df, "y")["r2"] > 0.999
    mean, std = V.cross_validate(model, df, "y", ["tmc_code", "time_bin"], 3)
    assert 0.005 < mean < 0.02 and std < 0.01
    table = {r["feature"]: r for r in V.ols_inference(df.withColumn("same", F.lit(1.0)), ["a", "b", "same"], "y").collect()}
    spread = df.agg(F.stddev_samp("a"), F.stddev_samp("b")).first()
    assert set(table) == {"a", "b"}
    assert [table["a"]["coef"] / spread[0], table["b"]["coef"] / spread[1]] == pytest.approx([2.0, -1.0], abs=0.01)
    assert table["a"]["p_value"] < 1e-12


def test_collinear_features_get_an_answer(spark):
    rows = V.ols_inference(linear_data(spark).withColumn("twin", F.col("a")), ["a", "twin", "b"], "y").collect()
    coefs = {r["feature"]: r["coef"] for r in rows}
    assert coefs["a"] == pytest.approx(coefs["twin"])


def test_tree_predictions_invert_the_log(spark):
    df = linear_data(spark).withColumn("y", F.exp("y"))
    model = E.log1p_target("rf", ["a", "b", "absent"], E.random_forest(numTrees=5, maxDepth=6)).fit(df, "y")
    scored = model.predict(df)
    assert scored.agg(F.corr("prediction", "y")).first()[0] > 0.9 and "absent" not in scored.columns
    scores = V.feature_importance(spark, model)
    assert scores.first()["feature"] == "a"
    assert V.grouped_importance(scores, {"x": ["a"], "z": ["b"]}).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_model_grid_sizes():
    sizes = {g: len(E.model_grid(g)) for g in ("lr", "tree", "xgb", "all")}
    assert sizes == {"lr": 9, "tree": 14, "xgb": 7, "all": 30} and len(E.model_grid("all", fast=True)) == 4


def test_counterfactual_finds_a_planted_delay(spark):
    rng = random.Random(4)
    rows = [("s", i, rng.random(), int(i % 4 == 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "tmc_code string, i int, a double, evt int").withColumn("y", 10 + F.col("a") + 5 * F.col("evt"))
    none = E.TargetModel("n", ["a"], E.linear_regression(), log_target=False).fit(df.where("evt = 0"), "y")
    planned = E.TargetModel("p", ["a", "evt"], E.linear_regression(), log_target=False).fit(df, "y")
    out = V.counterfactual_delay(none, planned, df, "y").groupBy("evt").agg(F.avg("diff").alias("d"), F.max(F.abs("residuals")).alias("r")).collect()
    assert {r["evt"]: round(r["d"], 3) for r in out} == {0: 0.0, 1: 5.0} and max(r["r"] for r in out) < 1e-6


def test_forecast_recovers_a_seasonal_series(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("s", start + dt.timedelta(hours=h), 100 + 10 * ((h % 24) / 24) + 0.001 * h, float(h % 7 == 0)) for h in range(400)]
    df = spark.createDataFrame(rows, "tmc_code string, time_bin timestamp, y double, e double")
    got = forecast.per_segment_forecast(df, "y", {"base": [], "event": ["e"]}).collect()
    assert {r["config"] for r in got} == {"base", "event"} and all(r["mape_test"] < 1e-6 and r["corr_test"] > 0.999 for r in got)


def test_active_events_are_ordered(spark):
    rows = [("a", "accidentsAndIncidents", 5, None, 1), ("b", "roadwork", 1, 3, 9), ("c", "roadwork", 1, 20, 5), ("d", "roadwork", None, 20, 5)]
    df = spark.createDataFrame(rows, "ID string, EventType string, StartDate long, PlannedEndDate long, LastUpdated long")
    assert [r["ID"] for r in filters.active_events(df, 4, 10).collect()] == ["c", "a"]


def test_epoch_spine_overshoots(spark):
    assert [r[0] for r in intervals.epoch_spine(spark, 0, 100, 60).collect()] == [0, 60, 120]
    assert [r[0] for r in intervals.epoch_spine(spark, 0, 120, 60).collect()] == [0, 60, 120]


def test_histogram_edges(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 3.0)], "k string, v double")
    got = sorted((r["k"], r["bin"], r["n"]) for r in aggregates.histogram(df, F.col("v"), "k", 20).collect())
    assert got == [("a", 0, 1), ("a", 19, 1), ("b", 10, 1)]
