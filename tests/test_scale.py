"""Plans and results of the steps that must grow no faster than their input."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from laneflow.operators import grid
from laneflow.plans.feature_table import dense_features


@pytest.fixture(scope="module")
def binned(spark, tmp_path_factory):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"s{k}", start + dt.timedelta(hours=h), rng.random() * 80, 5 + rng.random() * 60, 60.0) for k in range(5) for h in range(90) if rng.random() < 0.3]
    path = str(tmp_path_factory.mktemp("scale") / "binned")
    spark.createDataFrame(rows, "tmc_code string, time_bin timestamp, speed double, travel_time_seconds double, reference_speed double").write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_the_feature_table_are_neither_sorted_nor_shuffled(spark, binned):
    """Cells are written out after the windows; blocks of any size give the same table."""
    segments = spark.sql("select tmc, 1.5d miles, map('onramp', 1) tmc_tags from values ('s0'), ('s1') as t(tmc)")
    events = spark.sql("""select 's0' near_tmc, 'cat_planned' cat_event_type, timestamp'2024-01-01 05:30:00' event_start, timestamp'2024-01-02 04:00:00' event_end
                          union all select 's1', 'cat_unplanned', timestamp'2024-01-02 05:00:00', timestamp'2024-01-02 06:00:00'""")
    table = dense_features(binned, events, segments)
    above = plan(table).split("Generate explode(sequence(")[0]
    assert "Window" not in above and "Exchange hashpartitioning" not in above
    small = dense_features(binned, events, segments, block_rows=7)
    assert table.count() == small.count() and table.exceptAll(small).isEmpty() and small.exceptAll(table).isEmpty()


def test_wide_tables_of_many_columns(spark):
    """Cells in one array by a table of names: the same as named columns, with a plan that doesn't grow with them."""
    from laneflow.operators import reshape

    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"c{rng.randrange(3000):04d}", start + dt.timedelta(minutes=rng.randrange(9000)), rng.choice([None, 1.0, 2.5, 40.0])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "tmc_code string, measurement_tstamp timestamp, speed double").persist()
    places = reshape.column_places(df, "tmc_code")
    names = [r[0] for r in places.orderBy(places.columns[1]).collect()]
    assert names == sorted({r[0] for r in rows}) and [r[1] for r in places.orderBy("tmc_code").collect()] == list(range(len(names)))
    wide = reshape.resample_matrix(reshape.time_segment_matrix(df, places, interval="1h"), places, "1d")
    assert {len(r["cells"]) for r in wide.collect()} == {len(names)} and len(plan(wide)) < 40_000
    few = names[::300]
    kept = df.where(F.col("tmc_code").isin(few))
    some = reshape.column_places(kept, "tmc_code")
    for agg in ("mean", "median"):
        arrays = reshape.resample_matrix(reshape.time_segment_matrix(kept, some, interval="2h", agg=agg), some, "1d")
        columns = reshape.resample_matrix(reshape.time_segment_matrix(kept, few, interval="2h", agg=agg), few, "1d")
        assert {r["time_bin"]: r["cells"] for r in arrays.collect()} == {r["time_bin"]: [r[c] for c in few] for r in columns.collect()}
    long = reshape.stack_wide_to_long(reshape.pivot_long_to_wide(kept, "measurement_tstamp", "tmc_code", "speed", some), "measurement_tstamp", some, "tmc_code", "speed")
    assert long.exceptAll(kept.where("speed is not null").select("measurement_tstamp", "tmc_code", "speed").distinct()).isEmpty()
    df.unpersist()


def test_quantiles_of_large_and_small_groups(spark, monkeypatch):
    """Selected and sorted groups have the same exact quantiles; the rows of a large group are not shuffled as a whole."""
    from laneflow.operators import ranking

    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, -0.5, float(rng.randrange(40)), rng.random()])) for _ in range(4000)] + [("c", 7.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").persist()
    shares = {"lo": 0.01, "mid": 0.5, "hi": 0.99}
    want = {r["k"]: tuple(r["q"]) for r in df.where("v is not null").groupBy("k").agg(F.percentile("v", list(shares.values())).alias("q")).collect()}
    for limit in (1, 1000, 100_000):
        monkeypatch.setattr(ranking, "GROUP_ROWS", limit)
        found = {r["k"]: tuple(r[n] for n in shares) for r in ranking.grouped_quantiles(df, ["k"], "v", shares).collect()}
        assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
    whole = ranking.grouped_quantiles(df, [], "v", shares).first()
    assert tuple(whole) == pytest.approx(tuple(df.agg(F.percentile("v", list(shares.values()))).first()[0]))
    # One expression per value, whatever the number of slices.
    text = df.select(F.array(F.lit(1.0), F.lit(3.0)).alias("__edges"), "v").select("v", ranking._slice("v").alias("s"))
    assert all(r["s"] == (r["v"] > 1) + (r["v"] > 3) for r in text.where("v is not null").collect())
    assert len(plan(text)) < 5000
    df.unpersist()


def test_cells_of_the_grid_meet_no_table_by_segment(spark, binned):
    """Cells are written out where readings lie sorted, and gaps are filled from rows beside them: no join of all cells."""
    dense = grid.densify_grid(binned)
    for df in (dense, grid.interpolate_linear(dense, grid.MEASURES, block_rows=7)):
        assert "Join [tmc_code" not in plan(df)
    doubled = grid.densify_grid(binned.unionByName(binned.limit(1)))
    keys, times = binned.select("tmc_code").distinct().count(), binned.select("time_bin").distinct().count()
    assert dense.count() == keys * times and doubled.count() == keys * times + 1
    assert dense.where("speed is not null").select(*binned.columns).exceptAll(binned).isEmpty()
    one, many = (grid.interpolate_linear(dense, grid.MEASURES, block_rows=n) for n in (7, 4096))
    assert one.exceptAll(many).isEmpty() and one.count() == keys * times and one.where("speed is null").isEmpty()


def test_the_calendar_is_worked_out_per_bin_and_long_stages_are_compiled(spark, binned, tmp_path):
    """No sine per cell; a stage too long for the JVM's compiler is not run as one method."""
    from laneflow.catalog.fixtures import Fixtures

    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    Fixtures(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    segments = spark.sql("select tmc, 1.5d miles, map('onramp', 1) tmc_tags from values ('s0'), ('s1') as t(tmc)")
    events = spark.sql("select 's0' near_tmc, 'cat_planned' cat_event_type, timestamp'2024-01-01 05:30:00' event_start, timestamp'2024-01-02 04:00:00' event_end")
    table = dense_features(binned, events, segments)
    above = plan(table).split("Generate explode(sequence(")[0]
    assert "hour_sin" in above and "SIN(" not in above
    bad = table.where("abs(hour_of_week_sin - sin(2 * pi() * (weekday(time_bin) * 24 + hour(time_bin)) / 168)) > 1e-12 or is_weekend <> int(weekday(time_bin) > 4)")
    assert table.count() > 0 and bad.isEmpty()


def test_jobs_over_the_feature_table_do_not_write_it_again(spark, monkeypatch, tmp_path):
    """The job that writes the table needs no copy of its own; training reads the written one."""
    from laneflow.catalog import QUERIES, fixtures, q_models

    events = spark.range(400).selectExpr(
        "id AS event_id", "timestamp_seconds(1704067200 + id * 977) AS ts", "id % 5 AS user_id",
        "element_at(array('error', 'click', 'view', 'purchase'), int(id % 4) + 1) AS event_type", "double(id % 61) AS value",
        """concat('{"k": ', id % 9, '}') AS props""",
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    places = spark.range(10).selectExpr("id AS vec_id", "transform(sequence(1, 8), i -> float((i * 7 + id) % 5 / 5)) AS embedding", "int(id % 4) AS label")
    places.write.parquet(f"{tmp_path}/embeddings.parquet")
    wide = []

    def counted(df, label="table"):
        wide.append(label) if {"tt_per_mile", "hour_sin", "lag1"} <= set(df.columns) else None
        return written(df, label)

    written = fixtures.materialise
    monkeypatch.setattr(fixtures, "materialise", counted)
    monkeypatch.setattr(q_models, "materialise", counted)
    assert QUERIES["s05_write_feature_table"](spark, str(tmp_path)).first()["n_columns"] == 28
    assert wide == []
    # The feature table, and the balanced train set.
    q_models.training_and_test(fixtures.Fixtures(spark, str(tmp_path)))
    assert wide == ["features", "table"]


def test_tensors_are_filled_in_one_walk(spark):
    """No look-up per position: gaps at both ends and between rows, bad values, positions outside the list."""
    from laneflow.operators.graph import tensor_rows

    order = spark.sql("select 't' || id tmc, int(id) position from range(6)").unionByName(spark.sql("select 'far' tmc, 9 position")).where("tmc <> 't5'")
    df = spark.sql("""select * from values (1, 't1', 2d, 3d), (1, 't4', double('nan'), null), (2, 't0', 7d, 8d), (2, 'far', 1d, 1d), (3, 'far', 4d, 5d)
                      as t(time_bin, tmc_code, a, y)""")
    table = tensor_rows(df, order, ["a"], "y")
    assert "map_from_entries" not in plan(table)
    got = {r["time_bin"]: (r["x"], r["y"], r["feature_nulls"], r["target_nulls"]) for r in table.collect()}
    assert got[1] == ([[0.0], [2.0], [0.0], [0.0], [0.0], [0.0]], [0.0, 3.0, 0.0, 0.0, 0.0, 0.0], 5, 5)
    assert got[2] == ([[7.0]] + [[0.0]] * 5, [8.0] + [0.0] * 5, 4, 4)
    assert got[3] == ([[0.0]] * 6, [0.0] * 6, 5, 5)
    with pytest.raises(Exception, match="two rows at one position"):
        tensor_rows(df.unionAll(df), order, ["a"], "y").collect()
