"""What queries leave on disk: only the columns they read, and no long table where a wide one will do."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import compare
from laneflow.catalog.fixtures import Fixtures
from laneflow.operators import joins
from laneflow.operators.reshape import column_places, pivot_long_to_wide
from laneflow.sources import readers, writers

SF = f"{compare.TESTDATA}/sf0.001"


def test_predictions_write_no_whole_feature_table(spark):
    fx = Fixtures(spark, SF)
    assert fx.predictions.count() == 2 * fx.travel_times.count() > 0
    assert "features" not in fx.__dict__ and len(fx.travel_times.columns) == 5
    whole = fx.features
    kept = fx.feature_columns("tmc_code", "time_bin", "tt_per_mile", "lag1_tt_per_mile", "lag2_tt_per_mile")
    assert kept.inputFiles() == whole.inputFiles()
    assert kept.exceptAll(fx.travel_times).count() == 0 == fx.travel_times.exceptAll(kept).count()


def test_truth_meets_prediction_as_whole_rows(spark):
    rows = spark.createDataFrame(
        [(1, "a", 1.0), (1, "b", None), (2, "a", 3.0), (3, "c", 4.0)], "time_bin int, tmc_code string, v double"
    )
    places = column_places(spark.createDataFrame([("a",), ("b",), ("c",)], "tmc string"), "tmc")
    truth = pivot_long_to_wide(rows, "time_bin", "tmc_code", "v", places)
    predicted = pivot_long_to_wide(rows.where("time_bin <> 2").withColumn("v", F.col("v") * 10), "time_bin", "tmc_code", "v", places)
    nameless = spark.createDataFrame([(None, truth.select("cells").first()[0])], truth.schema)
    long = joins.join_truth_prediction(truth.union(nameless), predicted.union(predicted).union(nameless), places)
    assert long.columns == ["time_bin", "tmc_code", "y_true", "y_pred"]
    seen = Counter(tuple(r) for r in long.where("time_bin IS NOT NULL").collect())
    assert seen == {
        (1, "a", 1.0, 10.0): 2, (1, "b", None, None): 2, (1, "c", None, None): 2, (2, "a", 3.0, None): 1, (2, "b", None, None): 1, (2, "c", None, None): 1,
        (3, "a", None, None): 2, (3, "b", None, None): 2, (3, "c", 4.0, 40.0): 2,
    }
    assert long.where("time_bin IS NULL AND y_pred IS NULL").count() == 3
    assert "[time_bin#" not in "".join(line for line in long._jdf.queryExecution().executedPlan().toString().splitlines() if "tmc_code" in line and "Join" in line)


def test_models_share_the_shuffled_timeline(spark, tmp_path):
    stored = [("a", 1, "m", 0.5), ("a", 1, "m", 0.6), ("b", 2, "n", 0.7), ("b", 2, None, 0.8), (None, 1, "m", 0.9)]
    frame = spark.createDataFrame(stored, "tmc_code string, time_bin int, model string, y_pred double")
    writers.write_predictions(frame, str(tmp_path / "p"))
    timeline = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 1)], "tmc_code string, time_bin int")
    back = readers.read_predictions(spark, str(tmp_path / "p"), timeline)
    assert back.columns == ["tmc_code", "time_bin", "model", "y_pred"]
    none = [(None, 1, m, None) for m in "mn"]
    assert Counter(tuple(r) for r in back.collect()) == Counter(
        [("a", 1, "m", v) for v in (0.5, 0.6)] * 2 + [("a", 1, "n", None)] * 2 + [("b", 2, "m", None), ("b", 2, "n", 0.7)] + none
    )
    assert "explode" not in back._jdf.queryExecution().optimizedPlan().toString().lower()
    assert readers.read_predictions(spark, str(tmp_path / "p"), timeline, ["x"]).count() == 0
