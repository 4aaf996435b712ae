"""Registered model queries: whole tables and known answers."""

import datetime as dt
import glob
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import compare
from laneflow.catalog import QUERIES, q_models, registry
from laneflow.functions.columns import log_features
from laneflow.models import estimators as E, evaluation as V, store
from laneflow.plans.training import train_and_compare, write_report
from laneflow.schemas import FEATURE_KEYS as KEYS
from laneflow.sources import readers

SF = f"{compare.TESTDATA}/sf0.001"


@pytest.mark.skipif(not glob.glob(f"{SF}/*.parquet"), reason="no test tables")
def test_every_segment_is_scored(spark, shared_fixtures):
    features = registry.Fixtures(spark, SF).features.select("tmc_code", F.col("time_bin").cast("timestamp_ntz").alias("time_bin"))
    scored = QUERIES["m20_score_models_long"](spark, SF).persist()
    rows = scored.where("tmc_code <> 'S999999'").groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("tmc_code").alias("segments"), F.count("prediction").alias("answers"))
    n, segments = features.agg(F.count("*"), F.countDistinct("tmc_code")).first()
    assert segments > 2
    assert sorted(tuple(r) for r in rows.collect()) == [("lr_cyc", n, segments, n), ("lr_full", n, segments, n)]
    blank = scored.where("tmc_code = 'S999999'").agg(F.count("*"), F.count("prediction")).first()
    assert tuple(blank) == (2 * features.select("time_bin").distinct().count(), 0)


@pytest.fixture(scope="module")
def planted(spark):
    """Travel time is 2 and one more for each of five marks, which no shallow tree tells at once; few rows are without an event."""
    rng, start, rows = random.Random(1), dt.datetime(2024, 1, 1), []
    marks = ["onramp", "offramp", "curve", "is_weekend", "evt_cat_planned"]
    for i in range(600):
        values = [rng.randrange(2) for _ in marks]
        rows.append((f"s{i % 3}", start + dt.timedelta(hours=i // 3), 2.0 + sum(values), int(i % 10 > 0), *values))
    features = spark.createDataFrame(rows, "tmc_code string, time_bin timestamp, tt_per_mile double, evt_total int, " + ", ".join(f"{m} int" for m in marks))
    return SimpleNamespace(spark=spark, features=features.coalesce(1))


def settings(regressor):
    return type(regressor), {p.name: v for p, v in regressor.extractParamMap().items()}


@pytest.mark.parametrize("name, wanted", [
    ("m08", [E.random_forest]), ("m09", [E.gradient_boosting]), ("m10", [E.boosted_trees]), ("m16", [E.random_forest]), ("m19", [E.boosted_trees] * 2),
])
def test_fits_have_the_settings_of_the_library(planted, monkeypatch, name, wanted):
    seen, fit = [], E.TargetModel.fit_design

    def cheap(self, design):
        seen.append(settings(self.regressor))
        self.regressor = E.linear_regression()
        return fit(self, design)

    monkeypatch.setattr(E.TargetModel, "fit_design", cheap)
    getattr(q_models, name)(planted)
    assert seen[: len(wanted)] == [settings(make()) for make in wanted]


def test_tuning_and_plans_have_the_settings_of_the_library(planted, monkeypatch):
    class Done(Exception):
        pass

    points, calls = [], []

    def tune(build, grid, *rest, **more):
        points.append(build().regressor)
        return planted.spark.createDataFrame([({}, 0.0, 0.0)], "params map<string,string>, cv_rmse double, cv_rmse_std double")

    def plan(*args, **kwargs):
        calls.append(kwargs)
        raise Done

    monkeypatch.setattr(q_models.V, "tune", tune)
    q_models.m14(planted)
    assert [settings(p) for p in points] == [settings(E.random_forest()), settings(E.boosted_trees())]
    monkeypatch.setattr(q_models, "train_and_compare", plan)
    monkeypatch.setattr(q_models, "event_impact", plan)
    for query in (q_models.e2, q_models.e3):
        with pytest.raises(Done):
            query(planted)
    assert calls == [{"folds": 5}, {}]


def test_boosted_fit_reaches_a_known_answer(planted):
    row = q_models.m09(planted).first()
    assert row["model"] == "gbrt_full" and row["r2"] > 0.98


def test_side_by_side_fits_equal_single_ones(planted):
    """Sharing designs and running at once change no number; every model's folds are its own."""
    train = planted.features
    models = {n: E.log1p_target(n, f, E.linear_regression(), scale=True) for n, f in (("a", ["onramp", "curve"]), ("b", ["onramp", "curve"]), ("c", ["offramp"]))}
    models["d"] = E.log1p_target("d", ["onramp", "curve"], E.random_forest(numTrees=5, maxDepth=3))
    rows = {r["model"]: r for r in V.evaluate_grid(models, train, train, "tt_per_mile", KEYS, folds=4).collect()}
    for name, model in models.items():
        alone = V.evaluate_regression(model.fresh(), train, train, "tt_per_mile")
        mean, deviation = V.cross_validate(model.fresh(), train, "tt_per_mile", KEYS, 4)
        assert (rows[name]["rmse"], rows[name]["cv_rmse_mean"], rows[name]["cv_rmse_std"]) == pytest.approx((alone["rmse"], mean, deviation))
    assert rows["a"]["rmse"] == rows["b"]["rmse"] != rows["c"]["rmse"]


def test_whole_comparison_with_small_trees(planted, tmp_path):
    """All 30 models, five folds, ranked; the marks' sum is best told by models that see them."""
    small = {"rf": {"numTrees": 5, "maxDepth": 4}, "gbrt": {"maxIter": 4}, "xgb": {"maxIter": 4}}
    lags = {f"lag{i}_tt_per_mile": F.lit(2.0) for i in (1, 2, 3)}
    report = train_and_compare(planted.features.withColumns(lags), tree_params=small)
    rows = report.metrics.collect()
    assert len(rows) == 30 and report.best == rows[0]["model"] and all(r["cv_rmse_mean"] > 0 for r in rows)
    assert [r["cv_rmse_mean"] for r in rows] == sorted(r["cv_rmse_mean"] for r in rows)
    # Each of the four 0/1 marks of the road set adds one: without the event mark a quarter of variance stays.
    by_name = {r["model"]: r for r in rows}
    assert by_name["lr_full"]["cv_rmse_mean"] < by_name["lr_base"]["cv_rmse_mean"]

    folder, spark = str(tmp_path), planted.spark
    write_report(report, folder)
    described = {r["model"]: r for r in store.stored_models(spark, f"{folder}/models").collect()}
    assert len(described) == 30 and [n for n, r in described.items() if r["is_best"]] == [report.best]
    assert described["rf_full"]["metrics"]["rmse"] == pytest.approx(by_name["rf_full"]["rmse"])
    table = planted.features.withColumns(lags)
    for name in ("lr_full", "rf_full", "xgb_base", "lasso_full"):
        again = store.load_model(spark, f"{folder}/models", name)
        both = again.predict(report.models[name].predict(log_features(table), "before"), "after")
        assert both.where("not (abs(before - after) < 1e-9)").count() == 0 and both.count() == 600
    assert store.load_best(spark, f"{folder}/models").name == report.best
    with pytest.raises(KeyError):
        store.load_model(spark, f"{folder}/models", "none")
    with pytest.raises(ValueError):
        store.save_models(spark, [E.log1p_target("raw", ["curve"], E.linear_regression())], folder)
    nested = readers.read_top_features(spark, f"{folder}/metrics_json")
    assert sorted(map(tuple, nested.collect())) == sorted(tuple(r[c] for c in nested.columns) for r in report.top_features.collect())
    shares = spark.read.parquet(f"{folder}/importance_by_group").groupBy("model").agg(F.sum("importance").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in shares)
    assert {"tt_per_mile", "log_lag1_tt_per_mile", "curve"} <= set(spark.read.parquet(f"{folder}/training_columns").columns)
