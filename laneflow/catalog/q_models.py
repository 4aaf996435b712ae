"""Spark ML operators and the model plans.

Every fit has the library's own settings and reads its whole training set.
"""

from __future__ import annotations

from functools import partial

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from laneflow.catalog.fixtures import Fixtures
from laneflow.catalog.registry import query
from laneflow.functions.columns import log_features
from laneflow.models import estimators as E, evaluation as V
from laneflow.models.store import load_best, save_models
from laneflow.models.features import CYCLE, GROUPS, NO_EVENT_FEATURES, PLANNED_FEATURES, RAW_LAGS, ROAD, feature_sets
from laneflow.operators.windows import chronological_split
from laneflow.plans.impact import event_impact
from laneflow.plans.training import train_and_compare, training_sets
from laneflow.schemas import FEATURE_KEYS
from laneflow.session import materialise, shared_dir

TARGET = "tt_per_mile"


def training_and_test(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    """Balanced train set, written once, and the test rows of the feature table, which is written already."""
    train, test = training_sets(fx.features)
    return materialise(train), test


def _one(fx: Fixtures, model: E.TargetModel) -> DataFrame:
    train, test = training_and_test(fx)
    row = V.evaluate_regression(model, train, test, TARGET)
    names = [c.split()[0] for c in V.METRICS_SCHEMA.split(", ")]
    return fx.spark.createDataFrame([tuple(row[n] for n in names)], V.METRICS_SCHEMA).select("model", "rmse", "mae", "r2")


@query("m05_scale_features", """
    SELECT tmc_code, time_bin, speed / (SELECT stddev_samp(speed) FROM features) AS speed_scaled, miles / (SELECT stddev_samp(miles) FROM features) AS miles_scaled FROM features""",
    "features", "speed_scaled miles_scaled")
def m05(fx: Fixtures) -> DataFrame:
    rows = fx.features.select(*FEATURE_KEYS, "speed", "miles")
    scaled = Pipeline(stages=E.scale_features(["speed", "miles"])).fit(rows).transform(rows)
    return scaled.withColumn("f", vector_to_array("features")).select(*FEATURE_KEYS, F.col("f")[0].alias("speed_scaled"), F.col("f")[1].alias("miles_scaled"))


@query("m06_log1p_target", """
    WITH fit AS (SELECT regr_slope(ln(1 + tt_per_mile), lag1_tt_per_mile) AS b, regr_intercept(ln(1 + tt_per_mile), lag1_tt_per_mile) AS a FROM features)
    SELECT tmc_code, time_bin, round(exp(a + b * lag1_tt_per_mile) - 1, 3) AS prediction FROM features CROSS JOIN fit""", "features")
def m06(fx: Fixtures) -> DataFrame:
    """One-feature least squares on log1p of the target, predictions back in original units."""
    rows = fx.features.select(*FEATURE_KEYS, TARGET, "lag1_tt_per_mile")
    model = E.log1p_target("lr_lag1", ["lag1_tt_per_mile"], E.linear_regression(solver="normal"), scale=True).fit(rows, TARGET)
    # Two solvers agree to fewer digits than two sums do.
    return model.predict(rows).select(*FEATURE_KEYS, F.round("prediction", 3).alias("prediction"))


@query("m07_fit_linear")
def m07(fx: Fixtures) -> DataFrame:
    """All nine linear models with hold-out errors."""
    train, test = training_and_test(fx)
    return V.evaluate_grid(E.model_grid("lr", n_rows=train.count()), train, test, TARGET, FEATURE_KEYS).drop("fit_time")


@query("m08_fit_random_forest")
def m08(fx: Fixtures) -> DataFrame:
    return _one(fx, E.log1p_target("rf_full", feature_sets()["full"], E.random_forest()))


@query("m09_fit_gbt")
def m09(fx: Fixtures) -> DataFrame:
    return _one(fx, E.log1p_target("gbrt_full", feature_sets()["full"], E.gradient_boosting()))


@query("m10_fit_boosted")
def m10(fx: Fixtures) -> DataFrame:
    return _one(fx, E.log1p_target("xgb_full", feature_sets()["full"], E.boosted_trees()))


@query("m11_model_grid", """
    WITH sets AS (SELECT * FROM (VALUES ('base', 5), ('base_lags', 8), ('full', 17), ('cyc', 12), ('cyc_lags', 15), ('evt', 7), ('evt_lags', 10)) AS s(name, n)),
    grid AS (SELECT family || '_' || name AS model, n FROM (VALUES ('lr'), ('rf'), ('gbrt'), ('xgb')) AS f(family) CROSS JOIN sets
             UNION ALL SELECT * FROM (VALUES ('ridge_full', 17), ('lasso_full', 17)) AS p(model, n))
    SELECT model, CAST(n AS INTEGER) AS n_features, (SELECT count(*) FROM features) AS n_rows FROM grid""", "features")
def m11(fx: Fixtures) -> DataFrame:
    """The 30-model grid next to the number of rows each model would train on."""
    grid = E.model_grid("all", n_rows=1)
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(len(m.features)).alias("n_features")) for n, m in grid.items()])
    return fx.features.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(pairs).alias("m"), "n_rows").select("m.*", "n_rows")


@query("m12_evaluate_regression", """
    SELECT model, sqrt(avg(power(y_true - y_pred, 2))) AS rmse, avg(abs(y_true - y_pred)) AS mae,
           1 - sum(power(y_true - y_pred, 2)) / (var_pop(y_true) * count(*)) AS r2, count(*) AS n FROM predictions GROUP BY 1""", "predictions", "rmse mae r2")
def m12(fx: Fixtures) -> DataFrame:
    from laneflow.operators.stats import regression_metrics

    return regression_metrics(fx.predictions, "y_true", "y_pred", ["model"])


@query("m13_cross_validate")
def m13(fx: Fixtures) -> DataFrame:
    train, _ = training_and_test(fx)
    model = E.log1p_target("lr_full", feature_sets()["full"], E.linear_regression(), scale=True)
    mean, std = V.cross_validate(model, train, TARGET, FEATURE_KEYS, 5)
    return fx.spark.createDataFrame([("lr_full", mean, std)], "model string, cv_rmse_mean double, cv_rmse_std double")


@query("m14_tune")
def m14(fx: Fixtures) -> DataFrame:
    """Grid search over a small forest grid, and two random points of a boosted one."""
    train, _ = training_and_test(fx)
    features = feature_sets()["cyc_lags"]
    forest = V.tune(
        lambda **p: E.log1p_target("rf", features, E.random_forest(**p)), {"maxDepth": [3, 5]}, train, TARGET, FEATURE_KEYS, 3
    )
    boosted = V.tune(
        lambda **p: E.log1p_target("xgb", features, E.boosted_trees(**p)), {"maxDepth": [3, 5], "stepSize": [0.05, 0.1]}, train, TARGET,
        FEATURE_KEYS, 3, n_iter=2,
    )
    both = forest.withColumn("search", F.lit("grid")).unionByName(boosted.withColumn("search", F.lit("random")))
    return both.select("search", F.to_json("params").alias("params"), "cv_rmse", "cv_rmse_std")


@query("m15_regularisation_path")
def m15(fx: Fixtures) -> DataFrame:
    return E.regularisation_path(fx.readings, "speed", "travel_time_seconds", [10.0**i for i in range(-5, 4)], degree=10)


@query("m16_feature_importance")
def m16(fx: Fixtures) -> DataFrame:
    train, _ = training_and_test(fx)
    forest = E.log1p_target("rf_full", feature_sets()["full"], E.random_forest()).fit(train, TARGET)
    linear = E.log1p_target("lr_full", feature_sets()["full"], E.linear_regression(), scale=True).fit(train, TARGET)
    return V.feature_importance(fx.spark, forest).unionByName(V.feature_importance(fx.spark, linear))


_GROUP_CASE = " ".join(f"WHEN feature IN ({', '.join(repr(f) for f in members)}) THEN '{g}'" for g, members in GROUPS.items())
_ALL = [f for members in GROUPS.values() for f in members] + ["unlisted"]


@query("m17_grouped_importance", f"""
    SELECT CASE {_GROUP_CASE} ELSE 'other' END AS "group", sum(score) / (SELECT sum(score) FROM scored WHERE score > 0) AS importance FROM scored WHERE score > 0 GROUP BY 1""".replace(
        "SELECT CASE", f"""WITH scored AS (SELECT [{', '.join(repr(f) for f in _ALL)}][1 + o_custkey % {len(_ALL)}] AS feature, avg(o_totalprice) - 250000 AS score FROM orders GROUP BY 1)
    SELECT CASE""", 1), "", "importance")
def m17(fx: Fixtures) -> DataFrame:
    """Scores made from order values, some negative."""
    names = F.array(*[F.lit(f) for f in _ALL])
    scores = fx.table("orders").groupBy(F.element_at(names, (F.col("o_custkey") % len(_ALL) + 1).cast("int")).alias("feature")).agg(
        (F.avg("o_totalprice") - 250_000).alias("score")
    )
    return V.grouped_importance(scores)


@query("m18_ols_inference", """
    WITH f AS (SELECT lag1_tt_per_mile AS x, tt_per_mile AS y FROM features),
    m AS (SELECT regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, count(*) AS n, stddev_samp(x) AS s FROM f)
    SELECT 'lag1_tt_per_mile' AS feature, b * s AS coef, b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS t_stat FROM m""", "features", "coef t_stat")
def m18(fx: Fixtures) -> DataFrame:
    """One scaled feature, for which SQL gives coefficient and t."""
    return V.ols_inference(fx.features, ["lag1_tt_per_mile"], TARGET).drop("p_value")


@query("m18_ols_inference_full")
def m18_full(fx: Fixtures) -> DataFrame:
    return V.ols_inference(fx.features, CYCLE + RAW_LAGS + ROAD, TARGET)


@query("m19_counterfactual_delay")
def m19(fx: Fixtures) -> DataFrame:
    """Both models of the impact study scored on every row."""
    features = fx.features
    none, planned = E.log1p_target("no_evt", NO_EVENT_FEATURES, E.boosted_trees()), E.log1p_target("plnd_evt", PLANNED_FEATURES, E.boosted_trees())
    V.concurrently(fx.spark, [partial(none.fit, features.where("evt_total = 0"), TARGET), partial(planned.fit, features, TARGET)])
    return V.counterfactual_delay(none, planned, features).select(*FEATURE_KEYS, "diff", "residuals")


@query("m20_score_models_long")
def m20(fx: Fixtures) -> DataFrame:
    """All segments of the feature table, and one that it lacks."""
    train, _ = training_and_test(fx)
    models = {
        name: E.log1p_target(name, feature_sets()[name[3:]], E.linear_regression(), scale=True).fit(train, TARGET) for name in ("lr_cyc", "lr_full")
    }
    features = fx.features
    segments = features.select("tmc_code").union(fx.spark.createDataFrame([("S999999",)], "tmc_code string")).distinct()
    return V.score_models_long(models, log_features(features), FEATURE_KEYS, segments)


@query("m20_stored_model", """
    WITH fit AS MATERIALIZED (SELECT regr_slope(ln(1 + tt_per_mile), lag1_tt_per_mile) AS b, regr_intercept(ln(1 + tt_per_mile), lag1_tt_per_mile) AS a FROM features)
    SELECT tmc_code, time_bin, 'lr_lag1' AS model, round(exp((SELECT a FROM fit) + (SELECT b FROM fit) * lag1_tt_per_mile) - 1, 3) AS prediction FROM features""", "features")
def m20_stored(fx: Fixtures) -> DataFrame:
    """A model fitted, stored with its metrics, read back by name and scored on every row."""
    rows = fx.features.select(*FEATURE_KEYS, TARGET, "lag1_tt_per_mile")
    model = E.log1p_target("lr_lag1", ["lag1_tt_per_mile"], E.linear_regression(solver="normal"), scale=True).fit(rows, TARGET)
    folder = shared_dir(fx.spark, "models")
    save_models(fx.spark, [model], folder, {"lr_lag1": {"n_rows": rows.count()}}, best="lr_lag1")
    return V.score_models_long({"lr_lag1": load_best(fx.spark, folder)}, rows, FEATURE_KEYS).withColumn("prediction", F.round("prediction", 3))


@query("m23_model_leaderboard", """
    WITH tab AS (SELECT ['lr', 'rf', 'xgb'][1 + o_custkey % 3] || ['_full', '_base'][1 + o_orderkey % 2] AS model, stddev_samp(o_totalprice) / 1000 AS cv_rmse FROM orders GROUP BY 1),
    seq AS (SELECT ['lstm_full', 'gnn_full'][1 + o_orderkey % 2] AS model, avg(o_totalprice) AS mse FROM orders GROUP BY 1)
    SELECT model, CASE model WHEN 'lr_full' THEN 'Linear Regression' WHEN 'rf_full' THEN 'Random Forest' WHEN 'xgb_full' THEN 'XGBoost' WHEN 'lstm_full' THEN 'LSTM' ELSE 'ST-GNN' END AS label, rmse
    FROM (SELECT model, cv_rmse AS rmse FROM tab WHERE model LIKE '%full' UNION ALL SELECT model, sqrt(mse) FROM seq)""", "", "rmse")
def m23(fx: Fixtures) -> DataFrame:
    orders = fx.table("orders")
    pick = lambda names, key: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(key) % len(names) + 1).cast("int"))
    tabular = orders.groupBy(F.concat(pick(["lr", "rf", "xgb"], "o_custkey"), pick(["_full", "_base"], "o_orderkey")).alias("model")).agg(
        (F.stddev_samp("o_totalprice") / 1000).alias("cv_rmse")
    )
    sequence = orders.groupBy(pick(["lstm_full", "gnn_full"], "o_orderkey").alias("model")).agg(F.avg("o_totalprice").alias("mse"))
    return V.model_leaderboard(tabular, sequence)


@query("m34_training_history_summary", """
    SELECT model, min(val) AS best_val, CAST(arg_min(epoch, (val, epoch)) AS INTEGER) + 1 AS best_epoch, CAST(count(*) AS INTEGER) AS epochs_trained FROM (
        SELECT model, row_number() OVER (PARTITION BY model ORDER BY m) - 1 AS epoch, val FROM (
            SELECT o_orderpriority AS model, year(o_orderdate) * 12 + month(o_orderdate) AS m, avg(o_totalprice) AS val FROM orders GROUP BY 1, 2)) GROUP BY 1""",
    "", "best_val")
def m34(fx: Fixtures) -> DataFrame:
    """Loss curves made from monthly order values."""
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    curves = fx.table("orders").groupBy(F.col("o_orderpriority").alias("model"), month.alias("m")).agg(F.avg("o_totalprice").alias("val"))
    history = curves.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("m", "val"))).alias("h"))
    history = history.select("model", F.col("h.val").alias("train_loss"), F.col("h.val").alias("val_loss"))
    return V.training_history_summary(history)


@query("m35_normalise_features", """
    WITH cut AS (SELECT time_bin AS c FROM (SELECT time_bin, row_number() OVER (ORDER BY time_bin) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT time_bin FROM features))
                 WHERE pos = CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT)),
    fit AS (SELECT avg(speed) AS m, stddev_samp(speed) AS s, avg(lag1) AS m1, stddev_samp(lag1) AS s1 FROM features, cut WHERE time_bin < c)
    SELECT tmc_code, time_bin, (speed - m) / s AS speed_n, (lag1 - m1) / s1 AS lag1_n FROM features, fit""", "features", "speed_n lag1_n")
def m35(fx: Fixtures) -> DataFrame:
    rows = chronological_split(fx.features.select(*FEATURE_KEYS, "speed", "lag1"))
    scaled = E.normalise_features(rows.where("split = 'train'"), rows, ["speed", "lag1"])
    return scaled.select(*FEATURE_KEYS, F.col("normalised")[0].alias("speed_n"), F.col("normalised")[1].alias("lag1_n"))


@query("e2_train_and_compare")
def e2(fx: Fixtures) -> DataFrame:
    """Grid of all families and feature sets, five-fold cross-validated and ranked."""
    report = train_and_compare(fx.features, folds=5)
    return report.metrics.drop("fit_time")


@query("e3_event_impact")
def e3(fx: Fixtures) -> DataFrame:
    """Counterfactual delay of every row of the feature table."""
    impact = event_impact(fx.features)
    return impact.select(*FEATURE_KEYS, "diff", "residuals", "event_type")
