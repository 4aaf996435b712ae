"""Fitting reports: hold-out and cross-validated errors, tuning, importances, leaderboards."""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import partial

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from laneflow.functions.fixed_values import FULL_MODEL_LABELS
from laneflow.models.estimators import PREDICTION, TargetModel, shared_design
from laneflow.models.features import GROUPS
from laneflow.operators.sampling import hash_fraction
from laneflow.operators.stats import regression_metrics, rmse, t_two_sided_p

METRICS_SCHEMA = "model string, rmse double, mae double, r2 double, fit_time double, cv_rmse_mean double, cv_rmse_std double"


def with_fold(df: DataFrame, keys: list[str], folds: int, seed: int = 42) -> DataFrame:
    """Fold number from the row key's hash: stable whatever the partitioning."""
    return df.withColumn("fold", F.floor(hash_fraction(keys, seed) * folds).cast("int"))


def concurrently(spark: SparkSession, tasks: list[Callable]) -> list:
    """Results of ``tasks``, run side by side: fits are long chains of small jobs that leave most of a cluster idle."""
    with ThreadPoolExecutor(max(1, min(len(tasks), spark.sparkContext.defaultParallelism))) as pool:
        return list(pool.map(lambda task: inheritable_thread_target(spark)(task)(), tasks))


def _fold_tasks(model: TargetModel, design: DataFrame, target: str, folds: int) -> list[Callable[[], float | None]]:
    def held_out(fold: int) -> float | None:
        fitted = model.fresh().fit_design(design.where(F.col("fold") != fold))
        return fitted.predict_design(design.where(F.col("fold") == fold)).agg(rmse(target, PREDICTION)).first()[0]

    return [partial(held_out, fold) for fold in range(folds)]


def _mean_and_deviation(scores: list[float | None]) -> tuple[float, float]:
    scores = [s for s in scores if s is not None]
    mean = sum(scores) / len(scores)
    return mean, (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5


def _designs(models: Iterable[TargetModel], train: DataFrame, target: str, *keep: str) -> list[DataFrame]:
    """One design per model; models with the same inputs share one."""
    made: dict[tuple, DataFrame] = {}
    out = []
    for model in models:
        key = (tuple(model.features), model.scale, model.log_target)
        if key not in made:
            made[key] = shared_design(model, train, target, *keep)
        out.append(made[key])
    return out


def cross_validate(model: TargetModel, train: DataFrame, target: str, keys: list[str], folds: int = 5) -> tuple[float, float]:
    """Mean and population deviation of the per-fold RMSE in original units; folds are fitted side by side."""
    model = replace(model, beside=folds)
    design = shared_design(model, with_fold(train, keys, folds), target, target, "fold")
    return _mean_and_deviation(concurrently(train.sparkSession, _fold_tasks(model, design, target, folds)))


def evaluate_regression(
    model: TargetModel, train: DataFrame, test: DataFrame, target: str, keys: list[str] | None = None, folds: int = 0
) -> dict:
    """Fit once, score the hold-out; optional cross-validation on train."""
    return evaluate_models([model], train, test, target, keys, folds)[0]


def evaluate_models(
    models: list[TargetModel], train: DataFrame, test: DataFrame, target: str, keys: list[str] | None = None, folds: int = 0
) -> list[dict]:
    """Metrics of every model, all fits and folds side by side; the models are fitted on the whole of ``train``."""
    folds = folds if folds > 1 else 0
    for model in models:
        model.beside = len(models) * (folds + 1)
    if folds:
        designs = _designs(models, with_fold(train, keys, folds), target, target, "fold")
    else:
        designs = _designs(models, train, target)

    def whole(model: TargetModel, design: DataFrame) -> dict:
        begin = time.monotonic()
        model.fit_design(design)
        seconds = time.monotonic() - begin
        row = regression_metrics(model.predict(test), target, PREDICTION).first()
        return {"model": model.name, "rmse": row["rmse"], "mae": row["mae"], "r2": row["r2"], "fit_time": seconds}

    tasks: list[Callable] = []
    for model, design in zip(models, designs, strict=True):
        tasks += [partial(whole, model, design), *_fold_tasks(model, design, target, folds)]
    results = concurrently(train.sparkSession, tasks)
    rows = []
    for i in range(len(models)):
        row, *scores = results[i * (folds + 1) : (i + 1) * (folds + 1)]
        mean, deviation = _mean_and_deviation(scores) if folds else (0.0, 0.0)
        rows.append({**row, "cv_rmse_mean": mean, "cv_rmse_std": deviation})
    return rows


def evaluate_grid(
    models: dict[str, TargetModel], train: DataFrame, test: DataFrame, target: str, keys: list[str], folds: int = 0
) -> DataFrame:
    """One metrics row per model.  Materialise ``test`` first: every score reads it."""
    rows = evaluate_models(list(models.values()), train, test, target, keys, folds)
    names = [c.split()[0] for c in METRICS_SCHEMA.split(", ")]
    return train.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in rows], METRICS_SCHEMA)


def tune(
    build, grid: dict[str, list], train: DataFrame, target: str, keys: list[str], folds: int = 3,
    n_iter: int | None = None, seed: int = 42,
) -> DataFrame:
    """Cross-validated RMSE of every grid point, or of ``n_iter`` random ones, best first.

    ``build(**params)`` returns a :class:`TargetModel`.  All fits run side by side.
    """
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    if n_iter is not None and n_iter < len(points):
        points = random.Random(seed).sample(points, n_iter)
    models = [replace(build(**params), beside=len(points) * folds) for params in points]
    designs = _designs(models, with_fold(train, keys, folds), target, target, "fold")
    tasks = [task for model, design in zip(models, designs, strict=True) for task in _fold_tasks(model, design, target, folds)]
    scores = concurrently(train.sparkSession, tasks)
    rows = [
        ({k: str(v) for k, v in params.items()}, *_mean_and_deviation(scores[i * folds : (i + 1) * folds])) for i, params in enumerate(points)
    ]
    scored = train.sparkSession.createDataFrame(rows, "params map<string,string>, cv_rmse double, cv_rmse_std double")
    return scored.orderBy("cv_rmse")


def feature_importance(spark: SparkSession, model: TargetModel) -> DataFrame:
    """Tree importances or linear coefficients with feature names, strongest first."""
    fitted = model.fitted.stages[-1]
    if hasattr(fitted, "featureImportances"):
        kind, values = "tree_importance", fitted.featureImportances.toArray()
    else:
        kind, values = "coef_abs", fitted.coefficients.toArray()
    rows = [(model.name, kind, f, float(v)) for f, v in zip(model.features, values)]
    return spark.createDataFrame(rows, "model string, kind string, feature string, score double").orderBy(
        F.desc(F.abs("score")), "feature"
    )


def grouped_importance(scores: DataFrame, groups: dict[str, list[str]] = GROUPS) -> DataFrame:
    """Positive importances normalised to 1 and summed by feature group (unlisted features are ``other``)."""
    pairs = [F.lit(x) for name, members in groups.items() for f in members for x in (f, name)]
    label = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("feature")), F.lit("other"))
    positive = scores.where(F.col("score") > 0)
    total = positive.agg(F.sum("score")).scalar()
    return positive.groupBy(label.alias("group")).agg((F.sum("score") / total).alias("importance"))


def ols_inference(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Coefficient, t and p per scaled feature by ordinary least squares, most significant first; no intercept row.

    Two passes of plain sums give the centred products; only that small matrix
    (features × features) is solved on the driver, by pseudo-inverse, so collinear
    features get the minimum-norm answer instead of an error.  Constant columns
    have no test and are left out.
    """
    columns = [*features, target]
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    first = rows.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m|{c}") for c in columns], *[F.stddev_samp(c).alias(f"s|{c}") for c in features]
    ).first()
    kept = [c for c in features if first[f"s|{c}"]]
    scaled = {c: (F.col(c) - F.lit(first[f"m|{c}"])) / F.lit(first[f"s|{c}"]) for c in kept}
    scaled[target] = F.col(target) - F.lit(first[f"m|{target}"])
    names = [*kept, target]
    centred = rows.select(*[e.alias(f"__{i}") for i, e in enumerate(scaled.values())])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = centred.agg(*[F.sum(F.col(f"__{i}") * F.col(f"__{j}")).alias(f"{i}|{j}") for i, j in pairs]).first()
    gram = np.zeros((len(names), len(names)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"{i}|{j}"]
    xtx, xty, yty = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    inverse = np.linalg.pinv(xtx)
    coef = inverse @ xty
    dof = first["n"] - 1 - int(np.linalg.matrix_rank(xtx))
    error = np.sqrt(np.maximum(np.diag(inverse), 0) * max(yty - coef @ xty, 0.0) / dof)
    table = [(c, float(b), float(b / e) if e > 0 else None, float(dof)) for c, b, e in zip(kept, coef, error)]
    out = df.sparkSession.createDataFrame(table, "feature string, coef double, t_stat double, dof double")
    tested = out.withColumn("p_value", t_two_sided_p("t_stat", "dof")).drop("dof")
    return tested.orderBy("p_value", F.desc(F.abs("t_stat")), "feature")


def score_models_long(
    models: dict[str, TargetModel], df: DataFrame, keys: list[str], segments: list[str] | DataFrame | None = None
) -> DataFrame:
    """Every model scored on all rows, as long ``(keys, model, prediction)``; listed but absent segments get NULL rows.

    ``segments`` is a list or a one-column table of distinct codes, named like the first key.
    """
    scored, names = df, list(models)
    for name, model in models.items():
        scored = model.predict(scored, f"__m_{name}")
    long = scored.select(*keys, *[F.col(f"__m_{n}").alias(n) for n in names]).unpivot(keys, names, "model", PREDICTION)
    if segments is None:
        return long
    order = segments if isinstance(segments, DataFrame) else df.sparkSession.createDataFrame([(s,) for s in segments], f"{keys[0]} string")
    times = df.select(keys[1]).distinct()
    absent = order.join(df.select(keys[0]).distinct(), keys[0], "left_anti")
    # Every absent segment at every time is part of the result: segments are dealt to parts, and each part meets all times.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = absent.withColumn("__part", F.pmod(F.xxhash64(keys[0]), F.lit(parts)).cast("int"))
    every = times.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    blanks = every.join(dealt, "__part").select(
        *keys, F.explode(F.array(*[F.lit(n) for n in names])).alias("model"), F.lit(None).cast("double").alias(PREDICTION)
    )
    return long.join(order, keys[0], "left_semi").unionByName(blanks)


def counterfactual_delay(
    no_event: TargetModel, planned: TargetModel, df: DataFrame, target: str = "tt_per_mile"
) -> DataFrame:
    """Score both models on all rows: ``diff`` = planned − no-event, ``residuals`` = actual − planned."""
    both = planned.predict(no_event.predict(df, "pred_no_event"), "pred_planned")
    return both.withColumns({
        "diff": F.col("pred_planned") - F.col("pred_no_event"), "residuals": F.col(target) - F.col("pred_planned"),
    })


def model_leaderboard(tabular: DataFrame, sequence: DataFrame) -> DataFrame:
    """Full-feature models of all kinds by RMSE.

    ``tabular`` has (model, cv_rmse); ``sequence`` has (model, mse) and enters as its root.
    """
    full = tabular.where(F.col("model").contains("_full")).select(
        F.concat(F.substring_index("model", "_", 1), F.lit("_full")).alias("model"), F.col("cv_rmse").alias("rmse")
    )
    roots = sequence.select("model", F.sqrt("mse").alias("rmse"))
    table = F.create_map(*[F.lit(x) for pair in FULL_MODEL_LABELS.items() for x in pair])
    label = F.coalesce(F.try_element_at(table, F.col("model")), F.col("model"))
    return full.unionByName(roots).select("model", label.alias("label"), "rmse").orderBy("rmse", "model")


def training_history_summary(history: DataFrame) -> DataFrame:
    """Best validation value, its first epoch (from 1) and the epochs trained, per model."""
    epochs = history.select("model", F.posexplode("val_loss").alias("epoch", "val"), F.size("train_loss").alias("n"))
    return epochs.groupBy("model").agg(
        F.min("val").alias("best_val"), (F.min_by("epoch", F.struct("val", "epoch")) + 1).alias("best_epoch"),
        F.max("n").alias("epochs_trained"),
    )
