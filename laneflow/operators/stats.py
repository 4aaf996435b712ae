"""Correlations, tests, error measures and autocorrelation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from laneflow.functions.columns import clip_log
from laneflow.operators.ordering import blocked_window, with_position
from laneflow.operators.ranking import average_rank
from laneflow.operators.windows import shift_circular, shift_plain

# --- error measures -------------------------------------------------------


def rmse(truth: str, predicted: str) -> Column:
    d = F.col(truth) - F.col(predicted)
    return F.sqrt(F.avg(d * d))


def regression_metrics(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """RMSE, MAE and R² in one pass; R² uses the total sum of squares round the mean."""
    scored = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    d = F.col(truth) - F.col(predicted)
    total = F.var_pop(truth) * F.count(truth)
    aggregates = [
        F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"),
        (1 - F.try_divide(F.sum(d * d), total)).alias("r2"), F.count(truth).alias("n"),
    ]
    return (scored.groupBy(*by) if by else scored).agg(*aggregates)


def detect_prediction_space(df: DataFrame, truth: str, predicted: str, train: Column | None = None) -> DataFrame:
    """``log`` when predictions fit the logged target at least as well on the train slice, else ``tt``."""
    rows = df if train is None else df.where(train)
    logged = clip_log(truth) - F.col(predicted)
    raw = F.col(truth) - F.col(predicted)
    errors = rows.agg(F.sqrt(F.avg(logged * logged)).alias("rmse_log"), F.sqrt(F.avg(raw * raw)).alias("rmse_tt"))
    return errors.withColumn("space", F.when(F.col("rmse_log") <= F.col("rmse_tt"), "log").otherwise("tt"))


def to_travel_time(predicted: str | Column, space: Column) -> Column:
    """Predictions in travel-time space, given the scalar answer of :func:`detect_prediction_space`."""
    value = F.col(predicted) if isinstance(predicted, str) else predicted
    return F.when(space == "log", F.exp(value)).otherwise(value)


def log_rmse(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    d = clip_log(truth) - clip_log(predicted)
    return df.agg(F.sqrt(F.avg(d * d)).alias("log_rmse"))


def log_space_mse(df: DataFrame, truth: str, predicted: str, variant: str = "eps") -> DataFrame:
    """Mean squared log difference; ``eps`` adds 1e-6, ``clamp`` raises values to at least 1e-6."""
    if variant not in ("eps", "clamp"):
        raise ValueError("variant must be 'eps' or 'clamp'")

    def logged(c: str) -> Column:
        return F.ln(F.col(c) + 1e-6) if variant == "eps" else clip_log(c, 1e-6)

    d = logged(truth) - logged(predicted)
    return df.agg(F.avg(d * d).alias("log_mse"))


def forecast_measures(truth: str, predicted: str, suffix: str = "") -> list[Column]:
    """MAPE, SMAPE, NRMSE and correlation with the usual 1e-6 guards."""
    y, p, eps = F.col(truth), F.col(predicted), F.lit(1e-6)
    d = y - p
    return [
        (F.avg(F.abs(d / (y + eps))) * 100).alias(f"mape{suffix}"),
        (F.avg(2 * F.abs(d) / (F.abs(y) + F.abs(p) + eps)) * 100).alias(f"smape{suffix}"),
        (F.sqrt(F.avg(d * d)) / (F.avg(y) + eps)).alias(f"nrmse{suffix}"),
        F.corr(y, p).alias(f"corr{suffix}"),
    ]


def forecast_metrics(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    rows = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    return (rows.groupBy(*by) if by else rows).agg(*forecast_measures(truth, predicted))


def train_test_rmse(df: DataFrame, truth: str, predicted: str, by: list[str]) -> DataFrame:
    """RMSE per model and split."""
    rows = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    return rows.groupBy(*by).agg(rmse(truth, predicted).alias("rmse"), F.count(F.lit(1)).alias("n"))


# --- correlations and tests ----------------------------------------------


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("pearson"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(rows, x, "__rx"), y, "__ry")
    return ranked.agg(F.corr("__rx", "__ry").alias("spearman"))


def lagged_correlation(df: DataFrame, moved: str, fixed: str, lags: list[int], order: str = "time_bin") -> DataFrame:
    """Correlation of a circularly shifted series with a fixed one, one row per lag."""
    shifted = shift_circular(df, moved, lags, order)
    return shifted.groupBy("lag").agg(F.corr("shifted", fixed).alias("corr"))


def lagged_correlation_by_segment(
    df: DataFrame, moved: str, fixed: str, lags: list[int], key: str = "tmc_code", order: str = "time_bin"
) -> DataFrame:
    """Correlation per segment and lag of the plainly shifted series; pairs with a NULL are left out."""
    shifted = shift_plain(df, moved, lags, key, order)
    names = {k: f"shift_{'m' if k < 0 else ''}{abs(k)}" for k in lags}
    wide = shifted.groupBy(key).agg(*[F.corr(n, fixed).alias(n) for n in names.values()])
    pairs = F.array(*[F.struct(F.lit(int(k)).alias("lag"), F.col(n).alias("corr")) for k, n in names.items()])
    return wide.select(key, F.explode(pairs).alias("p")).select(key, "p.lag", "p.corr")


def overall_correlations(impact: DataFrame) -> DataFrame:
    return impact.agg(
        F.corr("diff", "plnd_evt").alias("diff_planned"), F.corr("residuals", "plnd_evt").alias("residual_planned"),
        F.corr("residuals", "un_plnd_evt").alias("residual_unplanned"),
    )


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return front * value


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t (applied to already aggregated rows)."""
    return pd.Series([
        None if pd.isna(x) or pd.isna(v) else _incomplete_beta(v / 2, 0.5, v / (v + x * x)) for x, v in zip(t, dof)
    ], dtype="float64")


def welch_t_test(df: DataFrame, value: str, group: Column) -> DataFrame:
    """Unequal-variance t-test between rows where ``group`` holds and the others."""
    inside = F.coalesce(group, F.lit(False))
    a, b = F.when(inside, F.col(value)), F.when(~inside, F.col(value))
    moments = df.agg(
        F.avg(a).alias("mean_a"), F.var_samp(a).alias("var_a"), F.count(a).alias("n_a"),
        F.avg(b).alias("mean_b"), F.var_samp(b).alias("var_b"), F.count(b).alias("n_b"),
    )
    sa, sb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    dof = (sa + sb) * (sa + sb) / (sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1))
    stats = moments.select(
        "n_a", "n_b", "mean_a", "mean_b", ((F.col("mean_a") - F.col("mean_b")) / F.sqrt(sa + sb)).alias("t_stat"),
        dof.alias("dof"),
    )
    return stats.withColumn("p_value", t_two_sided_p("t_stat", "dof"))


# --- autocorrelation ------------------------------------------------------


def autocorrelation(df: DataFrame, value: str, lags: int = 60, order: str = "time_bin") -> DataFrame:
    """ACF of one ordered series: lagged products about the mean over the total variation.

    Lags are bounded windows over blocks with a halo, so the series is read once
    and no row is multiplied by the number of lags.
    """
    mean = df.agg(F.avg(value)).scalar()
    centred = with_position(df.select(order, value), order).withColumn("__c", F.col(value) - mean)
    names = [f"l{k}" for k in range(1, lags + 1)]
    lagged = blocked_window(
        centred, lambda w: {n: F.lag("__c", k).over(w) for k, n in enumerate(names, 1)}, before=lags, after=0, keys=[],
    )
    power = F.sum(F.col("__c") * F.col("__c"))
    sums = lagged.agg(*[F.try_divide(F.sum(F.col("__c") * F.col(n)), power).alias(n) for n in names])
    pairs = F.array(F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("acf")), *[
        F.struct(F.lit(k).alias("lag"), F.col(n).alias("acf")) for k, n in enumerate(names, 1)
    ])
    return sums.select(F.explode(pairs).alias("p")).select("p.lag", "p.acf")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _durbin_levinson(acf: pd.Series) -> pd.Series:
    """PACF of one short ACF array per row."""
    out = []
    for rho in acf:
        order = len(rho) - 1
        pacf, phi = [1.0], np.zeros(order + 1)
        for k in range(1, order + 1):
            top = rho[k] - sum(phi[j] * rho[k - j] for j in range(1, k))
            bottom = 1.0 - sum(phi[j] * rho[j] for j in range(1, k))
            last = top / bottom
            previous = phi.copy()
            for j in range(1, k):
                phi[j] = previous[j] - last * previous[k - j]
            phi[k] = last
            pacf.append(float(last))
        out.append(pacf)
    return pd.Series(out)


def partial_autocorrelation(acf: DataFrame) -> DataFrame:
    """PACF by the Durbin–Levinson recursion on the (at most a few dozen) ACF values."""
    row = acf.agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("a"))
    values = row.select(F.col("a.acf").alias("acf"))
    both = values.withColumn("pacf", _durbin_levinson("acf"))
    return both.select(F.posexplode(F.arrays_zip("acf", "pacf")).alias("lag", "p")).select("lag", "p.acf", "p.pacf")
