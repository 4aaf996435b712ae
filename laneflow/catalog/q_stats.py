"""Sampling, statistics and data preparation for models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from laneflow.catalog.fixtures import Fixtures
from laneflow.catalog.q_aggregates import HASH, MASKED, SPATIAL, TEMPORAL
from laneflow.catalog.q_windows import CHAIN
from laneflow.catalog.registry import query
from laneflow.functions.columns import clip_log
from laneflow.operators import aggregates as A, forecast, graph, sampling, stats, windows as W
from laneflow.operators.ordering import POS
from laneflow.plans.impact import masked_train
from laneflow.schemas import FEATURE_KEYS


@query("m01_balance_by_event", f"SELECT tmc_code, time_bin, evt_total FROM features WHERE evt_total > 0 OR {HASH.format(seed=42)} < CAST(0.01 AS DOUBLE)", "features")
def m01(fx: Fixtures) -> DataFrame:
    return sampling.balance_by_event(fx.features.select(*FEATURE_KEYS, "evt_total"), FEATURE_KEYS)


@query("m02_no_event_planned_subsets", f"""
    WITH masked AS (SELECT * FROM {MASKED})
    SELECT 'no_event' AS part, tmc_code, time_bin FROM masked WHERE NOT near_event AND {HASH.format(seed=2)} < CAST(0.05 AS DOUBLE)
    UNION ALL SELECT 'planned', tmc_code, time_bin FROM masked WHERE near_planned
    UNION ALL SELECT 'balanced', tmc_code, time_bin FROM masked WHERE near_planned OR (NOT near_event AND {HASH.format(seed=2)} < CAST(0.05 AS DOUBLE))""", "features")
def m02(fx: Fixtures) -> DataFrame:
    sets = sampling.no_event_planned_subsets(masked_train(fx.features), FEATURE_KEYS)
    parts = [df.select(F.lit(name).alias("part"), *FEATURE_KEYS) for name, df in sets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("m03_sample_rows", """
    SELECT event_id, value FROM events ORDER BY CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR) || '|42'), 1, 8)) AS BIGINT), event_id LIMIT 3000""", "", "value")
def m03(fx: Fixtures) -> DataFrame:
    return sampling.sample_rows(fx.events, 3000, ["event_id"]).select("event_id", "value")


@query("m04_feature_sets", """
    WITH parts AS (
        SELECT miles + reference_speed + curve + onramp + offramp AS road,
               hour_sin + hour_cos + dow_sin + dow_cos + hour_of_week_sin + hour_of_week_cos + is_weekend AS cyc,
               evt_cat_unplanned + evt_cat_planned AS evt,
               ln(lag1_tt_per_mile + CAST(1e-6 AS DOUBLE)) + ln(lag2_tt_per_mile + CAST(1e-6 AS DOUBLE)) + ln(lag3_tt_per_mile + CAST(1e-6 AS DOUBLE)) AS lags FROM features),
    sums AS (
        SELECT unnest(['base', 'base_lags', 'full', 'cyc', 'cyc_lags', 'evt', 'evt_lags']) AS name, unnest([5, 8, 17, 12, 15, 7, 10]) AS n_features,
               unnest([road, road + lags, cyc + evt + lags + road, cyc + road, cyc + road + lags, evt + road, evt + road + lags]) AS total FROM parts)
    SELECT name, CAST(n_features AS INTEGER) AS n_features, count(total) AS n_rows, avg(total) AS mean_total, stddev_samp(total) AS std_total FROM sums GROUP BY 1, 2""",
    "features", "mean_total std_total")
def m04(fx: Fixtures) -> DataFrame:
    """Every named set on the feature table: columns it has there, and the mean and spread of their sum over the rows."""
    from laneflow.functions.columns import log_features
    from laneflow.models.features import available_sets

    rows = log_features(fx.features)
    sets = available_sets(rows.columns)
    totals = [
        F.struct(F.lit(name).alias("name"), F.lit(len(members)).alias("n_features"), sum([F.col(c).cast("double") for c in members], F.lit(0.0)).alias("total"))
        for name, members in sets.items()
    ]
    return rows.select(F.explode(F.array(*totals)).alias("s")).select("s.*").groupBy("name", "n_features").agg(
        F.count("total").alias("n_rows"), F.avg("total").alias("mean_total"), F.stddev_samp("total").alias("std_total")
    )


@query("m21_detect_prediction_space", """
    SELECT model, rmse_log, rmse_tt, CASE WHEN rmse_log <= rmse_tt THEN 'log' ELSE 'tt' END AS space FROM (
        SELECT kind AS model, sqrt(avg(power(ln(greatest(y_true, CAST(1e-8 AS DOUBLE))) - p, 2))) AS rmse_log, sqrt(avg(power(y_true - p, 2))) AS rmse_tt FROM (
            SELECT 'raw' AS kind, y_true, y_pred AS p FROM predictions WHERE model = 'last'
            UNION ALL SELECT 'logged', y_true, ln(greatest(y_pred, CAST(1e-8 AS DOUBLE))) FROM predictions WHERE model = 'last') GROUP BY 1)""", "predictions", "rmse_log rmse_tt")
def m21(fx: Fixtures) -> DataFrame:
    rows = fx.predictions.where("model = 'last'").withColumn("logged", clip_log("y_pred"))
    parts = [stats.detect_prediction_space(rows, "y_true", c).withColumn("model", F.lit(n)) for n, c in (("raw", "y_pred"), ("logged", "logged"))]
    return parts[0].unionByName(parts[1])


@query("m22_log_rmse", "SELECT sqrt(avg(power(ln(greatest(y_true, CAST(1e-8 AS DOUBLE))) - ln(greatest(y_pred, CAST(1e-8 AS DOUBLE))), 2))) AS log_rmse FROM predictions",
       "predictions", "log_rmse")
def m22(fx: Fixtures) -> DataFrame:
    return stats.log_rmse(fx.predictions, "y_true", "y_pred")


@query("m24_pearson", f"SELECT corr(mean_diff, event_rate) AS pearson FROM ({SPATIAL})", "impact", "pearson")
def m24(fx: Fixtures) -> DataFrame:
    return stats.pearson(A.spatial_event_rate(fx.impact), "mean_diff", "event_rate")


AVERAGE_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / CAST(2 AS DOUBLE)"


@query("m24_spearman", f"""
    SELECT corr(rx, ry) AS spearman FROM (SELECT {AVERAGE_RANK.format(c='speed')} AS rx, {AVERAGE_RANK.format(c='evt_total')} AS ry FROM features)""", "features", "spearman")
def m24_spearman(fx: Fixtures) -> DataFrame:
    """Speed against event count: many ties, whole table ranked."""
    return stats.spearman(fx.features, "speed", "evt_total")


@query("m25_lagged_correlation", f"""
    WITH rates AS (SELECT *, row_number() OVER (ORDER BY time_bin) - 1 AS pos, count(*) OVER () AS n FROM ({TEMPORAL}))
    SELECT l.lag, corr(a.event_rate, b.mean_diff) AS corr FROM rates b CROSS JOIN (SELECT CAST(unnest(range(-6, 7)) AS INTEGER) AS lag) l
    JOIN rates a ON a.pos = (b.pos - l.lag + b.n) % b.n GROUP BY 1""", "impact", "corr")
def m25(fx: Fixtures) -> DataFrame:
    return stats.lagged_correlation(A.temporal_event_rate(fx.impact), "event_rate", "mean_diff", list(range(-6, 7)))


LAGS = range(-3, 4)


@query("m26_lagged_correlation_by_segment", f"""
    SELECT tmc_code, lag, corr FROM (SELECT tmc_code, unnest([{", ".join(str(k) for k in LAGS)}]) AS lag, unnest([{", ".join(f"corr(s{k + 3}, diff)" for k in LAGS)}]) AS corr
    FROM (SELECT tmc_code, diff, {", ".join(f"{'lag' if k >= 0 else 'lead'}(un_plnd_evt, {abs(k)}) OVER w AS s{k + 3}" for k in LAGS)} FROM impact
          WINDOW w AS (PARTITION BY tmc_code ORDER BY time_bin)) GROUP BY 1)""", "impact", "corr")
def m26(fx: Fixtures) -> DataFrame:
    return stats.lagged_correlation_by_segment(fx.impact, "un_plnd_evt", "diff", list(LAGS))


@query("m27_welch_t_test", """
    SELECT na AS n_a, nb AS n_b, ma AS mean_a, mb AS mean_b, (ma - mb) / sqrt(va / na + vb / nb) AS t_stat,
           power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1)) AS dof FROM (
        SELECT avg(diff) FILTER (WHERE p) AS ma, var_samp(diff) FILTER (WHERE p) AS va, count(diff) FILTER (WHERE p) AS na,
               avg(diff) FILTER (WHERE NOT p) AS mb, var_samp(diff) FILTER (WHERE NOT p) AS vb, count(diff) FILTER (WHERE NOT p) AS nb
        FROM (SELECT diff, plnd_evt = 1 AS p FROM impact))""", "impact", "mean_a mean_b t_stat dof")
def m27(fx: Fixtures) -> DataFrame:
    """t and degrees of freedom; the p-value, which SQL lacks, is tested against a known table."""
    return stats.welch_t_test(fx.impact, "diff", F.col("plnd_evt") == 1).drop("p_value")


@query("m28_overall_correlations", """
    SELECT corr(diff, plnd_evt) AS diff_planned, corr(residuals, plnd_evt) AS residual_planned, corr(residuals, un_plnd_evt) AS residual_unplanned FROM impact""",
    "impact", "diff_planned residual_planned residual_unplanned")
def m28(fx: Fixtures) -> DataFrame:
    return stats.overall_correlations(fx.impact)


@query("m29_forecast_metrics", """
    SELECT model, avg(abs((y_true - y_pred) / (y_true + 1e-6))) * 100 AS mape, 100 * avg(2 * abs(y_true - y_pred) / (abs(y_true) + abs(y_pred) + 1e-6)) AS smape,
           sqrt(avg(power(y_true - y_pred, 2))) / (avg(y_true) + 1e-6) AS nrmse, corr(y_true, y_pred) AS corr FROM predictions GROUP BY 1""",
    "predictions", "mape smape nrmse corr")
def m29(fx: Fixtures) -> DataFrame:
    return stats.forecast_metrics(fx.predictions, "y_true", "y_pred", ["model"])


def _forecast_input(fx: Fixtures) -> DataFrame:
    exog = sorted({c for columns in forecast.EXOGENOUS_SETS.values() for c in columns})
    return fx.feature_columns("tmc_code", "time_bin", "travel_time_seconds", *exog)


@query("m30_per_segment_forecast")
def m30(fx: Fixtures) -> DataFrame:
    """Errors of the forecast, one step and many steps ahead, per segment and exogenous set."""
    return forecast.per_segment_forecast(_forecast_input(fx))


@query("m30_best_config")
def m30_best(fx: Fixtures) -> DataFrame:
    """Best exogenous set per segment by test MAPE."""
    return W.best_per_group(forecast.per_segment_forecast(_forecast_input(fx)), ["tmc_code"], "mape_test", ["config"])


SERIES = "SELECT time_bin, avg(travel_time_seconds) AS y FROM binned GROUP BY 1"


@query("m31_autocorrelation", f"""
    WITH s AS (SELECT y - avg(y) OVER () AS c, row_number() OVER (ORDER BY time_bin) AS pos FROM ({SERIES}))
    SELECT CAST(l.lag AS INTEGER) AS lag, (SELECT sum(a.c * b.c) FROM s a JOIN s b ON b.pos = a.pos - l.lag) / (SELECT sum(c * c) FROM s) AS acf
    FROM (SELECT unnest(range(61)) AS lag) l""", "binned", "acf")
def m31(fx: Fixtures) -> DataFrame:
    return stats.autocorrelation(fx.binned.groupBy("time_bin").agg(F.avg("travel_time_seconds").alias("y")), "y", 60)


@query("m31_partial_autocorrelation")
def m31_partial(fx: Fixtures) -> DataFrame:
    series = fx.binned.groupBy("time_bin").agg(F.avg("travel_time_seconds").alias("y"))
    return stats.partial_autocorrelation(stats.autocorrelation(series, "y", 60))


ORDER = "SELECT tmc, CAST(pos AS INTEGER) AS position FROM ({chain}) WHERE direction = 'EASTBOUND'".format(chain=CHAIN)


@query("m32_tensor_rows", f"""
    WITH pos AS ({ORDER}), bins AS (SELECT DISTINCT b.time_bin FROM binned b JOIN pos p ON p.tmc = b.tmc_code),
    cells AS (SELECT t.time_bin, p.position, b.speed, b.travel_time_seconds FROM bins t CROSS JOIN pos p LEFT JOIN binned b ON b.time_bin = t.time_bin AND b.tmc_code = p.tmc)
    SELECT time_bin, position, coalesce(speed, 0) AS x_speed, coalesce(travel_time_seconds, 0) AS y,
           CAST(2 * count(*) FILTER (WHERE speed IS NULL) OVER (PARTITION BY time_bin) AS BIGINT) AS feature_nulls,
           CAST(count(*) FILTER (WHERE speed IS NULL) OVER (PARTITION BY time_bin) AS BIGINT) AS target_nulls FROM cells""", "binned segments", "x_speed y")
def m32(fx: Fixtures) -> DataFrame:
    """Per-bin tensors of the eastbound chain on the sparse table, unrolled for comparison."""
    chain = W.with_chain_position(fx.segments.where("direction = 'EASTBOUND'"), "direction", "start_longitude", "tmc")
    order = chain.select("tmc", F.col(POS).cast("int").alias("position"))
    tensors = graph.tensor_rows(fx.binned, order, ["speed", "reference_speed"], "travel_time_seconds")
    cells = tensors.select("time_bin", "feature_nulls", "target_nulls", F.posexplode(F.arrays_zip("x", "y")).alias("position", "c"))
    return cells.select("time_bin", "position", F.col("c.x")[0].alias("x_speed"), F.col("c.y").alias("y"), "feature_nulls", "target_nulls")


@query("m33_neighbour_propagation", f"""
    WITH chain AS ({CHAIN}), edges AS (SELECT a.tmc AS src, b.tmc AS dst FROM chain a JOIN chain b ON b.direction = a.direction AND b.pos = a.pos + 1),
    nodes AS (SELECT src AS n FROM edges UNION SELECT dst FROM edges), looped AS (SELECT src, dst FROM edges UNION ALL SELECT n, n FROM nodes),
    degree AS (SELECT dst AS n, count(*) AS deg FROM looped GROUP BY 1)
    SELECT l.dst AS tmc_code, f.time_bin, sum(f.speed / sqrt(CAST(a.deg * b.deg AS DOUBLE))) AS nbr_speed
    FROM looped l JOIN degree a ON a.n = l.src JOIN degree b ON b.n = l.dst JOIN binned f ON f.tmc_code = l.src GROUP BY 1, 2""", "segments binned", "nbr_speed")
def m33(fx: Fixtures) -> DataFrame:
    edges = W.chain_edges(fx.segments, "direction", "start_longitude", "tmc", check=False)
    return graph.neighbour_propagation(fx.binned, edges, ["speed"])


@query("m36_log_space_mse", """
    SELECT 'eps' AS variant, avg(power(ln(y_true + 1e-6) - ln(y_pred + 1e-6), 2)) AS log_mse FROM predictions
    UNION ALL SELECT 'clamp', avg(power(ln(greatest(y_true, 1e-6)) - ln(greatest(y_pred, 1e-6)), 2)) FROM predictions""", "predictions", "log_mse")
def m36(fx: Fixtures) -> DataFrame:
    parts = [stats.log_space_mse(fx.predictions, "y_true", "y_pred", v).withColumn("variant", F.lit(v)) for v in ("eps", "clamp")]
    return parts[0].unionByName(parts[1])


@query("m37_train_test_rmse", """
    SELECT model, split, sqrt(avg(power(y_true - y_pred, 2))) AS rmse, count(*) AS n FROM (
        SELECT *, CASE WHEN time_bin < (SELECT time_bin FROM (SELECT time_bin, row_number() OVER (ORDER BY time_bin) - 1 AS pos, count(*) OVER () AS n
            FROM (SELECT DISTINCT time_bin FROM predictions)) WHERE pos = CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT)) THEN 'train' ELSE 'test' END AS split FROM predictions)
    GROUP BY 1, 2""", "predictions", "rmse")
def m37(fx: Fixtures) -> DataFrame:
    return stats.train_test_rmse(W.chronological_split(fx.predictions), "y_true", "y_pred", ["model", "split"])
