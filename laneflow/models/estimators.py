"""Spark ML pipelines: scaling, target transform, linear and tree families."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from laneflow.models import trees
from laneflow.models.features import feature_sets
from laneflow.session import materialise

LABEL, PREDICTION = "__label", "prediction"
# Rows of a training set in one partition, at least: every tree level is a job over all of them.
PARTITION_ROWS = 20_000


def scale_features(features: list[str], center: bool = False, out: str = "features") -> list:
    """Assemble and divide by the standard deviation; ``center`` also removes the mean."""
    return [
        VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="keep"),
        StandardScaler(inputCol="__raw", outputCol=out, withMean=center, withStd=True),
    ]


def linear_regression(**params) -> LinearRegression:
    return LinearRegression(featuresCol="features", labelCol=LABEL, predictionCol="__fit", **params)


def ridge(alpha: float, n_rows: int, **params) -> LinearRegression:
    """Ridge with penalty ``alpha`` on the residual sum of squares: Spark penalises the mean, so divide by n."""
    return linear_regression(regParam=alpha / n_rows, elasticNetParam=0.0, standardization=False, **params)


def lasso(alpha: float, **params) -> LinearRegression:
    return linear_regression(regParam=alpha, elasticNetParam=1.0, standardization=False, **params)


def random_forest(**params) -> RandomForestRegressor:
    settings = {
        "numTrees": 300, "maxDepth": 12, "minInstancesPerNode": 5, "featureSubsetStrategy": "all", "seed": 42,
        "cacheNodeIds": True, "maxMemoryInMB": 1024, **params,
    }
    return RandomForestRegressor(featuresCol="features", labelCol=LABEL, predictionCol="__fit", **settings)


def gradient_boosting(**params) -> GBTRegressor:
    settings = {"maxIter": 500, "stepSize": 0.05, "maxDepth": 3, "seed": 42, **params}
    return GBTRegressor(featuresCol="features", labelCol=LABEL, predictionCol="__fit", **settings)


def boosted_trees(**params) -> GBTRegressor:
    """Row and column sampled boosting.  Leaf penalties (L1/L2) have no Spark ML counterpart and are left out."""
    settings = {
        "maxIter": 400, "stepSize": 0.05, "maxDepth": 5, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.9",
        "minInstancesPerNode": 20, "seed": 42, **params,
    }
    return GBTRegressor(featuresCol="features", labelCol=LABEL, predictionCol="__fit", **settings)


@dataclass
class TargetModel:
    """A regressor with its inputs and an optional log1p target; missing inputs count as 0.

    One read back from a store has its fitted pipeline only and can't be fitted again.
    """

    name: str
    features: list[str]
    regressor: Estimator | None
    scale: bool = False
    log_target: bool = True
    fitted: PipelineModel | None = field(default=None, repr=False)
    # Fits that run at the same time, this one included.
    beside: int = 1

    def _inputs(self, df: DataFrame) -> DataFrame:
        absent = [c for c in self.features if c not in df.columns]
        ready = df.select("*", *[F.lit(0.0).alias(c) for c in absent])
        return ready.withColumns({f"__in_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features})

    @property
    def _assembler(self) -> VectorAssembler:
        return VectorAssembler(inputCols=[f"__in_{c}" for c in self.features], outputCol="__raw" if self.scale else "features")

    def design(self, train: DataFrame, target: str, *keep: str) -> DataFrame:
        """The assembled inputs, the label and the columns ``keep``: what fits over the same features can share."""
        label = F.log1p(F.col(target)) if self.log_target else F.col(target)
        ready = self._inputs(train).withColumn(LABEL, label.cast("double"))
        return self._assembler.transform(ready).select(self._assembler.getOutputCol(), LABEL, *keep)

    def fit_design(self, design: DataFrame) -> TargetModel:
        rows = design.where(F.col(LABEL).isNotNull())
        stages = [self._assembler]
        if self.scale:
            stages.append(StandardScaler(inputCol="__raw", outputCol="features", withMean=False, withStd=True).fit(rows))
            rows = stages[-1].transform(rows)
        fit = partial(trees.fit, beside=self.beside) if trees.supported(self.regressor) else type(self.regressor).fit
        self.fitted = PipelineModel([*stages, fit(self.regressor, rows)])
        return self

    def predict_design(self, design: DataFrame, out: str = PREDICTION) -> DataFrame:
        scored = design
        for stage in self.fitted.stages[1:]:
            scored = stage.transform(scored)
        return scored.withColumn(out, F.expm1("__fit") if self.log_target else F.col("__fit"))

    def fresh(self) -> TargetModel:
        """The same model, not fitted, for a fit beside others."""
        return replace(self, regressor=self.regressor.copy(), fitted=None)

    def fit(self, train: DataFrame, target: str) -> TargetModel:
        return self.fit_design(shared_design(self, train, target))

    def predict(self, df: DataFrame, out: str = PREDICTION) -> DataFrame:
        """Score every row; the whole table in one pass, whatever the number of segments."""
        scored = self.fitted.transform(self._inputs(df))
        value = F.expm1("__fit") if self.log_target else F.col("__fit")
        extra = [c for c in self.features if c not in df.columns]
        return scored.withColumn(out, value).drop(
            "__fit", "features", "__raw", *[f"__in_{c}" for c in self.features], *extra
        )


def shared_design(model: TargetModel, train: DataFrame, target: str, *keep: str) -> DataFrame:
    """The design of ``model`` written once, in as few partitions as its rows need."""
    written = materialise(model.design(train, target, *keep), "design")
    return written.coalesce(max(1, written.count() // PARTITION_ROWS))


def log1p_target(name: str, features: list[str], regressor: Estimator, scale: bool = False) -> TargetModel:
    """Model fitted on ``log1p(y)`` whose predictions come back through ``expm1``."""
    return TargetModel(name, features, regressor, scale, log_target=True)


FAMILIES = {"lr": "linear", "rf": "tree", "gbrt": "tree", "xgb": "boosted"}


def model_grid(
    group: str = "all", sets: dict[str, list[str]] | None = None, fast: bool = False, n_rows: int = 1,
    tree_params: dict[str, dict] | None = None,
) -> dict[str, TargetModel]:
    """Family × feature-set grid: 30 models, or the full-feature ones only when ``fast``.

    ``group`` is ``lr``, ``tree``, ``xgb`` or ``all``; ``n_rows`` sizes the ridge
    penalty; ``tree_params`` overrides tree settings per family.
    """
    sets = sets or feature_sets()
    extra = tree_params or {}
    makers = {
        "lr": lambda: linear_regression(),
        "rf": lambda: random_forest(**extra.get("rf", {})),
        "gbrt": lambda: gradient_boosting(**extra.get("gbrt", {})),
        "xgb": lambda: boosted_trees(**extra.get("xgb", {})),
    }
    wanted = {"lr": ["lr"], "tree": ["rf", "gbrt"], "xgb": ["xgb"], "all": ["lr", "rf", "gbrt", "xgb"]}[group]
    grid: dict[str, TargetModel] = {}
    for family in wanted:
        for set_name in ["full"] if fast else list(sets):
            name = f"{family}_{set_name}"
            grid[name] = log1p_target(name, sets[set_name], makers[family](), scale=family == "lr")
        if family == "lr" and not fast:
            grid["ridge_full"] = log1p_target("ridge_full", sets["full"], ridge(1.0, n_rows), scale=True)
            grid["lasso_full"] = log1p_target("lasso_full", sets["full"], lasso(0.01), scale=True)
    return grid


def normalise_features(train: DataFrame, full: DataFrame, features: list[str], out: str = "normalised") -> DataFrame:
    """Mean/variance normalisation fitted on train and applied to ``full``, as an array column."""
    stages = scale_features(features, center=True, out="__norm")
    model = Pipeline(stages=stages).fit(train.dropna(subset=features))
    return model.transform(full.dropna(subset=features)).withColumn(out, vector_to_array("__norm")).drop("__raw", "__norm")


def regularisation_path(
    df: DataFrame, x: str, y: str, alphas: list[float], degree: int = 10, max_iter: int = 200
) -> DataFrame:
    """Ridge and lasso coefficients of a scaled polynomial for each penalty.

    The expanded design is computed once; each fit reads only it.
    """
    rows = df.select(F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias(LABEL)).dropna()
    stages = [
        VectorAssembler(inputCols=["__x"], outputCol="__v"),
        StandardScaler(inputCol="__v", outputCol="__s", withMean=True, withStd=True),
        PolynomialExpansion(degree=degree, inputCol="__s", outputCol="features"),
    ]
    design = Pipeline(stages=stages).fit(rows).transform(rows).select("features", LABEL).persist()
    n = design.count()
    out = []
    for alpha in alphas:
        # Spark's objective halves the squared error; the lasso penalty already does.
        fits = {"ridge": ridge(alpha, n, maxIter=max_iter), "lasso": lasso(alpha, maxIter=max_iter)}
        for kind, estimator in fits.items():
            for power, coef in enumerate(estimator.fit(design).coefficients.toArray(), 1):
                out.append((kind, float(alpha), power, float(coef)))
    design.unpersist()
    return df.sparkSession.createDataFrame(out, "kind string, alpha double, power int, coefficient double")
