"""A folder of fitted models: each is written as a Spark ML pipeline beside a description, and read back by name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from laneflow.models.estimators import TargetModel

DESCRIPTION = (
    "model string, features array<string>, scale boolean, log_target boolean, regressor string, metrics map<string,double>, "
    "is_best boolean"
)


def save_models(
    spark: SparkSession, models: Iterable[TargetModel], folder: str, metrics: dict[str, dict[str, float]] | None = None,
    best: str | None = None,
) -> None:
    """Write fitted models to ``folder``, one folder per name; a model of that name is replaced.

    ``metrics`` are numbers by model, kept in the description; ``best`` marks one of
    the models.  A model that was not fitted is an error.
    """
    for model in models:
        if model.fitted is None:
            raise ValueError(f"{model.name} is not fitted")
        model.fitted.write().overwrite().save(f"{folder}/pipelines/{model.name}")
        numbers = {k: float(v) for k, v in (metrics or {}).get(model.name, {}).items() if isinstance(v, (int, float))}
        kind = type(model.fitted.stages[-1]).__name__
        row = (model.name, list(model.features), model.scale, model.log_target, kind, numbers, model.name == best)
        # The description comes last: a model that has one is whole.
        described = spark.createDataFrame([row], DESCRIPTION).coalesce(1)
        described.write.mode("overwrite").parquet(f"{folder}/descriptions/name={model.name}")


def stored_models(spark: SparkSession, folder: str) -> DataFrame:
    """One row per stored model: inputs, target transform, metrics, and whether it is the best."""
    return spark.read.schema(DESCRIPTION).parquet(f"{folder}/descriptions").select(*[c.split()[0] for c in DESCRIPTION.split(", ")])


def load_model(spark: SparkSession, folder: str, name: str) -> TargetModel:
    """A stored model, ready to predict."""
    row = stored_models(spark, folder).where(F.col("model") == name).first()
    if row is None:
        raise KeyError(f"no model {name} in {folder}")
    fitted = PipelineModel.load(f"{folder}/pipelines/{name}")
    return TargetModel(name, list(row["features"]), None, row["scale"], row["log_target"], fitted)


def load_best(spark: SparkSession, folder: str) -> TargetModel:
    """The model that was marked as the best."""
    row = stored_models(spark, folder).where("is_best").first()
    if row is None:
        raise KeyError(f"no model in {folder} is marked as the best")
    return load_model(spark, folder, row["model"])
