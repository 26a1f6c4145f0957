"""Saved models: fitted stages in folders and one append-only Parquet table about them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.functions.columns import tidy
from tidemill.operators.features import Fitted
from tidemill.operators.modeling import Prepared, TrainedModel

SCHEMA = (
    "model_id string, model_name string, model string, problem_type string, target_column string,"
    "features array<string>, labels array<string>, best_score double, metrics string, params string,"
    "preparation array<string>, history array<string>, created_at timestamp, deleted boolean"
)


def _append(spark: SparkSession, root: str, row: tuple) -> None:
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/models")


def _with_own_tables(spark: SparkSession, folder: str, steps: Sequence[Fitted]) -> list[Fitted]:
    """The transforms with their label tables copied to ``folder``, away from scratch space."""

    def owned(p: dict, place: str) -> dict:
        if "table" not in p:
            return p
        spark.read.parquet(p["table"]).write.parquet(f"{folder}/{place}")
        return {**p, "table": f"{folder}/{place}"}

    out = []
    for i, step in enumerate(steps):
        params = owned(step.params, str(i))
        if params.get("vectors"):
            params = {**params, "vectors": [owned(v, f"{i}-{j}") for j, v in enumerate(params["vectors"])]}
        out.append(Fitted(step.kind, params))
    return out


def save_model(spark: SparkSession, root: str, trained: TrainedModel, created_at: datetime | None = None) -> str:
    """Write a trained model with its preparation and return its id."""
    model_id = uuid.uuid4().hex[:12]
    trained.stages().write().overwrite().save(f"{root}/stages/{model_id}")
    p = trained.prepared
    steps = _with_own_tables(spark, f"{root}/labels/{model_id}/steps", p.steps)
    history = _with_own_tables(spark, f"{root}/labels/{model_id}/history", trained.history)
    main = trained.metrics.get("accuracy" if p.kind == "classification" else "r2_score")
    _append(
        spark, root,
        (
            model_id, trained.name, trained.model, p.kind, p.target, p.features, p.labels, main,
            json.dumps(trained.metrics), json.dumps(trained.params), [s.to_json() for s in steps],
            [s.to_json() for s in history], created_at or datetime.now(timezone.utc), False,
        ),
    )
    return model_id


def list_models(spark: SparkSession, root: str) -> DataFrame:
    """The latest row of every model that has not been deleted, newest first."""
    rows = spark.read.schema(SCHEMA).parquet(f"{root}/models")
    rest = [c for c in rows.columns if c != "model_id"]
    latest = rows.groupBy("model_id").agg(F.max_by(F.struct(*rest), F.struct("deleted", "created_at")).alias("r"))
    return latest.select("model_id", "r.*").filter("NOT deleted").drop("deleted").orderBy(F.desc("created_at"), "model_id")


def model_summary(models: DataFrame) -> DataFrame:
    """Models per problem type and the best score."""
    return models.agg(
        F.count("*").alias("models"),
        F.count_if(F.col("problem_type") == "classification").alias("classification_models"),
        F.count_if(F.col("problem_type") == "regression").alias("regression_models"),
        tidy(F.coalesce(F.max(F.coalesce("best_score", F.lit(0.0))), F.lit(0.0)), 4).alias("best_score"),
    )


def get_model(spark: SparkSession, root: str, model_id: str):
    row = list_models(spark, root).filter(F.col("model_id") == model_id).first()
    if row is None:
        raise KeyError(model_id)
    return row


def load_model(spark: SparkSession, root: str, model_id: str) -> TrainedModel:
    row = get_model(spark, root, model_id)
    stages = PipelineModel.load(f"{root}/stages/{model_id}").stages
    prepared = Prepared(
        row["target_column"], row["problem_type"], list(row["features"]),
        [Fitted.from_json(t) for t in row["preparation"]], list(row["labels"]) if row["labels"] is not None else None,
    )
    return TrainedModel(
        row["model_name"], row["model"], prepared, stages[-1], json.loads(row["metrics"]), json.loads(row["params"]),
        [Fitted.from_json(t) for t in row["history"]],
    )


def delete_model(spark: SparkSession, root: str, model_id: str) -> bool:
    """Mark a model as deleted; False when there is no such model."""
    try:
        row = get_model(spark, root, model_id)
    except KeyError:
        return False
    _append(spark, root, (*row, True))
    return True
