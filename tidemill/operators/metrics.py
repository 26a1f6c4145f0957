"""Evaluation of predictions that are columns of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemill.functions.columns import name, require, tidy
from tidemill.functions.order import SMALL_TABLE, range_count, running_before
from tidemill.functions.quantiles import split_points


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n) for every combination that occurs."""
    require(df, [label, prediction])
    return df.groupBy(name(label).alias("label"), name(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def _per_class(confusion: DataFrame) -> DataFrame:
    """(class, support, predicted, hits) from confusion counts."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero)
    actual = F.struct(F.col("label").alias("class"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("hits"))
    guessed = F.struct(F.col("prediction").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hits"))
    return (
        confusion.select(F.inline(F.array(actual, guessed)))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; an undefined ratio counts as 0."""
    parts = _per_class(confusion_matrix(df, label, prediction))
    precision = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("predicted").cast("double")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    scored = parts.withColumn("p", precision).withColumn("r", recall).withColumn("f", f1)
    total = F.sum("support").cast("double")
    weighted = {k: F.try_divide(F.sum(F.col(c) * F.col("support")), total) for k, c in (("precision", "p"), ("recall", "r"), ("f1_score", "f"))}
    return scored.agg(
        tidy(F.try_divide(F.sum("hits").cast("double"), total), 4).alias("accuracy"),
        *[tidy(v, 4).alias(k) for k, v in weighted.items()],
        F.sum("support").alias("rows"),
    )


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall and support of each class."""
    parts = _per_class(confusion_matrix(df, label, prediction))
    return parts.select(
        "class",
        tidy(F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("predicted").cast("double")), F.lit(0.0)), 4).alias("precision"),
        tidy(F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("support").cast("double")), F.lit(0.0)), 4).alias("recall"),
        "support",
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve of a 0/1 label; ties count half.

    Rows merge to one per distinct score, whose smaller negatives are summed by score ranges.
    """
    require(df, [label, score])
    base = df.select(name(score).cast("double").alias("s"), name(label).cast("double").alias("l")).dropna()
    rows, distinct = base.agg(F.count("*"), F.approx_count_distinct("s")).first()
    cuts = [] if distinct <= SMALL_TABLE else split_points(base, F.col("s"), range_count(df.sparkSession, rows))
    merged = base.groupBy("s").agg(F.count_if(F.col("l") > 0).alias("pos"), F.count_if(F.col("l") <= 0).alias("neg"))
    ranked = running_before(merged, "s", cuts, ["neg"])
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before").cast("double") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(
        tidy(F.try_divide(wins, pairs), 4).alias("roc_auc"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"),
    )


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """R2, RMSE, MAE and MSE from one aggregate."""
    require(df, [label, prediction])
    y, error = name(label).cast("double"), name(label).cast("double") - name(prediction).cast("double")
    s = df.agg(
        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop(y).alias("v"), F.count(error).alias("rows")
    )
    return s.select(
        tidy(1 - F.try_divide(F.col("mse"), F.col("v")), 4).alias("r2_score"),
        tidy(F.sqrt("mse"), 4).alias("rmse"),
        tidy(F.col("mae"), 4).alias("mae"),
        tidy(F.col("mse"), 4).alias("mse"),
        "rows",
    )


def actual_vs_predicted(df: DataFrame, label: str, prediction: str, bins: int = 50) -> DataFrame:
    """Counts on a grid of actual against predicted values."""
    from tidemill.operators.charts import scatter_grid

    grid = scatter_grid(df, label, prediction, bins=bins)
    return grid.withColumnsRenamed({"x_bin": "actual_bin", "y_bin": "predicted_bin"})
