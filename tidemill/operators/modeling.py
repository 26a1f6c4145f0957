"""Splits, training, cross-validation, tuning, comparison and scoring with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml import classification as mlc, regression as mlr
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.columns import (
    hash_unit,
    name,
    present,
    require,
    row_key,
    tidy,
    type_class,
)
from tidemill.functions.grouped import Groups, grouped_quantiles
from tidemill.functions.quantiles import exact_quantiles
from tidemill.operators.kernel import KernelMachine, KernelSVM
from tidemill.operators.leafwise import LeafwiseBoosting, LeafwiseTrees
from tidemill.operators.logistic import Fit, fold_accuracy
from tidemill.operators.features import Fitted, apply_all, fit_features, known_target, label_size, with_code
from tidemill.operators.metrics import classification_metrics, regression_metrics, roc_auc
from tidemill.operators.profile import problem_type
from tidemill.session import checkpointed

#: Most classes that a model can have, as each has scores of its own in it. Splits and folds have no such bound.
MAX_CLASSES = 1_000
FEW_CLASSES = 50  # classes whose limits are found side by side
WORKERS = 4  # fits that run side by side; each one is a sequence of distributed jobs
SIDE_ROWS = 2_000_000  # most rows of such fits; larger ones run one after the other

# Names used for the same role elsewhere, and the trainer here that fills the role.
ALIASES = {"xgboost": "gbt", "lightgbm": "gbt_deep", "logistic": "logistic_regression", "linear": "logistic_regression", "linear_regression": "logistic_regression"}
MODELS = ("random_forest", "gbt", "gbt_deep", "logistic_regression", "svm", "linear_svm")

# The search grid of each model.
GRIDS: dict[str, dict[str, list]] = {
    "random_forest": {"n_estimators": [50, 100, 200], "max_depth": [None, 5, 10, 20], "min_samples_split": [2, 5]},
    "gbt": {"n_estimators": [50, 100], "max_depth": [3, 5, 7], "learning_rate": [0.05, 0.1, 0.2]},
    "gbt_deep": {"n_estimators": [50, 100], "num_leaves": [31, 63], "learning_rate": [0.05, 0.1]},
    "logistic_regression": {"C": [0.01, 0.1, 1, 10]},
    "svm": {"C": [0.1, 1, 10]},
    "linear_svm": {"C": [0.1, 1, 10]},
}


# Splits


def with_test_side(
    df: DataFrame, target: str, key: Sequence[str], test_size: float, seed: int, stratify: bool, labels: Sequence[str] | None = None, out: str = "__test"
) -> DataFrame:
    """Add a flag that is true for test rows. Every row's side depends on its key alone, not on partitioning."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    unit = hash_unit(key, seed)
    if not stratify:
        return df.withColumn(out, unit < F.lit(float(test_size)))
    # Each label gets its own threshold, so its share of test rows is exact to one row.
    rows = with_class_limits(df, target, unit, [test_size], labels)
    return rows.withColumn(out, F.coalesce(unit < F.col("__limits")[0], F.lit(False))).drop("__limits")


def with_class_limits(df: DataFrame, target: str, unit: Column, probs: Sequence[float], labels: Sequence[str] | None = None) -> DataFrame:
    """Add ``__limits``, the quantiles of ``unit`` within each row's class as an array, null for rows without a class.

    A few classes are conditional targets of the same scans; any number of them is a table keyed by class.
    """
    label = present(target, df.schema[target].dataType).cast("string")
    if labels is None:
        found = df.select(label.alias("s")).where("s is not null").distinct().limit(FEW_CLASSES + 1).collect()
        labels = [r["s"] for r in found]
    if len(labels) > FEW_CLASSES:
        held = Groups.counted(checkpointed(grouped_quantiles(df, label, unit, probs, uniform=True)))
        return held.join(df.withColumn("__class", label), F.col("__class"), ["q"], "__").withColumnRenamed("__q", "__limits").drop("__class")
    # Several scans follow; the key hash costs more than all else in them, so it is computed once.
    drawn = df.select(label.alias("c"), unit.alias("u")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        limits = exact_quantiles(drawn, {v: F.when(F.col("c") == F.lit(v), F.col("u")) for v in labels}, probs, uniform=True)
    finally:
        drawn.unpersist()
    known = [(v, limits[v]) for v in labels if None not in limits[v]]
    if not known:
        return df.withColumn("__limits", F.lit(None).cast("array<double>"))
    entries = F.create_map(*[x for v, cuts in known for x in (F.lit(v), F.array(*[F.lit(float(t)) for t in cuts]))])
    return df.withColumn("__limits", F.try_element_at(entries, label))


def train_test(
    df: DataFrame, target: str, key: Sequence[str] | None = None, test_size: float = 0.2, seed: int = 42,
    stratify: bool = False, labels: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows with a known target, divided by key hash."""
    require(df, [target, *(key or [])])
    rows = known_target(df, target)
    rows = with_test_side(rows, target, key or row_key(df), test_size, seed, stratify, labels)
    return rows.filter(~F.col("__test")).drop("__test"), rows.filter(F.col("__test")).drop("__test")


def split_statistics(
    df: DataFrame, target: str, key: Sequence[str] | None = None, test_size: float = 0.2, seed: int = 42, stratify: bool = False,
    problem: str | None = None,
) -> DataFrame:
    """Sizes of both sides, then class shares or target statistics, as (statistic, item, value)."""
    require(df, [target])
    kind = stated_problem(df, target, problem)
    rows = with_test_side(known_target(df, target), target, key or row_key(df), test_size, seed, stratify and kind == "classification")
    test = F.col("__test")
    sizes = rows.agg(F.count("*").cast("double").alias("n"), F.count_if(test).cast("double").alias("t")).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit("rows").alias("statistic"), F.lit(k).alias("item"), v.alias("value"))
                    for k, v in (("total", F.col("n")), ("train", F.col("n") - F.col("t")), ("test", F.col("t")))
                ]
            )
        )
    )
    if kind == "classification":
        counts = rows.groupBy(name(target).cast("string").alias("item")).agg(F.count("*").alias("n"))
        shares = counts.select(
            F.lit("class_share").alias("statistic"),
            "item",
            tidy(F.col("n") / counts.agg(F.sum("n").cast("double")).scalar(), 3).alias("value"),
        )
        return sizes.unionByName(shares)
    y = name(target).cast("double")
    stats = rows.agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"))
    return sizes.unionByName(
        stats.select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit("target").alias("statistic"), F.lit(k).alias("item"), tidy(F.col(k), 4).alias("value"))
                        for k in ("mean", "std", "min", "max")
                    ]
                )
            )
        )
    )


def with_folds(
    df: DataFrame, key: Sequence[str], k: int = 5, seed: int = 42, out: str = "fold", stratify_by: str | None = None,
    labels: Sequence[str] | None = None, unit: Column | None = None,
) -> DataFrame:
    """Add a fold number 0..k-1 drawn from the key hash, or from ``unit`` where that is at hand.

    With ``stratify_by`` every fold gets its share of each class, exact to one row; rows without a
    class are drawn as without it.
    """
    if k < 2:
        raise ValueError("at least 2 folds are needed")
    unit = hash_unit(key, seed) if unit is None else unit
    drawn = F.least(F.floor(unit * k), F.lit(k - 1)).cast("int")
    if stratify_by is None:
        return df.withColumn(out, drawn)
    cuts = F.col("__limits")
    return with_class_limits(df, stratify_by, unit, [i / k for i in range(1, k)], labels).withColumn("__u", unit).withColumn(
        out, F.when(cuts.isNull(), drawn).otherwise(F.size(F.filter(cuts, lambda t: t <= F.col("__u"))))
    ).drop("__u", "__limits")


def bounded(df: DataFrame, key: Sequence[str], max_rows: int | None, seed: int = 42) -> DataFrame:
    """All rows, or about ``max_rows`` chosen by key hash when there are more: the bound on the rows a fit learns from."""
    if max_rows is None:
        return df
    n = df.count()
    return df if n <= max_rows else df.filter(bound_unit(key, seed) < F.lit(max_rows / n))


def bound_unit(key: Sequence[str], seed: int = 42) -> Column:
    return hash_unit(key, seed + 101)


# Preparation


def class_labels(df: DataFrame, target: str) -> list[str]:
    """The classes of a target in sorted order, as text."""
    x = present(target, df.schema[target].dataType)
    found = df.select(x.alias("v")).filter("v IS NOT NULL").distinct().limit(MAX_CLASSES + 1)
    rows = found.select("v", F.col("v").cast("string").alias("s")).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"target '{target}' has more than {MAX_CLASSES} classes")
    return [r["s"] for r in sorted(rows, key=lambda r: r["v"])]


@dataclass
class Prepared:
    """What turns raw rows into (features, label): fitted transforms, feature order and classes."""

    target: str
    kind: str
    features: list[str]
    steps: list[Fitted]
    labels: list[str] | None

    def blank(self, feature: str) -> float:
        """What stands for no value: of a text the code after the last label, else 0."""
        sizes = [label_size(s.params) for s in self.steps if s.kind == "label" and s.params["column"] == feature]
        return float(sizes[0]) if sizes else 0.0

    def encode(self, df: DataFrame) -> DataFrame:
        return apply_all(df, self.steps)

    def columns(self, df: DataFrame, extra: Mapping[str, Column] | None = None) -> DataFrame:
        """(a column ``f0``, ``f1``.. for each feature, label double) plus the ``extra`` columns."""
        rows = self.encode(known_target(df, self.target))
        if self.labels is not None:
            rows = with_code(rows, name(self.target).cast("string"), self.labels, "__class")
            # A class that training never saw gets the code after the last one, which no model predicts.
            label = F.coalesce("__class", F.lit(len(self.labels))).cast("double")
        else:
            label = name(self.target).cast("double")
        rows = rows.select(
            *[F.coalesce(name(c).cast("double"), F.lit(self.blank(c))).alias(f"f{i}") for i, c in enumerate(self.features)],
            label.alias("label"),
            *[v.alias(k) for k, v in (extra or {}).items()],
        )
        return rows.filter("label IS NOT NULL")

    def vectors(self, columns: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        """(features vector, label double) plus the ``extra`` columns, of what ``columns`` gave."""
        return assembler(len(self.features)).transform(columns).select("features", "label", *extra)

    def assemble(self, df: DataFrame, extra: Mapping[str, Column] | None = None) -> DataFrame:
        """(features vector, label double) plus the ``extra`` columns."""
        return self.vectors(self.columns(df, extra), list(extra or {}))


def assembler(width: int) -> VectorAssembler:
    return VectorAssembler(inputCols=[f"f{i}" for i in range(width)], outputCol="features", handleInvalid="error")


def stated_problem(df: DataFrame, target: str, problem: str | None = None) -> str:
    """The stated problem type after a check, or the one that the target's values suggest."""
    if problem is None:
        return problem_type(df, target)
    if problem not in ("classification", "regression"):
        raise ValueError("problem must be 'classification' or 'regression'")
    if problem == "regression" and type_class(df.schema[target].dataType) != "numeric":
        raise ValueError(f"regression needs a numeric target, not '{target}'")
    return problem


def describe_target(df: DataFrame, target: str, problem: str | None = None) -> tuple[str, list[str] | None]:
    """The problem type and, for a classification, the classes."""
    kind = stated_problem(df, target, problem)
    return kind, class_labels(df, target) if kind == "classification" else None


def usable_features(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> list[str]:
    """Number, text and flag columns other than the target and the excluded ones."""
    kinds = ("numeric", "string", "boolean")
    out = [f.name for f in df.schema.fields if f.name not in (target, *exclude) and type_class(f.dataType) in kinds]
    if not out:
        raise ValueError("no usable feature columns")
    return out


def prepare(
    df: DataFrame, target: str, strategy: str = "median", exclude: Sequence[str] = (), label_dir: str | None = None,
    described: tuple[str, list[str] | None] | None = None,
) -> Prepared:
    """Fit the feature preparation on ``df``; columns of other types than number, text and flag are left out."""
    kind, labels = described or describe_target(df, target)
    features = usable_features(df, target, exclude)
    used = df.select(*[name(c) for c in [*features, target]])
    steps = fit_features(used, target, strategy, label_dir)
    flags = [c for c in features if type_class(df.schema[c].dataType) == "boolean"]
    if flags:
        steps = [*steps, Fitted("flags", {"cols": flags})]
    return Prepared(target, kind, features, steps, labels)


# Trainers


def canonical(model: str) -> str:
    known = ALIASES.get(model, model)
    if known not in MODELS:
        raise ValueError(f"unknown model '{model}'; choose from {MODELS}")
    return known


def display_name(model: str, kind: str) -> str:
    known = canonical(model)
    return "linear_regression" if known == "logistic_regression" and kind == "regression" else known


def build_estimator(model: str, kind: str, classes: int, rows: int, params: Mapping | None = None):
    """The Spark ML estimator for a model name, with parameters under their usual names.

    A forest depth of None means 30, the deepest tree that Spark grows.
    """
    p, model = dict(params or {}), canonical(model)
    classify = kind == "classification"
    seed = p.pop("random_state", 42)
    if model == "random_forest":
        cls = mlc.RandomForestClassifier if classify else mlr.RandomForestRegressor
        depth = p.pop("max_depth", 10)
        est = cls(
            numTrees=p.pop("n_estimators", 100),
            maxDepth=30 if depth is None else depth,
            minInstancesPerNode=max(1, p.pop("min_samples_split", 2) // 2),
            seed=seed,
        )
    elif model == "gbt_deep":
        names = ("n_estimators", "num_leaves", "learning_rate", "max_depth")
        est = LeafwiseBoosting(kind, classes, **{k: p.pop(k) for k in names if k in p})
    elif model == "svm":
        names = ("C", "gamma", "epsilon", "n_features", "max_iter")
        est = KernelSVM(kind, classes, **{k: p.pop(k) for k in names if k in p}, seed=seed)
    elif model == "gbt":
        cls = mlc.GBTClassifier if classify else mlr.GBTRegressor
        est = cls(maxIter=p.pop("n_estimators", 100), maxDepth=p.pop("max_depth", 6), stepSize=p.pop("learning_rate", 0.3), seed=seed)
        if classify and classes > 2:
            est = mlc.OneVsRest(classifier=est, parallelism=WORKERS)
    elif model == "linear_svm":
        strength = 1.0 / (p.pop("C", 1.0) * max(rows, 1))
        if classify:
            est = mlc.LinearSVC(maxIter=p.pop("max_iter", 100), regParam=strength)
            if classes > 2:
                est = mlc.OneVsRest(classifier=est, parallelism=WORKERS)
        else:
            # Huber loss is the robust linear fit that Spark has; it is not epsilon-insensitive loss.
            est = mlr.LinearRegression(loss="huber", maxIter=p.pop("max_iter", 100), regParam=strength)
    elif classify:
        est = mlc.LogisticRegression(
            maxIter=p.pop("max_iter", 500), regParam=1.0 / (p.pop("C", 1.0) * max(rows, 1)), standardization=False
        )
    else:
        p.pop("C", None)
        est = mlr.LinearRegression(maxIter=p.pop("max_iter", 500))
    if p:
        raise ValueError(f"unknown parameters for {model}: {sorted(p)}")
    return est


@dataclass
class TrainedModel:
    name: str
    model: str
    prepared: Prepared
    fitted: object
    metrics: dict = field(default_factory=dict)
    params: dict = field(default_factory=dict)
    history: list[Fitted] = field(default_factory=list)  # transforms applied before training

    @property
    def kind(self) -> str:
        return self.prepared.kind

    def stages(self) -> PipelineModel:
        return PipelineModel(stages=[assembler(len(self.prepared.features)), self.fitted])


def _spread(df: DataFrame) -> DataFrame:
    """Persist a training table, over all cores when it comes in fewer pieces than there are.

    Trainers go over it many times, so one exchange of a small input pays; a large input already
    has more pieces than the cluster has cores and is left as it is.
    """
    return _even(df).persist(StorageLevel.MEMORY_AND_DISK)


def _even(df: DataFrame) -> DataFrame:
    """Over all cores when it comes in fewer pieces than there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _within(table: DataFrame, max_rows: int | None, unit: str) -> DataFrame:
    """``bounded`` for a table that carries its ``bound_unit``."""
    if max_rows is None:
        return table
    n = table.count()
    return table if n <= max_rows else table.filter(F.col(unit) < F.lit(max_rows / n))


def _fit(model: str, prepared: Prepared, table: DataFrame, rows: int, params: Mapping | None):
    classes = len(prepared.labels or [])
    return build_estimator(model, prepared.kind, classes, rows, params).fit(table)


def _score_of(kind: str, predictions: DataFrame) -> float:
    if kind == "classification":
        return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(predictions)
    return RegressionEvaluator(metricName="r2").evaluate(predictions)


def measure(prepared: Prepared, predictions: DataFrame) -> dict:
    """Metric values of (label, prediction) rows; AUC too when there are two classes and scores."""
    binary = len(prepared.labels or []) == 2 and "probability" in predictions.columns
    chance = [vector_to_array("probability")[1].alias("score")] if binary else []
    rows = predictions.select("label", "prediction", *chance).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if prepared.kind != "classification":
            row = regression_metrics(rows, "label", "prediction").first()
            return {k: row[k] for k in ("r2_score", "rmse", "mae", "mse")}
        row = classification_metrics(rows, "label", "prediction").first()
        out = {k: row[k] for k in ("accuracy", "precision", "recall", "f1_score")}
        if binary:
            out["roc_auc"] = roc_auc(rows.filter("label < 2"), "label", "score").first()["roc_auc"]
        return out
    finally:
        rows.unpersist()


def train_model(
    df: DataFrame,
    target: str,
    model: str = "random_forest",
    test_size: float = 0.2,
    key: Sequence[str] | None = None,
    params: Mapping | None = None,
    fit_on: str = "train",
    strategy: str = "median",
    exclude: Sequence[str] = (),
    model_name: str | None = None,
    seed: int = 42,
    problem: str | None = None,
    max_rows: int | None = None,
) -> TrainedModel:
    """Split, prepare, fit one model and measure it on the held-out rows.

    ``fit_on`` says whether encoders and fills learn from the training rows or from all rows;
    ``problem`` states the problem type; ``max_rows`` bounds the rows that the model is fitted on, never
    the test rows or the rows that encoders and fills learn from.
    """
    kind, labels = describe_target(df, target, problem)
    if model == "logistic" and kind != "classification":
        raise ValueError("logistic regression needs a classification target")
    train, test = train_test(df, target, key, test_size, seed, kind == "classification", labels)
    # The training rows are read several times below; kept, their key hash is computed once.
    train = train.select(*[name(c) for c in [*usable_features(df, target, exclude), target]], bound_unit(key or row_key(df), seed).alias("__unit"))
    train = _spread(train)
    try:
        prepared = prepare(df if fit_on == "all" else train.drop("__unit"), target, strategy, exclude, described=(kind, labels))
        table = prepared.assemble(_within(train, max_rows, "__unit")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            fitted = _fit(model, prepared, table, table.count(), params)
        finally:
            table.unpersist()
    finally:
        train.unpersist()
    metrics = measure(prepared, fitted.transform(prepared.assemble(test)))
    return TrainedModel(model_name or f"{model}_0", display_name(model, prepared.kind), prepared, fitted, metrics, dict(params or {}))


def metrics_table(spark, models: Sequence[TrainedModel]) -> DataFrame:
    """(model_name, model, metric, value) of trained models."""
    rows = [(m.name, m.model, k, None if v is None else float(v)) for m in models for k, v in m.metrics.items()]
    return spark.createDataFrame(rows, "model_name string, model string, metric string, value double")


def evaluate_model(trained: TrainedModel, test: DataFrame) -> DataFrame:
    """Metrics of a trained model on given rows, as (metric, value).

    Rows of a class that training never saw count as errors; the AUC leaves them out.
    """
    found = measure(trained.prepared, trained.fitted.transform(trained.prepared.assemble(test)))
    return test.sparkSession.createDataFrame([(k, float(v)) for k, v in found.items() if v is not None], "metric string, value double")


def compare_models(models: Sequence[TrainedModel], test: DataFrame) -> DataFrame:
    """Every model on the same rows; the best by accuracy or R2 is flagged."""
    if not models:
        raise ValueError("no models to compare")
    table = _spread(models[0].prepared.assemble(test))
    try:
        rows = []
        for m in models:
            same = m.prepared is models[0].prepared
            rows.append((m, measure(m.prepared, m.fitted.transform(table if same else m.prepared.assemble(test)))))
    finally:
        table.unpersist()
    main = "accuracy" if models[0].kind == "classification" else "r2_score"
    best = max(rows, key=lambda r: r[1][main])[0].name
    data = [(m.name, k, None if v is None else float(v), m.name == best) for m, found in rows for k, v in found.items()]
    return test.sparkSession.createDataFrame(data, "model_name string, metric string, value double, best boolean")


# Cross-validation and search


def _fold_table(
    df: DataFrame, target: str, key: Sequence[str] | None, folds: int, seed: int, exclude: Sequence[str], described, max_rows: int | None,
):
    """(preparation, stored table of feature columns, label, fold and unit, the same with vectors, rows) that all fits of a search share.

    Folds of a classification are stratified. Fills and encoders learn from all folds; each fit bounds
    its rows by ``unit``, which is there with ``max_rows``. The tables are stored, not persisted: executors need no memory for them, and
    packed columns take less disk than persisted rows.
    """
    kind, labels = described
    key = key or row_key(df)
    used = [name(c) for c in [*usable_features(df, target, exclude), target]]
    unit = [] if max_rows is None else [bound_unit(key, seed).alias("__unit")]
    # The key hash costs more than all else in the scans that follow, so it is stored.
    rows = checkpointed(_even(known_target(df, target).select(*used, hash_unit(key, seed).alias("__draw"), *unit)))
    prepared = prepare(rows.select(*used), target, exclude=exclude, described=described)
    rows = with_folds(rows, [], max(folds, 2), seed, "__fold", target if kind == "classification" else None, labels, F.col("__draw"))
    extra = {"fold": F.col("__fold")} | ({} if max_rows is None else {"unit": F.col("__unit")})
    table = checkpointed(prepared.columns(rows, extra))
    return prepared, table, prepared.vectors(table, list(extra)), table.count()


class _Learned:
    """The rows that the fits of a search learn from, read out of the fold table once.

    Trainers go over their rows many times. With ``max_rows`` these are few, so they are kept apart from the whole table;
    every fit gets the rows, pieces and order that it would get from there.
    """

    def __init__(self, table: DataFrame, max_rows: int | None):
        self.max_rows, self.part, self.kept = max_rows, table, False
        if max_rows is None:
            return
        self.sizes = {r["fold"]: r["n"] for r in table.groupBy("fold").agg(F.count("*").alias("n")).collect()}
        total = sum(self.sizes.values())
        # A bound holds for the whole table and for the table without each fold; the widest one covers all fits.
        least = min([total, *[total - n for n in self.sizes.values()]])
        if least > max_rows:
            self.part, self.kept = table.filter(F.col("unit") < F.lit(max_rows / least)).persist(StorageLevel.MEMORY_AND_DISK), True

    def without(self, fold: int | None) -> DataFrame:
        """(features, label) to learn from, of all folds but one."""
        rows = self.part if fold is None else self.part.filter(F.col("fold") != fold)
        if self.max_rows is not None:
            n = sum(v for k, v in self.sizes.items() if k != fold)
            rows = rows if n <= self.max_rows else rows.filter(F.col("unit") < F.lit(self.max_rows / n))
        return rows.select("features", "label")


    def forget(self) -> None:
        if self.kept:
            self.part.unpersist()


def _side_by_side(rows: int) -> int:
    """How many fits run at a time: many rows keep all cores busy, and every trainer keeps a copy of its rows in its own form."""
    return WORKERS if rows <= SIDE_ROWS else 1


def _fold_scores(
    prepared: Prepared, stored: DataFrame, table: DataFrame, model: str, chosen: Sequence[Mapping], folds: int, rows: int, max_rows: int | None,
    learned: _Learned,
) -> list[list[float]]:
    """For each choice of parameters each fold's score over all its rows; the other folds' rows are bounded by ``max_rows``."""
    learns = min(rows - rows // folds, max_rows or rows)
    if max_rows is None and canonical(model) == "logistic_regression" and prepared.kind == "classification" and len(prepared.labels) == 2:
        built = [build_estimator(model, prepared.kind, 2, learns, c) for c in chosen]
        fits = [Fit(i, e.getRegParam(), e.getMaxIter(), e.getTol()) for e in built for i in range(folds)]
        scores = fold_accuracy(stored, len(prepared.features), folds, fits)
        return [scores[at : at + folds] for at in range(0, len(scores), folds)]

    def one(params: Mapping, i: int) -> float:
        fitted = _fit(model, prepared, learned.without(i), learns, params)
        return _score_of(prepared.kind, fitted.transform(table.filter(F.col("fold") == i)))

    with ThreadPoolExecutor(_side_by_side(learns)) as pool:
        return [list(pool.map(lambda i: one(params, i), range(folds))) for params in chosen]


def _summary(scores: Sequence[float]) -> dict:
    mean = sum(scores) / len(scores)
    std = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    return {
        "mean_score": mean, "std_score": std, "min_score": min(scores), "max_score": max(scores),
        "ci95_low": mean - 2 * std, "ci95_high": mean + 2 * std,
    }


def cross_validate(
    df: DataFrame, target: str, model: str = "random_forest", folds: int = 5, key: Sequence[str] | None = None,
    params: Mapping | None = None, exclude: Sequence[str] = (), seed: int = 42, problem: str | None = None, max_rows: int | None = None,
) -> DataFrame:
    """Score of each fold (accuracy or R2) with mean, population std, range and mean +- 2 std."""
    prepared, stored, table, rows = _fold_table(df, target, key, folds, seed, exclude, describe_target(df, target, problem), max_rows)
    learned = _Learned(table, max_rows)
    try:
        scores = _fold_scores(prepared, stored, table, model, [params or {}], folds, rows, max_rows, learned)[0]
    finally:
        learned.forget()
    scoring = "accuracy" if prepared.kind == "classification" else "r2"
    data = [(display_name(model, prepared.kind), scoring, i, float(s), *_summary(scores).values()) for i, s in enumerate(scores)]
    names = list(_summary(scores))
    out = df.sparkSession.createDataFrame(
        data, "model string, scoring string, fold int, score double, " + ", ".join(f"{n} double" for n in names)
    )
    return out.select("model", "scoring", "fold", *[tidy(F.col(c), 4).alias(c) for c in ("score", *names)])


def tune(
    df: DataFrame, target: str, model: str = "random_forest", folds: int = 5, key: Sequence[str] | None = None,
    grid: Mapping[str, Sequence] | None = None, exclude: Sequence[str] = (), seed: int = 42, top: int = 5,
    problem: str | None = None, max_rows: int | None = None,
) -> DataFrame:
    """Cross-validate every parameter combination; the best few with mean and std of their scores."""
    grid = dict(grid if grid is not None else GRIDS[canonical(model)])
    combos = [dict(zip(grid, values)) for values in product(*grid.values())]
    prepared, stored, table, rows = _fold_table(df, target, key, folds, seed, exclude, describe_target(df, target, problem), max_rows)
    learned = _Learned(table, max_rows)
    try:
        scores = _fold_scores(prepared, stored, table, model, combos, folds, rows, max_rows, learned)
        found = [(c, _summary(s)) for c, s in zip(combos, scores)]
    finally:
        learned.forget()
    found.sort(key=lambda r: -r[1]["mean_score"])
    data = [
        (i + 1, str(c), float(s["mean_score"]), float(s["std_score"]), len(combos)) for i, (c, s) in enumerate(found[:top])
    ]
    out = df.sparkSession.createDataFrame(data, "place int, params string, mean_score double, std_score double, combinations int")
    return out.select("place", "params", tidy(F.col("mean_score"), 4).alias("mean_score"), tidy(F.col("std_score"), 4).alias("std_score"), "combinations")


@dataclass
class AutoResult:
    results: DataFrame
    best: TrainedModel | None
    models: list[TrainedModel]
    test: DataFrame


def auto_train(
    df: DataFrame, target: str, folds: int = 5, test_size: float = 0.2, key: Sequence[str] | None = None,
    models: Sequence[str] = ("random_forest", "gbt", "gbt_deep", "logistic_regression"),
    params: Mapping[str, Mapping] | None = None, exclude: Sequence[str] = (), seed: int = 42,
    problem: str | None = None, max_rows: int | None = None,
) -> AutoResult:
    """Cross-validate and test several models; a model that fails leaves an error row and the rest go on.

    With fewer than 2 ``folds`` the models are only trained and tested.
    """
    kind, labels = describe_target(df, target, problem)
    train, test = train_test(df, target, key, test_size, seed, kind == "classification", labels)
    prepared, stored, table, rows = _fold_table(train, target, key, folds, seed + 1, exclude, (kind, labels), max_rows)
    held_out = prepared.vectors(checkpointed(_even(prepared.columns(test))))
    main = "accuracy" if kind == "classification" else "r2_score"
    trained, data = [], []
    learned = _Learned(table, max_rows)
    try:
        for model in models:
            chosen = dict((params or {}).get(model, {}))
            try:
                cv = _summary(_fold_scores(prepared, stored, table, model, [chosen], folds, rows, max_rows, learned)[0]) if folds > 1 else {}
                fitted = _fit(model, prepared, learned.without(None), min(rows, max_rows or rows), chosen)
                metrics = measure(prepared, fitted.transform(held_out))
                if cv:
                    metrics = {"cv_mean": round(cv["mean_score"], 4), "cv_std": round(cv["std_score"], 4), **metrics}
                trained.append(TrainedModel(model, display_name(model, kind), prepared, fitted, metrics, chosen))
            except Exception as error:  # one model's failure must not end the comparison
                data.append((model, "error", None, str(error).splitlines()[0]))
    finally:
        learned.forget()
    best = max(trained, key=lambda m: m.metrics[main], default=None)
    data += [(m.name, k, None if v is None else float(v), None) for m in trained for k, v in m.metrics.items()]
    out = df.sparkSession.createDataFrame(data, "model_name string, metric string, value double, error string")
    out = out.withColumn("best", F.col("model_name") == F.lit(best.name if best else None))
    return AutoResult(out, best, trained, test)


def importances(trained: TrainedModel) -> list[tuple[str, float]]:
    fitted, names = trained.fitted, trained.prepared.features
    if isinstance(fitted, mlc.OneVsRestModel):
        parts = [_weights(m) for m in fitted.models]
        values = [sum(v) / len(parts) for v in zip(*parts)]
    else:
        values = _weights(fitted)
    return sorted(zip(names, values), key=lambda r: (-r[1], r[0]))


def _weights(fitted) -> list[float]:
    if isinstance(fitted, (KernelMachine, LeafwiseTrees)):
        return fitted.input_weights
    if hasattr(fitted, "featureImportances"):
        return [float(v) for v in fitted.featureImportances.toArray()]
    if hasattr(fitted, "coefficientMatrix") and fitted.numClasses > 2:
        return [float(v) for v in abs(fitted.coefficientMatrix.toArray()).mean(axis=0)]
    return [abs(float(v)) for v in fitted.coefficients.toArray()]


def feature_importance(
    df: DataFrame, target: str | None = None, model: str | TrainedModel = "random_forest", top: int | None = 10,
    params: Mapping | None = None, exclude: Sequence[str] = (), problem: str | None = None, max_rows: int | None = None,
) -> DataFrame:
    """Features by importance or absolute coefficient, of a given model or of one fitted on all rows.

    ``max_rows`` bounds the rows of that fit.
    """
    if isinstance(model, str):
        described = describe_target(df, target, problem)
        df = known_target(df, target)
        prepared = prepare(df, target, exclude=exclude, described=described)
        table = _spread(prepared.assemble(bounded(df, row_key(df), max_rows)))
        try:
            model = TrainedModel(model, display_name(model, prepared.kind), prepared, _fit(model, prepared, table, table.count(), params))
        finally:
            table.unpersist()
    ranked = importances(model)[:top]
    out = df.sparkSession.createDataFrame([(i + 1, f, v) for i, (f, v) in enumerate(ranked)], "place int, feature string, v double")
    return out.select("place", "feature", tidy(F.col("v"), 6).alias("importance"))


# Scoring


def score(trained: TrainedModel, df: DataFrame, keep: Sequence[str] | None = None, fill_absent: bool = False) -> DataFrame:
    """Add prediction, class probabilities and confidence; works on batch and streaming tables.

    All features must be there, unless ``fill_absent`` sets absent ones to 0. A missing value in a
    feature that has no fitted fill counts as 0, and a text that training never saw has a code of its
    own. Columns to ``keep`` have the values they came with,
    before any recorded transform.
    """
    p = trained.prepared
    came = {}
    if trained.history:
        came = {c: f"__c{i}" for i, c in enumerate(keep or []) if c in df.columns}
        df = apply_all(df.select("*", *[name(c).alias(k) for c, k in came.items()]), trained.history)
    absent = [c for c in p.features if c not in df.columns]
    if absent and not fill_absent:
        raise ValueError(f"missing features: {absent}")
    kept = list(keep) if keep is not None else [c for c in df.columns]
    rows = df.select(*[name(came.get(c, c)).alias(f"__k{i}") for i, c in enumerate(kept)], *[name(c) for c in p.features if c in df.columns])
    for c in absent:
        rows = rows.withColumn(c, F.lit(0.0))
    rows = p.encode(rows)
    inputs = rows.select(
        *[f"__k{i}" for i in range(len(kept))],
        *[F.coalesce(F.nanvl(name(c).cast("double"), F.lit(None)), F.lit(p.blank(c))).alias(f"f{i}") for i, c in enumerate(p.features)],
    )
    out = trained.fitted.transform(assembler(len(p.features)).transform(inputs))
    result = [F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)]
    if p.kind != "classification":
        return out.select(*result, F.col("prediction"))
    labels = F.array(*[F.lit(v) for v in p.labels])
    result.append(F.try_element_at(labels, F.col("prediction").cast("int") + 1).alias("prediction"))
    if "probability" in out.columns:
        chances = F.transform(vector_to_array("probability"), lambda v: F.round(v, 4))
        result += [
            F.map_from_arrays(labels, F.slice(chances, 1, len(p.labels))).alias("probabilities"),
            F.array_max(chances).alias("confidence"),
        ]
    return out.select(*result)
