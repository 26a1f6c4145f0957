"""An ordered list of steps over one table, with a log of what each step did."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tidemill.functions.columns import require
from tidemill.operators import charts, cleaning, correlation, features, modeling, profile
from tidemill.operators.features import Fitted
from tidemill.session import checkpointed

LOG_SCHEMA = "place int, phase string, tool string, label string, success boolean, milliseconds long, error string"


@dataclass(frozen=True)
class Step:
    """A tool name with arguments, or a function from table to table."""

    tool: str | Callable[[DataFrame], DataFrame]
    args: Mapping[str, object] = field(default_factory=dict)
    phase: str = ""
    label: str = ""
    priority: int = 2

    @property
    def tool_name(self) -> str:
        return self.tool if isinstance(self.tool, str) else getattr(self.tool, "__name__", "function")


@dataclass
class Outcome:
    """What a step returns: a new table, a report about it, or a trained model, and what was fitted."""

    table: DataFrame | None = None
    report: DataFrame | None = None
    fitted: Fitted | None = None
    model: modeling.TrainedModel | None = None


@dataclass
class Run:
    table: DataFrame
    log: list[tuple] = field(default_factory=list)
    reports: dict[int, DataFrame] = field(default_factory=dict)
    fitted: list[Fitted] = field(default_factory=list)
    models: list[modeling.TrainedModel] = field(default_factory=list)

    def log_table(self) -> DataFrame:
        return self.table.sparkSession.createDataFrame(self.log, LOG_SCHEMA)


def _names(value) -> list[str] | None:
    if value is None or isinstance(value, (list, tuple)):
        return list(value) if value else None
    return [c.strip() for c in value.split(",") if c.strip()] or None


def _flag(value) -> bool:
    return value if isinstance(value, bool) else str(value).lower() == "true"


def _fit(fitted: Fitted, df: DataFrame) -> Outcome:
    return Outcome(table=fitted.apply(df), fitted=fitted)


def _fill(df, column, strategy, order_by=None, partition_by=()):
    if strategy in ("drop", "forward_fill"):
        return Outcome(table=cleaning.fill_missing(df, column, strategy, _names(order_by), _names(partition_by) or ()))
    return _fit(features.fit_fill_value(df, column, strategy), df)


def _drop(df, column):
    require(df, [column])
    return _fit(Fitted("drop", {"cols": [column]}), df)


def _train(df, target_column, model_type="random_forest", test_size=0.2, key=None, max_rows=None, **params):
    m = modeling.train_model(df, target_column, model_type, float(test_size), _names(key), params, max_rows=max_rows)
    return Outcome(report=modeling.metrics_table(df.sparkSession, [m]), model=m)


def _auto(df, target_column, cv_folds=5, test_size=0.2, key=None, models=None, params=None, include_preprocessing=None, max_rows=None):
    extra = {"models": models} if models else {}
    found = modeling.auto_train(df, target_column, int(cv_folds), float(test_size), _names(key), params=params, max_rows=max_rows, **extra)
    return Outcome(report=found.results, model=found.best)


def _report(fn: Callable[..., DataFrame]) -> Callable[..., Outcome]:
    return lambda df, **args: Outcome(report=fn(df, **args))


# Every step that can be named in a stored list, under the names and arguments such lists use.
TOOLS: dict[str, Callable[..., Outcome]] = {
    "detect_missing_values": _report(profile.missing_values),
    "fill_missing_values": _fill,
    "remove_duplicates": lambda df, subset=None, keep="first", order_by=None: Outcome(
        table=cleaning.remove_duplicates(df, _names(subset), keep, _names(order_by))
    ),
    "detect_outliers": _report(lambda df, column, method="iqr", threshold=1.5: cleaning.detect_outliers(df, column, method, float(threshold))),
    "remove_outliers": lambda df, column, method="iqr", threshold=1.5: Outcome(
        table=cleaning.remove_outliers(df, column, method, float(threshold))
    ),
    "dataset_overview": _report(profile.dataset_overview),
    "column_statistics": _report(profile.column_statistics),
    "correlation_analysis": _report(
        lambda df, method="pearson", min_correlation=0.1: correlation.correlation_analysis(df, method, float(min_correlation))
    ),
    "value_counts": _report(lambda df, column, top_n=10, normalize=False: profile.value_counts(df, column, int(top_n), _flag(normalize))),
    "data_quality_report": _report(profile.data_quality_report),
    "create_histogram": _report(lambda df, column, bins=30, title=None: charts.histogram(df, column, int(bins))),
    "create_bar_chart": _report(lambda df, column, top_n=10, title=None: charts.bar_chart(df, column, int(top_n))),
    "create_scatter_plot": _report(
        lambda df, x_column, y_column, color_column=None, title=None: charts.scatter_grid(df, x_column, y_column, color_column)
    ),
    "create_correlation_heatmap": _report(lambda df, method="pearson", title=None: charts.correlation_heatmap(df, method)),
    "create_box_plot": _report(lambda df, column=None, group_by=None, title=None: charts.box_plot(df, column, group_by)),
    "standard_scaler": lambda df, columns_to_scale=None: _fit(features.fit_standard_scaler(df, _names(columns_to_scale)), df),
    "min_max_scaler": lambda df, columns_to_scale=None, feature_range_min=0, feature_range_max=1: _fit(
        features.fit_min_max_scaler(df, _names(columns_to_scale), float(feature_range_min), float(feature_range_max)), df
    ),
    "robust_scaler": lambda df, columns_to_scale=None: _fit(features.fit_robust_scaler(df, _names(columns_to_scale)), df),
    "log_transform": lambda df, column: _fit(features.fit_log_transform(df, column), df),
    "one_hot_encode": lambda df, columns_to_encode=None, drop_first=True: _fit(
        features.fit_one_hot(df, _names(columns_to_encode), _flag(drop_first)), df
    ),
    "label_encode": lambda df, column, table_path=None: _fit(features.fit_label_encoder(df, column, table_path), df),
    "pca_transform": lambda df, n_components=5, target_column=None: _fit(features.fit_pca(df, int(n_components), target_column), df),
    "polynomial_features": lambda df, columns_to_scale=None, degree=2: _fit(
        features.fit_polynomial(df, _names(columns_to_scale), int(degree)), df
    ),
    "drop_columns": _drop,
    "train_test_split": _report(
        lambda df, target_column, test_size=0.2, stratify=False, key=None: modeling.split_statistics(
            df, target_column, _names(key), float(test_size), stratify=_flag(stratify)
        )
    ),
    "cross_validate_model": _report(
        lambda df, target_column, model="random_forest", cv_folds=5, key=None, params=None: modeling.cross_validate(
            df, target_column, model, int(cv_folds), _names(key), params
        )
    ),
    "hyperparameter_tune": _report(
        lambda df, target_column, model="random_forest", cv_folds=5, key=None, grid=None: modeling.tune(
            df, target_column, model, int(cv_folds), _names(key), grid
        )
    ),
    "feature_importance": _report(
        lambda df, target_column, model="random_forest", params=None, max_rows=None: modeling.feature_importance(
            df, target_column, model, params=params, max_rows=max_rows
        )
    ),
    "model_evaluation": lambda df, target_column, model="random_forest", test_size=0.2, key=None, params=None, max_rows=None: _train(
        df, target_column, model, test_size, key, max_rows, **(params or {})
    ),
    "train_specific_model": _train,
    "auto_ml_pipeline": _auto,
}


def make_predictions(run: Run, table: DataFrame, model_name: str | None = None) -> DataFrame:
    """Score new rows with a model of the run; the latest when none is named.

    The transforms recorded before training are replayed on the rows first.
    """
    if not run.models:
        raise ValueError("no trained models in this run")
    chosen = [m for m in run.models if model_name in (None, m.name)]
    if not chosen:
        raise ValueError(f"model '{model_name}' not found")
    return modeling.score(chosen[-1], table, fill_absent=bool(chosen[-1].history))


def run_step(run: Run, step: Step) -> bool:
    """Run one step and log it. A failing step leaves the table as it was.

    The table and the report of the step are written to reliable storage before it counts as done, so
    that failures of running tasks are logged too, the time is that of the work, and the next step
    starts from stored rows.
    """
    place, started = len(run.log), time.monotonic()
    success, error = True, None
    try:
        args = {k: v for k, v in step.args.items() if str(v).strip() != "" and v is not None}
        if callable(step.tool):
            outcome = Outcome(table=step.tool(run.table, **args))
        elif step.tool in TOOLS:
            outcome = TOOLS[step.tool](run.table, **args)
        else:
            raise ValueError(f"unknown tool '{step.tool}'")
        table = None if outcome.table is None else checkpointed(outcome.table)
        report = None if outcome.report is None else checkpointed(outcome.report)
        if table is not None:
            run.table = table
        if report is not None:
            run.reports[place] = report
        if outcome.model is not None:
            outcome.model.history = list(run.fitted)
            run.models.append(outcome.model)
        if outcome.fitted is not None:
            run.fitted.append(outcome.fitted)
    except Exception as failure:  # recorded, and the run goes on
        success, error = False, (str(failure).splitlines() or [type(failure).__name__])[0]
    spent = int((time.monotonic() - started) * 1000)
    run.log.append((place, step.phase, step.tool_name, step.label or step.tool_name, success, spent, error))
    return success


def run_steps(df: DataFrame, steps: Sequence[Step], start: int = 0, run: Run | None = None) -> Run:
    """Feed each step's table to the next one, beginning at ``start``."""
    run = run or Run(df)
    for step in steps[start:]:
        run_step(run, step)
    return run


def run_summary(log: DataFrame) -> DataFrame:
    """Per phase: steps, successes, errors and time."""
    return log.groupBy("phase").agg(
        F.count("*").alias("steps"),
        F.count_if("success").alias("successes"),
        F.count_if(~F.col("success")).alias("errors"),
        F.sum("milliseconds").alias("milliseconds"),
    )


def call_counts(log: DataFrame, kind: str = "tool") -> DataFrame:
    """Calls, errors and time by tool or another column of the log."""
    return log.groupBy(kind).agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("errors"))
