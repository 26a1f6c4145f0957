"""Rule-based choice of steps from a table's profile, and the fixed-order run over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame

from tidemill.functions.columns import numeric_columns, string_columns
from tidemill.operators import profile
from tidemill.plans.steps import Run, Step, run_steps

# Words in a column name that suggest a target.
TARGET_HINTS = ("price", "target", "label", "churn", "survived", "outcome", "sales", "revenue", "y")
MANY_CATEGORIES = 20
STRONG_SKEW = 1.0


def resolve_target(df: DataFrame, wanted: str | None = None) -> str:
    """The named column, exactly or by case; else a hinted numeric column, else the last one."""
    if wanted:
        if wanted in df.columns:
            return wanted
        same = [c for c in df.columns if c.lower() == wanted.lower()]
        if same:
            return same[0]
    numbers = numeric_columns(df)
    if not wanted:
        hinted = [c for c in numbers if any(h in c.lower() for h in TARGET_HINTS)]
        if hinted:
            return hinted[0]
    return numbers[-1] if numbers else df.columns[-1]


def eda_steps() -> list[Step]:
    names = ("dataset_overview", "detect_missing_values", "data_quality_report", "correlation_analysis")
    return [Step(n, phase="eda") for n in names]


def cleaning_steps(df: DataFrame) -> list[Step]:
    """A fill for each column with gaps, worst first, and deduplication where rows repeat."""
    numbers = set(numeric_columns(df))
    out = []
    if profile.duplicate_count(df).first()["duplicate_rows"]:
        out.append(Step("remove_duplicates", phase="cleaning", priority=1))
    gaps = sorted(profile.missing_values(df).collect(), key=lambda r: (-r["null_count"], r["position"]))
    for r in gaps:
        args = {"column": r["column"], "strategy": "median" if r["column"] in numbers else "mode"}
        out.append(Step("fill_missing_values", args, "cleaning", priority=1))
    return out


def chart_steps(df: DataFrame) -> list[Step]:
    numbers, strings = numeric_columns(df), string_columns(df)
    out = [Step("create_correlation_heatmap", phase="visualization")] if len(numbers) > 1 else []
    if numbers:
        out.append(Step("create_histogram", {"column": numbers[0]}, "visualization"))
    if len(numbers) > 1:
        out.append(Step("create_scatter_plot", {"x_column": numbers[0], "y_column": numbers[1]}, "visualization"))
    if strings:
        out.append(Step("create_bar_chart", {"column": strings[0]}, "visualization"))
    if numbers:
        out.append(Step("create_box_plot", {"column": numbers[0]}, "visualization"))
    return out


def feature_steps(df: DataFrame, target: str) -> list[Step]:
    """Logarithms for strong skew, encodings for text and a scaler for the numbers."""
    numbers = [c for c in numeric_columns(df) if c != target]
    strings = [c for c in string_columns(df) if c != target]
    distinct = profile.distinct_counts(df, strings)
    stats = profile.describe(df, numbers)
    few = [c for c in strings if distinct[c] <= MANY_CATEGORIES]
    out = []
    if numbers:
        out.append(Step("standard_scaler", {"columns_to_scale": numbers}, "feature_engineering", priority=3))
    if few:
        out.append(Step("one_hot_encode", {"columns_to_encode": few}, "feature_engineering", priority=3))
    out += [Step("label_encode", {"column": c}, "feature_engineering", priority=3) for c in strings if c not in few]
    skewed = [c for c in numbers if (stats[c]["skewness"] or 0) > STRONG_SKEW and (stats[c]["min"] or 0) >= 0]
    logs = [Step("log_transform", {"column": c}, "feature_engineering", priority=3) for c in skewed]
    # Logarithms come before scaling, which makes values negative.
    return [*logs, *out]


def suggest_steps(df: DataFrame, done: Sequence[str] = (), target: str | None = None) -> list[Step]:
    """Steps not yet done, with default arguments, cleaning first and modelling last."""
    goal = resolve_target(df, target)
    found = [*cleaning_steps(df), *(replace(s, priority=2) for s in [*eda_steps(), *chart_steps(df)])]
    found += feature_steps(df, goal)
    found.append(Step("auto_ml_pipeline", {"target_column": goal}, "modeling", priority=4))
    return sorted((s for s in found if s.tool_name not in done), key=lambda s: s.priority)


def automatic_run(
    df: DataFrame, target: str | None = None, key: Sequence[str] | None = None, folds: int = 5,
    models: Sequence[str] | None = None, params: Mapping[str, Mapping] | None = None, max_rows: int | None = None,
) -> Run:
    """Profile, clean, chart, engineer, train and evaluate in that order, each plan from the table so far.

    ``max_rows`` bounds the rows that models learn from.
    """
    run = run_steps(df, eda_steps())
    run_steps(df, cleaning_steps(run.table), run=run)
    run_steps(df, chart_steps(run.table), run=run)
    goal = resolve_target(run.table, target)
    run_steps(df, feature_steps(run.table, goal), run=run)
    goal = resolve_target(run.table, goal)
    shared = {"target_column": goal, "max_rows": max_rows}
    forest = (params or {}).get("random_forest")
    modelling = [
        Step("auto_ml_pipeline", {**shared, "cv_folds": folds, "models": models, "params": params, "key": key}, "modeling"),
        Step("feature_importance", {**shared, "params": forest}, "modeling"),
        Step("model_evaluation", {**shared, "params": forest, "key": key}, "evaluation"),
    ]
    return run_steps(df, modelling, run=run)
