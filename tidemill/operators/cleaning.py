"""Missing values, duplicates and outliers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.columns import (
    clean_nan,
    name,
    present,
    require,
    require_numeric,
    share,
    tidy,
)
from tidemill.functions.order import forward_carry
from tidemill.functions.quantiles import exact_medians, exact_quantiles


def drop_columns(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    cols = [cols] if isinstance(cols, str) else list(cols)
    require(df, cols)
    return df.drop(*cols)


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    """Rows where ``column`` is present."""
    require(df, [column])
    return df.filter(present(column, df.schema[column].dataType).isNotNull())


def most_common(df: DataFrame, column: str):
    """The most frequent non-null value, smallest on ties; None when there is none."""
    x = present(column, df.schema[column].dataType)
    counts = df.select(x.alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    top = counts.agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("v"))).alias("t")).first()["t"]
    return None if top is None else top["v"]


def fit_fill(df: DataFrame, column: str, strategy: str):
    """The value that replaces missing entries of ``column`` under mean, median or mode."""
    if strategy == "mode":
        require(df, [column])
        return most_common(df, column)
    require_numeric(df, [column])
    if strategy == "mean":
        return df.agg(F.avg(present(column, df.schema[column].dataType).cast("double"))).first()[0]
    if strategy == "median":
        return exact_medians(df, [column])[column]
    raise ValueError(f"unknown strategy '{strategy}'")


def apply_fill(df: DataFrame, column: str, value) -> DataFrame:
    """Replace missing entries; an integer column turns double when the value has a fraction."""
    if value is None:
        return df
    data_type = df.schema[column].dataType
    x = present(column, data_type)
    if isinstance(value, float) and not isinstance(data_type, (type(None),)):
        whole = value.is_integer() and data_type.typeName() not in ("double", "float")
        x, filler = (x, F.lit(value).cast(data_type)) if whole else (x.cast("double"), F.lit(value))
    else:
        filler = F.lit(value).cast(data_type)
    return df.withColumn(column, F.coalesce(x, filler))


def fill_missing(
    df: DataFrame,
    column: str,
    strategy: str,
    order_by: Sequence[str] | None = None,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Fill or drop missing entries of one column.

    ``strategy`` is mean, median, mode, forward_fill or drop. A forward fill needs ``order_by``,
    since Spark rows have no order of their own.
    """
    require(df, [column])
    if strategy == "drop":
        return drop_missing(df, column)
    if strategy == "forward_fill":
        if not order_by:
            raise ValueError("forward_fill needs order_by")
        x = present(column, df.schema[column].dataType)
        return forward_carry(df.withColumn(column, x), [column], order_by, partition_by)
    return apply_fill(df, column, fit_fill(df, column, strategy))


def fill_report(before: DataFrame, after: DataFrame, column: str, strategy: str) -> DataFrame:
    """One row: missing entries before and after, rows after."""
    old = clean_nan(before).agg(F.count_if(name(column).isNull()).alias("n"))
    new = clean_nan(after).agg(F.count_if(name(column).isNull()).alias("nulls_after"), F.count("*").alias("rows_after"))
    return new.select(
        F.lit(column).alias("column"),
        F.lit(strategy).alias("strategy"),
        old.scalar().alias("nulls_before"),
        "nulls_after",
        "rows_after",
    )


def remove_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str = "first",
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Keep one row of each group of equal rows; NULL equals NULL.

    With a ``subset``, ``order_by`` says which row is first or last. The choice is an aggregate,
    so a group of many copies shrinks to one row per map task before any shuffle.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    if subset is None:
        return df.dropDuplicates()
    require(df, subset)
    rest = [c for c in df.columns if c not in subset]
    if not rest:
        return df.dropDuplicates(list(subset))
    if not order_by:
        raise ValueError("order_by is needed to tell the first from the last copy")
    require(df, order_by)
    pick = F.min_by if keep == "first" else F.max_by
    place = F.struct(*[name(c) for c in order_by])
    chosen = df.groupBy(*[name(c) for c in subset]).agg(
        pick(F.struct(*[name(c) for c in rest]), place).alias("__row")
    )
    return chosen.select(
        *[name(c) if c in subset else F.col("__row").getField(c).alias(c) for c in df.columns]
    )


def duplicate_report(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row: rows before, copies removed and rows remaining."""
    cols = list(subset) if subset is not None else df.columns
    require(df, cols)
    groups = df.groupBy(*[name(c) for c in cols]).agg(F.count("*").alias("__n"))
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("original_rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates_removed"),
        F.count("*").alias("rows_remaining"),
    )


@dataclass(frozen=True)
class OutlierRule:
    """Fitted limits of one numeric column."""

    column: str
    method: str
    threshold: float
    lower: float | None = None
    upper: float | None = None
    mean: float | None = None
    std: float | None = None

    def outlier(self, df: DataFrame) -> Column:
        """True where the value lies outside the limits; missing values are never outliers."""
        return F.coalesce(~self._within(df), F.lit(False))

    def keep(self, df: DataFrame) -> Column:
        """True where the value is present and within the limits."""
        return F.coalesce(self._within(df), F.lit(False))

    def _within(self, df: DataFrame) -> Column:
        x = present(self.column, df.schema[self.column].dataType).cast("double")
        if self.method == "iqr":
            if self.lower is None:
                return x.isNotNull()
            return (x >= F.lit(self.lower)) & (x <= F.lit(self.upper))
        if not self.std:
            # All values are equal: none of them is unusual.
            return F.when(x.isNotNull(), True)
        return F.abs((x - F.lit(self.mean)) / F.lit(self.std)) <= F.lit(self.threshold)


def fit_outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> OutlierRule:
    """Limits by quartiles (``iqr``) or by distance from the mean in sample deviations (``zscore``)."""
    require_numeric(df, [column])
    x = present(column, df.schema[column].dataType).cast("double")
    if method == "iqr":
        q1, q3 = exact_quantiles(df, {column: x}, [0.25, 0.75])[column]
        if q1 is None:
            return OutlierRule(column, method, threshold)
        reach = threshold * (q3 - q1)
        return OutlierRule(column, method, threshold, lower=q1 - reach, upper=q3 + reach)
    if method == "zscore":
        mean, std = df.agg(F.avg(x), F.stddev_samp(x)).first()
        return OutlierRule(column, method, threshold, mean=mean, std=std)
    raise ValueError(f"unknown method '{method}'")


def detect_outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """One row: how many rows lie outside the limits, their percentage and the limits."""
    rule = fit_outliers(df, column, method, threshold)
    counted = df.agg(F.count_if(rule.outlier(df)).alias("outlier_count"), F.count("*").alias("total_rows"))
    return counted.select(
        F.lit(column).alias("column"),
        F.lit(method).alias("method"),
        F.lit(float(threshold)).alias("threshold"),
        "outlier_count",
        share(F.col("outlier_count"), F.col("total_rows")).alias("outlier_percentage"),
        "total_rows",
        tidy(F.lit(rule.lower), 6).alias("lower_bound"),
        tidy(F.lit(rule.upper), 6).alias("upper_bound"),
    )


def remove_outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Rows within the limits; rows where the column is missing go too."""
    return df.filter(fit_outliers(df, column, method, threshold).keep(df))


def removal_report(before: DataFrame, rule: OutlierRule) -> DataFrame:
    """One row: rows removed, remaining and percentage removed."""
    counted = before.agg(F.count("*").alias("n"), F.count_if(rule.keep(before)).alias("rows_remaining"))
    removed = F.col("n") - F.col("rows_remaining")
    return counted.select(
        F.lit(rule.column).alias("column"),
        removed.alias("rows_removed"),
        "rows_remaining",
        share(removed, F.col("n")).alias("removal_percentage"),
    )
