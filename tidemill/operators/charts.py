"""The numbers behind each chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.columns import (
    clean_nan,
    hash_unit,
    name,
    numeric_columns,
    pair_correlation,
    present,
    require,
    require_numeric,
    share,
    tidy,
)
from tidemill.functions.grouped import Groups, grouped_quantiles
from tidemill.functions.quantiles import exact_quantiles
from tidemill.operators.correlation import correlation_matrix
from tidemill.operators.profile import value_counts
from tidemill.session import checkpointed


def _bin(x: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin of x over [low, high]; the last bin is closed."""
    width = (high - low) / bins
    # ``least`` skips NULL, so a missing value needs its own test.
    return F.when(x.isNotNull(), F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1))).cast("int")


def _bin_edges(low: float, high: float) -> tuple[float, float]:
    # A constant column gets a unit interval around its value, as plotting libraries do.
    return (low - 0.5, high + 0.5) if low == high else (low, high)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """One row per bin, empty bins included, with the column's statistics on each row."""
    require_numeric(df, [column])
    x = present(column, df.schema[column].dataType).cast("double")
    stats = df.agg(F.avg(x), F.stddev_samp(x), F.min(x), F.max(x), F.count(x)).first()
    mean, std, low, high, count = stats
    spark = df.sparkSession
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if not count:
        return every.select("bin", F.lit(None).cast("double").alias("bin_start"), F.lit(0).cast("long").alias("count"))
    first, last = _bin_edges(low, high)
    counts = df.select(_bin(x, first, last, bins).alias("bin")).filter("bin IS NOT NULL")
    # The right side has at most ``bins`` rows.
    counts = counts.groupBy("bin").agg(F.count("*").alias("n"))
    width = (last - first) / bins
    return every.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        tidy(F.lit(first) + F.col("bin") * F.lit(width), 6).alias("bin_start"),
        tidy(F.lit(first) + (F.col("bin") + 1) * F.lit(width), 6).alias("bin_end"),
        F.coalesce("n", F.lit(0)).cast("long").alias("count"),
        tidy(F.lit(mean), 4).alias("mean"),
        tidy(F.lit(std).cast("double"), 4).alias("std"),
        F.lit(low).alias("min"),
        F.lit(high).alias("max"),
        F.lit(count).cast("long").alias("total"),
    )


def bar_chart(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """The most frequent non-null values with the number of distinct ones."""
    out = value_counts(df, column, top_n, keep_null=False)
    return out.select("value", "count", F.col("total_unique_values").alias("total_categories"))


OTHER = "(other)"


def top_groups(df: DataFrame, column: str, n: int) -> list[str]:
    """The n most frequent non-null values of a grouping column, as strings."""
    counts = df.groupBy(name(column).cast("string").alias("g")).agg(F.count("*").alias("n"))
    return [r["g"] for r in counts.filter("g IS NOT NULL").orderBy(F.desc("n"), "g").limit(n).collect()]


def scatter_grid(df: DataFrame, x: str, y: str, group: str | None = None, bins: int = 50) -> DataFrame:
    """Point counts on a grid over both axes, per group when one is named, with r on each row.

    Every group is kept; rows without a group count under null.

    A grid keeps every point in the picture and its size does not grow with the table.
    """
    require_numeric(df, [x, y])
    df = clean_nan(df)
    a, b = name(x).cast("double"), name(y).cast("double")
    x0, x1, y0, y1, r = df.agg(F.min(a), F.max(a), F.min(b), F.max(b), pair_correlation(a, b)).first()
    if x0 is None or y0 is None:
        raise ValueError("both columns need at least one value")
    (x0, x1), (y0, y1) = _bin_edges(x0, x1), _bin_edges(y0, y1)
    keys = [_bin(a, x0, x1, bins).alias("x_bin"), _bin(b, y0, y1, bins).alias("y_bin")]
    points = df.filter(name(x).isNotNull() & name(y).isNotNull())
    if group is not None:
        require(df, [group])
        keys.append(name(group).cast("string").alias("group"))
    return points.groupBy(*keys).agg(F.count("*").alias("count")).withColumn(
        "correlation", tidy(F.lit(r).cast("double"), 4)
    )


def scatter_sample(
    df: DataFrame, x: str, y: str, key: Sequence[str], points: int = 2000, color: str | None = None
) -> DataFrame:
    """About ``points`` raw points chosen by key hash, for drawing; repeatable for a given key."""
    require_numeric(df, [x, y])
    both = clean_nan(df).filter(name(x).isNotNull() & name(y).isNotNull())
    total = both.count()
    fraction = min(1.0, points / total) if total else 1.0
    cols = [name(c) for c in [*key, x, y, *([color] if color else [])]]
    return both.filter(hash_unit(key) < F.lit(fraction)).select(*cols)


def correlation_heatmap(df: DataFrame, method: str = "pearson", cols: Sequence[str] | None = None) -> DataFrame:
    """Lower triangle of the correlation matrix, diagonal included, in long form."""
    return correlation_matrix(df, method, cols, lower=True)


def box_plot(df: DataFrame, column: str | None = None, group_by: str | None = None, groups: int = 12) -> DataFrame:
    """Quartiles, whiskers and outliers per group.

    Whiskers end at the furthest value within 1.5 interquartile ranges of the box. Without
    ``column`` the first numeric column is taken. The most frequent ``groups`` have a row each; the rows
    of all others, and those without a group, make up one more, ``(other)``.
    """
    column = column or next(iter(numeric_columns(df)), None)
    if column is None:
        raise ValueError("no numeric column found")
    require_numeric(df, [column])
    x = present(column, df.schema[column].dataType).cast("double")
    if group_by is None:
        labels, label = [column], F.lit(column)
    else:
        require(df, [group_by])
        top, own = top_groups(df, group_by, groups), name(group_by).cast("string")
        labels, label = list(dict.fromkeys([*top, OTHER])), F.when(own.isin(top), own).otherwise(F.lit(OTHER))
    # At most a dozen groups and the rest, so each is one conditional target of the same few scans.
    targets = {g: F.when(label == F.lit(g), x) for g in labels}
    quartiles = exact_quantiles(df, targets, [0.25, 0.5, 0.75])
    wanted, rows = [F.count("*").alias("n")], []
    for i, g in enumerate(labels):
        q1, median, q3 = quartiles[g]
        if q1 is None:
            continue
        iqr = q3 - q1
        low, high = q1 - 1.5 * iqr, q3 + 1.5 * iqr
        v = targets[g]
        within = (v >= F.lit(low)) & (v <= F.lit(high))
        wanted += [
            F.count(v).alias(f"c{i}"),
            F.min(F.when(within, v)).alias(f"lo{i}"),
            F.max(F.when(within, v)).alias(f"hi{i}"),
            F.count_if(~within).alias(f"o{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(g).alias("group"),
                F.col(f"c{i}").alias("count"),
                tidy(F.lit(q1), 4).alias("q1"),
                tidy(F.lit(median), 4).alias("median"),
                tidy(F.lit(q3), 4).alias("q3"),
                tidy(F.lit(iqr), 4).alias("iqr"),
                tidy(F.lit(low), 4).alias("lower_bound"),
                tidy(F.lit(high), 4).alias("upper_bound"),
                F.col(f"lo{i}").alias("whisker_low"),
                F.col(f"hi{i}").alias("whisker_high"),
                F.col(f"o{i}").alias("outlier_count"),
                share(F.col(f"o{i}"), F.col("n")).alias("outlier_percentage"),
            )
        )
    if not rows:
        raise ValueError(f"column '{column}' has no values")
    return df.agg(*wanted).select(F.inline(F.array(*rows)))


def group_box_plots(df: DataFrame, column: str, group_by: str, groups: Sequence[str] | None = None) -> DataFrame:
    """The box of every group, or of the named ones, one row each, however many there are.

    Columns are those of ``box_plot``; the share of outliers is that of the group's values. Rows without a group make up
    none. Groups without a value have no row.
    """
    require_numeric(df, [column])
    require(df, [group_by])
    rows = df.select(name(group_by).cast("string").alias("g"), present(column, df.schema[column].dataType).cast("double").alias("x"))
    rows = rows.where("g is not null and x is not null")
    if groups is not None:
        rows = rows.where(F.col("g").isin(list(groups)))
    boxes = grouped_quantiles(rows, F.col("g"), F.col("x"), [0.25, 0.5, 0.75])
    iqr = F.col("q")[2] - F.col("q")[0]
    boxes = boxes.select("g", "n", "q", iqr.alias("iqr"), (F.col("q")[0] - 1.5 * iqr).alias("low"), (F.col("q")[2] + 1.5 * iqr).alias("high"))
    held = Groups.counted(checkpointed(boxes))
    x = F.col("x")
    within = (x >= F.col("low")) & (x <= F.col("high"))
    ends = held.join(rows, F.col("g"), ["low", "high"]).groupBy("g").agg(
        F.min(F.when(within, x)).alias("whisker_low"), F.max(F.when(within, x)).alias("whisker_high"), F.count_if(~within).alias("outlier_count"))
    q, near = [F.col("q")[i] for i in range(3)], lambda v: tidy(F.round(v, 7), 4)  # noqa: E731  a quarter of a large number is not exact
    return held.table.join(ends, "g").select(
        F.col("g").alias("group"), F.col("n").alias("count"), *[near(v).alias(k) for k, v in zip(("q1", "median", "q3"), q)], near(F.col("iqr")).alias("iqr"),
        near(F.col("low")).alias("lower_bound"), near(F.col("high")).alias("upper_bound"), "whisker_low", "whisker_high", "outlier_count",
        share(F.col("outlier_count"), F.col("n")).alias("outlier_percentage"),
    )
