"""Column profiles, overviews, frequency tables and the data-quality report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from tidemill.functions.columns import (
    CATEGORY_DISTINCT,
    CATEGORY_SHARE,
    clean_nan,
    name,
    numeric_columns,
    present,
    require,
    sample_kurtosis,
    sample_skewness,
    scalar_columns,
    share,
    string_columns,
    tidy,
    type_class,
)
from tidemill.functions.jobs import together
from tidemill.functions.quantiles import exact_quantiles


def _long_form(wide: DataFrame, rows: Sequence[Sequence[tuple[str, Column]]]) -> DataFrame:
    """Turn one wide row of aggregates into one row per column, inside Spark."""
    return wide.select(F.inline(F.array(*[F.struct(*[v.alias(k) for k, v in r]) for r in rows])))


def missing_values(df: DataFrame, include_complete: bool = False) -> DataFrame:
    """Columns that have missing values, in table order, with count and percentage of rows."""
    df = clean_nan(df)
    wide = df.agg(
        F.count("*").alias("n"),
        *[(F.count("*") - F.count(name(c))).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    out = _long_form(
        wide,
        [
            [
                ("position", F.lit(i)),
                ("column", F.lit(c)),
                ("null_count", F.col(f"m{i}")),
                ("null_percentage", share(F.col(f"m{i}"), F.col("n"))),
                ("total_rows", F.col("n")),
            ]
            for i, c in enumerate(df.columns)
        ],
    )
    return out if include_complete else out.filter("null_count > 0")


def distinct_counts(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> dict[str, int]:
    """Distinct non-null values of each column, a job for each: two exact counts in one would double the rows.

    The exact form aggregates (column, value) on the map side before its shuffle, so frequent
    values cost nothing; the approximate form keeps one fixed-size sketch per column.
    """
    if not cols:
        return {}
    count = F.approx_count_distinct if approximate else F.count_distinct

    def job(part: Sequence[str]):
        return lambda: df.agg(*[count(name(c)).alias(f"d{i}") for i, c in enumerate(part)]).first()

    width = 8 if approximate else 1
    rows = together([job(cols[i : i + width]) for i in range(0, len(cols), width)])
    return dict(zip(cols, (v for row in rows for v in row)))


def describe(df: DataFrame, cols: Sequence[str]) -> dict[str, Row]:
    """count, mean, std, min, max, skewness and kurtosis of numeric columns.

    Two columns per job: each job reads only its own columns, and its code stays small enough
    for the JVM to compile.
    """
    cols = list(cols)

    def job(part: Sequence[str]):
        wanted = []
        for i, c in enumerate(part):
            x = present(c, df.schema[c].dataType).cast("double")
            wanted.append(
                F.struct(
                    F.count(x).alias("count"),
                    F.avg(x).alias("mean"),
                    F.stddev_samp(x).alias("std"),
                    F.min(x).alias("min"),
                    F.max(x).alias("max"),
                    sample_skewness(x).alias("skewness"),
                    sample_kurtosis(x).alias("kurtosis"),
                ).alias(f"s{i}")
            )
        return lambda: df.agg(*wanted).first()

    rows = together([job(cols[i : i + 2]) for i in range(0, len(cols), 2)])
    return dict(zip(cols, (v for row in rows for v in row)))


def _rounded(value: float | None, places: int) -> Column:
    return tidy(F.lit(value).cast("double"), places)


def column_profile(df: DataFrame, approximate_distinct: bool = False, samples: int = 5, sample_order: Sequence[str] | None = None) -> DataFrame:
    """One row per column: type, class, missing, distinct, numeric statistics and sample values.

    With ``sample_order`` samples are the first present values in that order, else those of some leading rows.
    """
    df = clean_nan(df)
    scalars, numbers = scalar_columns(df), numeric_columns(df)
    gaps, distinct, stats, quartiles, seen = together(
        [
            lambda: missing_values(df, include_complete=True).collect(),
            lambda: distinct_counts(df, scalars, approximate_distinct),
            lambda: describe(df, numbers),
            lambda: exact_quantiles(df, {c: name(c) for c in numbers}, [0.25, 0.5, 0.75]),
            lambda: _samples(df, samples, sample_order),
        ]
    )
    nulls = {r["column"]: r for r in gaps}
    rows = []
    for i, field in enumerate(df.schema.fields):
        c = field.name
        total, unique = nulls[c]["total_rows"], distinct.get(c)
        s, q = stats.get(c), quartiles.get(c, [None] * 3)
        rows.append(
            (
                i, c, field.dataType.simpleString(), _profile_class(field, unique, total),
                total, nulls[c]["null_count"], nulls[c]["null_percentage"], unique,
                *([s["mean"], q[1], s["std"], s["min"], s["max"], q[0], q[2], s["skewness"], s["kurtosis"]]
                  if s else [None] * 9),
                seen[c],
            )
        )
    schema = (
        "position int, column string, dtype string, class string, total_rows long, null_count long,"
        "null_percentage double, unique_count long, mean double, median double, std double, min double,"
        "max double, q25 double, q75 double, skewness double, kurtosis double, samples array<string>"
    )
    out = df.sparkSession.createDataFrame(rows, schema)
    rounded = {"mean", "median", "std", "q25", "q75", "skewness", "kurtosis"}
    return out.select(*[tidy(F.col(c), 4).alias(c) if c in rounded else F.col(c) for c in out.columns])


def _profile_class(field: T.StructField, unique: int | None, total: int) -> str:
    kind = type_class(field.dataType)
    if kind != "string":
        return kind
    few = unique < CATEGORY_DISTINCT or (total > 0 and unique / total < CATEGORY_SHARE)
    return "categorical" if few else "text"


def _samples(df: DataFrame, n: int, order: Sequence[str] | None = None) -> dict[str, list[str]]:
    """The first few non-null values of each column; a column with gaps is searched as far as needed."""
    if n < 1:
        return {c: [] for c in df.columns}
    if order is not None:
        require(df, order)

        def first(c: str):
            # Each task keeps its first few rows only.
            rows = df.where(name(c).isNotNull()).select(name(c).cast("string").alias("v"), *[name(k).alias(f"k{i}") for i, k in enumerate(order)])
            return lambda: [r["v"] for r in rows.orderBy(*[f"k{i}" for i in range(len(order))]).limit(n).collect()]

        return dict(zip(df.columns, together([first(c) for c in df.columns])))
    head = df.select(*[name(c).cast("string").alias(c) for c in df.columns]).limit(20 * n).collect()
    found = {c: [r[i] for r in head if r[i] is not None][:n] for i, c in enumerate(df.columns)}
    if len(head) == 20 * n:
        for c in [c for c, values in found.items() if len(values) < n]:
            some = df.select(name(c).cast("string").alias("v")).filter("v IS NOT NULL").limit(n)
            found[c] = [r["v"] for r in some.collect()]
    return found


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """The leading rows of a table, for a preview."""
    return df.limit(n)


def column_classes(df: DataFrame, approximate_distinct: bool = False) -> DataFrame:
    """(column, dtype, class): the type lists of a table, strings split into categorical and text."""
    strings = string_columns(df)
    total = df.count() if strings else 0
    distinct = distinct_counts(df, strings, approximate_distinct)
    rows = [
        (i, f.name, f.dataType.simpleString(), _profile_class(f, distinct.get(f.name), total))
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string, class string")


def value_frequencies(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n) for several columns from one scan and one pre-aggregated shuffle."""
    pairs = [F.struct(F.lit(c).alias("column"), name(c).cast("string").alias("value")) for c in cols]
    return df.select(F.inline(F.array(*pairs))).groupBy("column", "value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: distinct values, the most frequent one (smallest on ties) and its count."""
    counts = value_frequencies(df, cols).filter("value IS NOT NULL")
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("value").alias("v")))
    return counts.groupBy("column").agg(F.count("*").alias("unique_count"), best.alias("top")).select(
        "column",
        "unique_count",
        F.col("top.v").alias("most_frequent"),
        (-F.col("top.m")).alias("most_frequent_count"),
    )


def dataset_overview(df: DataFrame) -> DataFrame:
    """One row per column with the short statistics of its class, plus table totals on each row."""
    df = clean_nan(df)
    numbers, strings = numeric_columns(df), string_columns(df)
    gaps, stats, median, tops = together(
        [
            lambda: missing_values(df, include_complete=True).collect(),
            lambda: describe(df, numbers),
            lambda: exact_quantiles(df, {c: name(c) for c in numbers}, [0.5]),
            lambda: top_values(df, strings).collect() if strings else [],
        ]
    )
    nulls, tops = {r["column"]: r for r in gaps}, {r["column"]: r for r in tops}
    total_missing = sum(r["null_count"] for r in nulls.values())
    with_missing = sum(1 for r in nulls.values() if r["null_count"])
    rows = []
    for i, f in enumerate(df.schema.fields):
        c, s, t = f.name, stats.get(f.name), tops.get(f.name)
        rows.append(
            (
                i, c, type_class(f.dataType), nulls[c]["total_rows"], len(df.columns), nulls[c]["null_count"],
                total_missing, with_missing,
                *([s["mean"], s["std"], median[c][0], s["min"], s["max"]] if s else [None] * 5),
                *([t["unique_count"], t["most_frequent"], t["most_frequent_count"]] if t else [None] * 3),
            )
        )
    schema = (
        "position int, column string, class string, total_rows long, total_columns int, null_count long,"
        "total_missing long, columns_with_missing int, mean double, std double, median double, min double,"
        "max double, unique_count long, most_frequent string, most_frequent_count long"
    )
    out = df.sparkSession.createDataFrame(rows, schema)
    cells = F.col("total_rows") * F.col("total_columns")
    rounded = {"mean", "std", "median"}
    return out.select(
        *[tidy(F.col(c), 2).alias(c) if c in rounded else F.col(c) for c in out.columns],
        share(F.col("total_missing"), cells).alias("missing_percentage"),
    )


def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None, first: int | None = None) -> DataFrame:
    """Mean, std and range of numeric columns; ``first`` keeps the leading ones of the table."""
    cols = list(cols) if cols is not None else numeric_columns(df)[:first]
    wide = df.agg(
        *[
            F.struct(
                F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")
            ).alias(f"s{i}")
            for i, c in enumerate(cols)
            for x in [present(c, df.schema[c].dataType).cast("double")]
        ]
    )
    rows = [
        [
            ("column", F.lit(c)),
            ("mean", tidy(F.col(f"s{i}.mean"), 4)),
            ("std", tidy(F.col(f"s{i}.std"), 4)),
            ("min", F.col(f"s{i}.min")),
            ("max", F.col(f"s{i}.max")),
        ]
        for i, c in enumerate(cols)
    ]
    return _long_form(wide, rows)


def column_statistics(df: DataFrame, column: str) -> DataFrame:
    """Statistics of one column as a single row; numeric or categorical fields by its class."""
    require(df, [column])
    df = clean_nan(df.select(name(column)))
    numeric = type_class(df.schema[column].dataType) == "numeric"
    if not numeric:
        counts = df.groupBy(name(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
        present_only = F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("m"), F.col("value").alias("v")))
        top5 = counts.filter("value IS NOT NULL").orderBy(F.desc("n"), "value").limit(5)
        listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("value").alias("v"))))
        top5 = top5.agg(F.transform(listed, lambda s: F.concat_ws("=", s["v"], (-s["m"]).cast("string"))).alias("t"))
        wide = counts.agg(
            F.sum("n").alias("total"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.count("value").alias("unique"),
            F.min(present_only).alias("top"),
        )
        return wide.select(
            F.lit(column).alias("column"),
            F.col("total").alias("total_count"),
            F.col("nulls").alias("null_count"),
            share(F.col("nulls"), F.col("total")).alias("null_percentage"),
            F.col("unique").alias("unique_count"),
            F.col("top.v").alias("most_frequent"),
            (-F.col("top.m")).alias("most_frequent_count"),
            top5.scalar().alias("top_5_values"),
        )
    q25, median, q75 = exact_quantiles(df, {column: name(column)}, [0.25, 0.5, 0.75])[column]
    x = name(column).cast("double")
    wide = df.agg(
        F.count("*").alias("total"),
        F.count_if(name(column).isNull()).alias("nulls"),
        F.count_distinct(name(column)).alias("unique"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        sample_skewness(x).alias("skewness"),
        sample_kurtosis(x).alias("kurtosis"),
    )
    return wide.select(
        F.lit(column).alias("column"),
        F.col("total").alias("total_count"),
        F.col("nulls").alias("null_count"),
        share(F.col("nulls"), F.col("total")).alias("null_percentage"),
        F.col("unique").alias("unique_count"),
        tidy(F.col("mean"), 4).alias("mean"),
        _rounded(median, 4).alias("median"),
        tidy(F.col("std"), 4).alias("std"),
        "min",
        "max",
        _rounded(q25, 4).alias("q25"),
        _rounded(q75, 4).alias("q75"),
        tidy(F.col("skewness"), 4).alias("skewness"),
        tidy(F.col("kurtosis"), 4).alias("kurtosis"),
    )


def value_counts(
    df: DataFrame, column: str, top_n: int = 10, normalize: bool = False, keep_null: bool = True
) -> DataFrame:
    """The ``top_n`` most frequent values (smallest value first on ties) with share and totals.

    The totals come from a scalar subquery over the same pre-aggregated counts.
    """
    require(df, [column])
    df = clean_nan(df.select(name(column)))
    counts = df.groupBy(name(column).alias("v")).agg(F.count("*").alias("n"))
    totals = counts.agg(
        F.struct(F.sum("n").alias("rows"), F.count("v").alias("distinct"), F.count("*").alias("shown")).alias("t")
    )
    listed = counts if keep_null else counts.filter("v IS NOT NULL")
    top = listed.orderBy(F.desc("n"), F.asc_nulls_last("v")).limit(top_n)
    top = top.withColumn("t", totals.scalar())
    fraction = F.try_divide(F.col("n").cast("double"), F.col("t.rows").cast("double"))
    return top.select(
        F.coalesce(F.col("v").cast("string"), F.lit("NULL")).alias("value"),
        (tidy(fraction, 4) if normalize else F.col("n")).alias("fraction" if normalize else "count"),
        share(F.col("n"), F.col("t.rows")).alias("percentage"),
        F.col("t.distinct").alias("total_unique_values"),
        F.col("t.rows").alias("total_rows"),
        F.least(F.lit(top_n).cast("long"), F.col("t.shown")).alias("showing_top"),
    )


def duplicate_count(df: DataFrame, digest: bool = False) -> DataFrame:
    """Rows equal to an earlier row, as count and percentage; NULL equals NULL.

    Equal rows collapse before the shuffle. ``digest`` shuffles a 256-bit hash of each row in
    place of the row itself, which is much less for wide tables.
    """
    cols = [name(c) for c in df.columns]
    keys = [F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256).alias("h")] if digest else cols
    groups = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum("__n"), F.lit(0)).alias("total_rows"),
    ).select("duplicate_rows", share(F.col("duplicate_rows"), F.col("total_rows")).alias("duplicate_percentage"), "total_rows")


def data_quality_report(df: DataFrame, digest: bool = False) -> DataFrame:
    """Long-form checks (check, item, value, flagged): size, missing, duplicates, types, issues."""
    df = clean_nan(df)
    nulls, distinct, copies = together(
        [
            lambda: missing_values(df, include_complete=True).collect(),
            lambda: distinct_counts(df, scalar_columns(df)),
            lambda: duplicate_count(df, digest).first(),
        ]
    )
    rows_total, width = copies["total_rows"], len(df.columns)
    missing = sum(r["null_count"] for r in nulls)
    affected = [r for r in nulls if r["null_count"]]
    cells = rows_total * width
    out = [
        ("size", "rows", float(rows_total), None),
        ("size", "columns", float(width), None),
        ("missing", "total_missing", float(missing), bool(cells and missing / cells > 0.1)),
        ("missing", "columns_affected", float(len(affected)), None),
        ("duplicates", "duplicate_rows", float(copies["duplicate_rows"]),
         bool(rows_total and copies["duplicate_rows"] / rows_total > 0.05)),
        ("duplicates", "duplicate_percentage", copies["duplicate_percentage"], None),
    ]
    for r in sorted(affected, key=lambda r: (-r["null_count"], r["position"]))[:5]:
        out.append(("worst_missing", r["column"], r["null_percentage"], None))
    kinds: dict[str, int] = {}
    for f in df.schema.fields:
        kinds[f.dataType.simpleString()] = kinds.get(f.dataType.simpleString(), 0) + 1
    out += [("dtype", k, float(v), None) for k, v in sorted(kinds.items())]
    out += [("constant_column", c, float(n), True) for c, n in distinct.items() if n <= 1]
    out += [
        ("high_cardinality", c, float(distinct[c]), True)
        for c in string_columns(df)
        if distinct[c] > 0.8 * rows_total
    ]
    return df.sparkSession.createDataFrame(out, "check string, item string, value double, flagged boolean")


def problem_type(df: DataFrame, target: str) -> str:
    """classification or regression, from the type and distinct share of the target."""
    require(df, [target])
    if type_class(df.schema[target].dataType) != "numeric":
        return "classification"
    x = present(target, df.schema[target].dataType)
    unique, n = df.agg(F.count_distinct(x), F.count(x)).first()
    return "classification" if unique <= 10 or (n and unique / n < 0.05) else "regression"


def problem_types(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The problem type of several candidate targets, from their counts and distinct counts."""
    require(df, cols)
    known = clean_nan(df)
    distinct = distinct_counts(known, cols)
    wide = known.agg(*[F.struct(F.lit(distinct[c]).cast("bigint").alias("u"), F.count(name(c)).alias("n")).alias(f"c{i}") for i, c in enumerate(cols)])
    rows = []
    for i, c in enumerate(cols):
        u, n = F.col(f"c{i}.u"), F.col(f"c{i}.n")
        few = (u <= 10) | F.coalesce(F.try_divide(u.cast("double"), n.cast("double")) < 0.05, F.lit(False))
        numeric = type_class(df.schema[c].dataType) == "numeric"
        verdict = F.when(few | F.lit(not numeric), "classification").otherwise("regression")
        rows.append([("column", F.lit(c)), ("unique_count", u), ("non_null", n), ("problem_type", verdict)])
    return _long_form(wide, rows)
