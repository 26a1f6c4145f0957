"""Column classes, null rules, rounding and moment formulas."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)

# A string column counts as categorical below either bound.
CATEGORY_DISTINCT = 50
CATEGORY_SHARE = 0.05


def type_class(data_type: T.DataType) -> str:
    """numeric, boolean, datetime, string or other, from the schema alone."""
    if isinstance(data_type, NUMERIC):
        return "numeric"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, TEMPORAL):
        return "datetime"
    if isinstance(data_type, T.StringType):
        return "string"
    return "other"


def columns_of(df: DataFrame, wanted: str) -> list[str]:
    return [f.name for f in df.schema.fields if type_class(f.dataType) == wanted]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "numeric")


def string_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "string")


def scalar_columns(df: DataFrame) -> list[str]:
    """Columns that can be compared, counted and grouped one value at a time."""
    return [f.name for f in df.schema.fields if type_class(f.dataType) != "other"]


def require(df: DataFrame, cols: Iterable[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; available: {df.columns}")


def require_numeric(df: DataFrame, cols: Iterable[str]) -> None:
    cols = list(cols)
    require(df, cols)
    wrong = [c for c in cols if type_class(df.schema[c].dataType) != "numeric"]
    if wrong:
        raise ValueError(f"columns are not numeric: {wrong}")


def pick_numeric(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    """``cols`` after a check, or every numeric column when none are named."""
    if cols is None:
        return numeric_columns(df)
    require_numeric(df, cols)
    return list(cols)


def name(column: str) -> Column:
    """A column reference that is safe for names with dots, colons or spaces."""
    return F.col("`" + column.replace("`", "``") + "`")


def present(column: str, data_type: T.DataType) -> Column:
    """The column with floating NaN read as missing."""
    c = name(column)
    return F.nanvl(c, F.lit(None).cast(data_type)) if isinstance(data_type, FLOATING) else c


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, so that aggregates skip it."""
    floating = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, FLOATING)}
    if not floating:
        return df
    return df.select(*[present(c, floating[c]).alias(c) if c in floating else name(c) for c in df.columns])


def tidy(value: Column, places: int) -> Column:
    """Round for a report; the first, finer rounding absorbs summation-order noise."""
    return F.round(F.round(value.cast("double"), places + 6), places)


def share(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole`` with 2 decimals, NULL for an empty whole."""
    return tidy(F.try_divide(part.cast("double"), whole.cast("double")) * 100, 2)


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness: 0 on a constant column, NULL below 3 values."""
    n = F.count(x).cast("double")
    corrected = F.skewness(x) * F.sqrt(n * F.greatest(n - 1, F.lit(0.0)))
    return F.when(n >= 3, F.coalesce(F.try_divide(corrected, n - 2), F.lit(0.0)))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis: 0 on a constant column, NULL below 4 values."""
    n = F.count(x).cast("double")
    factor = F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when(n >= 4, F.coalesce(factor * ((n + 1) * F.kurtosis(x) + 6), F.lit(0.0)))


def pair_correlation(x: Column, y: Column) -> Column:
    """Pearson r over rows where both are present; NULL when either is constant there."""
    a = F.when(y.isNotNull(), x)
    b = F.when(x.isNotNull(), y)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    # ``least`` and ``greatest`` skip NULL, so an undefined r needs its own test.
    return F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def hash_unit(keys: Sequence[str | Column], seed: int = 42) -> Column:
    """A repeatable uniform number in [0, 1) for each key, independent of partitioning."""
    parts = [name(k) if isinstance(k, str) else k for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def row_key(df: DataFrame) -> list[str]:
    """Columns that stand in for a key where none is named; equal rows hash alike."""
    return scalar_columns(df)
