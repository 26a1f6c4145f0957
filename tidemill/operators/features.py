"""Fitted feature transforms.

``fit_*`` runs aggregates and returns a small ``Fitted`` with exact parameters; ``apply`` turns these
into column expressions, so it costs no extra job and works on streams as well.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.columns import (
    name,
    numeric_columns,
    pick_numeric,
    present,
    require,
    require_numeric,
    sample_skewness,
    string_columns,
    tidy,
)
from tidemill.functions.jobs import together
from tidemill.functions.order import global_index, lookup_by_value
from tidemill.functions.quantiles import exact_medians, exact_quantiles, run_aggregates
from tidemill.session import scratch_path

ONE_HOT_LIMIT = 2_000
LABEL_INLINE_LIMIT = 5_000
MISSING_LABEL = "nan"


@dataclass(frozen=True)
class Fitted:
    """A transform with its parameters; everything in ``params`` survives JSON."""

    kind: str
    params: dict = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        return APPLIERS[self.kind](df, self.params)

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "params": self.params}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Fitted:
        data = json.loads(text)
        return Fitted(data["kind"], data["params"])


def _number(df: DataFrame, c: str) -> Column:
    return present(c, df.schema[c].dataType).cast("double")


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Swap columns in place, keeping their order."""
    return df.select(*[new[c].alias(c) if c in new else name(c) for c in df.columns])


# Scaling: every scaler is (x - shift) / scale * stretch + base.


def _fit_linear(kind: str, cols: Sequence[str], shift: list, scale: list, base: float = 0.0, stretch: float = 1.0) -> Fitted:
    scale = [1.0 if not s else s for s in scale]
    shift = [0.0 if m is None else m for m in shift]
    return Fitted("linear", {"scaler": kind, "cols": list(cols), "shift": shift, "scale": scale, "base": base, "stretch": stretch})


def _apply_linear(df: DataFrame, p: dict) -> DataFrame:
    new = {}
    for c, shift, scale in zip(p["cols"], p["shift"], p["scale"]):
        if c in df.columns:
            x = (_number(df, c) - F.lit(shift)) / F.lit(scale)
            if p["stretch"] != 1.0 or p["base"] != 0.0:
                x = x * F.lit(p["stretch"]) + F.lit(p["base"])
            new[c] = x
    return _replace(df, new)


def fit_standard_scaler(df: DataFrame, cols: Sequence[str] | None = None) -> Fitted:
    """Zero mean and unit population deviation; a constant column is only centred."""
    cols = pick_numeric(df, cols)
    row = run_aggregates(df, [f(_number(df, c)) for c in cols for f in (F.avg, F.stddev_pop)])
    return _fit_linear("standard", cols, row[0::2], row[1::2])


def fit_min_max_scaler(df: DataFrame, cols: Sequence[str] | None = None, low: float = 0.0, high: float = 1.0) -> Fitted:
    """Rescale to [low, high]; a constant column becomes ``low``."""
    if high <= low:
        raise ValueError("high must exceed low")
    cols = pick_numeric(df, cols)
    row = run_aggregates(df, [f(_number(df, c)) for c in cols for f in (F.min, F.max)])
    lows, highs = row[0::2], row[1::2]
    ranges = [None if a is None else b - a for a, b in zip(lows, highs)]
    return _fit_linear("min_max", cols, lows, ranges, float(low), float(high - low))


def fit_robust_scaler(df: DataFrame, cols: Sequence[str] | None = None) -> Fitted:
    """Centre on the median and divide by the interquartile range."""
    cols = pick_numeric(df, cols)
    q = exact_quantiles(df, {c: _number(df, c) for c in cols}, [0.25, 0.5, 0.75])
    spread = [None if q[c][0] is None else q[c][2] - q[c][0] for c in cols]
    return _fit_linear("robust", cols, [q[c][1] for c in cols], spread)


def scaling_report(before: DataFrame, fitted: Fitted) -> DataFrame:
    """Mean and sample deviation of each scaled column before and after, from one scan."""
    cols = fitted.params["cols"]
    after = fitted.apply(before.select(*[name(c) for c in cols]))
    both = before.select(
        *[_number(before, c).alias(f"b{i}") for i, c in enumerate(cols)],
        *[expr.alias(f"a{i}") for i, expr in enumerate(_linear_exprs(before, fitted.params))],
    )
    wide = both.agg(
        *[f(f"{side}{i}").alias(f"{side}{i}_{f.__name__}") for side in "ab" for i in range(len(after.columns)) for f in (F.avg, F.stddev_samp)]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            tidy(F.col(f"b{i}_avg"), 4).alias("mean_before"),
            tidy(F.col(f"b{i}_stddev_samp"), 4).alias("std_before"),
            tidy(F.col(f"a{i}_avg"), 4).alias("mean_after"),
            tidy(F.col(f"a{i}_stddev_samp"), 4).alias("std_after"),
        )
        for i, c in enumerate(cols)
    ]
    return wide.select(F.inline(F.array(*rows)))


def _linear_exprs(df: DataFrame, p: dict) -> list[Column]:
    return [
        (_number(df, c) - F.lit(shift)) / F.lit(scale) * F.lit(p["stretch"]) + F.lit(p["base"])
        for c, shift, scale in zip(p["cols"], p["shift"], p["scale"])
    ]


# Logarithm


def fit_log_transform(df: DataFrame, column: str) -> Fitted:
    """log(1 + x) of a column without negative values."""
    require_numeric(df, [column])
    low = df.agg(F.min(_number(df, column))).first()[0]
    if low is not None and low < 0:
        raise ValueError(f"column '{column}' has negative values")
    return Fitted("log1p", {"column": column})


def _apply_log(df: DataFrame, p: dict) -> DataFrame:
    c = p["column"]
    return _replace(df, {c: F.log1p(_number(df, c))}) if c in df.columns else df


def log_report(df: DataFrame, column: str) -> DataFrame:
    """Skewness before and after log1p and the gain in absolute skewness."""
    x = _number(df, column)
    s = df.agg(tidy(sample_skewness(x), 4).alias("skewness_before"), tidy(sample_skewness(F.log1p(x)), 4).alias("skewness_after"))
    gain = F.abs("skewness_before") - F.abs("skewness_after")
    return s.select(F.lit(column).alias("column"), "skewness_before", "skewness_after", tidy(gain, 4).alias("improvement"))


# Encoders


def _text(df: DataFrame, c: str) -> Column:
    return present(c, df.schema[c].dataType).cast("string")


def categories(df: DataFrame, cols: Sequence[str], limit: int = ONE_HOT_LIMIT) -> dict[str, list[str] | None]:
    """The sorted distinct values of each column, None when there are more than ``limit``."""
    out = {}
    for c in cols:
        found = df.select(_text(df, c).alias("v")).filter("v IS NOT NULL").distinct().limit(limit + 1).collect()
        out[c] = sorted(r["v"] for r in found) if len(found) <= limit else None
    return out


def fit_one_hot(df: DataFrame, cols: Sequence[str] | None = None, drop_first: bool = True, limit: int = ONE_HOT_LIMIT) -> Fitted:
    """One 0/1 column per category, named ``column_value``; a missing value is all zeros.

    A column with more than ``limit`` categories becomes one sparse vector, ``<column>_vec``, instead.
    """
    cols = list(cols) if cols is not None else string_columns(df)
    require(df, cols)
    found = categories(df, cols, limit)
    many = [fit_label_encoder(df.filter(_text(df, c).isNotNull()), c).params for c in cols if found[c] is None]
    few = {c: v for c, v in found.items() if v is not None}
    return Fitted("one_hot", {"categories": few, "drop_first": drop_first, "vectors": many})


def _apply_one_hot(df: DataFrame, p: dict) -> DataFrame:
    for labels in p.get("vectors", []):
        df = _with_vector(df, labels, p["drop_first"])
    encoded = [c for c in p["categories"] if c in df.columns]
    added = [
        F.when(_text(df, c) == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}_{v}")
        for c in encoded
        for v in p["categories"][c][1 if p["drop_first"] else 0 :]
    ]
    return df.select(*[name(c) for c in df.columns if c not in encoded], *added)


def _with_vector(df: DataFrame, p: dict, drop_first: bool) -> DataFrame:
    """Replace a label-encoded column by its one-hot vector; missing and unseen values are all zeros."""
    from pyspark.ml.feature import OneHotEncoder

    c = p["column"]
    if c not in df.columns:
        return df
    # The encoder's last index stands for the zero vector.
    zero = label_size(p) - 1 if drop_first else label_size(p)
    code = F.when(_text(df, c).isNotNull(), F.col("__code"))
    slot = F.when(code > 0, code - 1) if drop_first else code
    out = _with_label(df, p, "__code").withColumn("__slot", F.coalesce(slot, F.lit(zero)).cast("double"))
    sizes = df.sparkSession.range(zero, zero + 1).select(F.col("id").cast("double").alias("__slot"))
    encoder = OneHotEncoder(inputCol="__slot", outputCol=f"{c}_vec", dropLast=True).fit(sizes)
    return encoder.transform(out).select(*[name(k) for k in df.columns if k != c], name(f"{c}_vec"))


def label_counts(df: DataFrame, column: str) -> DataFrame:
    """(label, n) with a missing value as the label ``nan``."""
    label = F.coalesce(_text(df, column), F.lit(MISSING_LABEL)).alias("label")
    return df.select(label).groupBy("label").agg(F.count("*").alias("n"))


def label_table(df: DataFrame, column: str) -> DataFrame:
    """(label, n, code): codes number the sorted labels from 0, at any cardinality."""
    require(df, [column])
    return global_index(label_counts(df, column), ["label"], "code")


def fit_label_encoder(df: DataFrame, column: str, table_path: str | None = None) -> Fitted:
    """Integer codes in the order of the labels as text; a missing value is the label ``nan``.

    Few labels are kept in the parameters. More than that are numbered by a distributed sort and
    written to ``table_path``, or to the scratch folder when none is named, from which the transform
    joins them.
    """
    require(df, [column])
    counts = label_counts(df, column)
    few = counts.select("label").limit(LABEL_INLINE_LIMIT + 1).collect()
    if len(few) <= LABEL_INLINE_LIMIT:
        labels = sorted(r["label"] for r in few)
        return Fitted("label", {"column": column, "labels": labels})
    path = table_path or scratch_path(df.sparkSession, f"labels-{uuid.uuid4().hex}")
    global_index(counts, ["label"], "code").write.mode("overwrite").parquet(path)
    rows, codes = df.sparkSession.read.parquet(path).agg(F.sum("n"), F.count("*")).first()
    return Fitted("label", {"column": column, "table": path, "rows": int(rows), "codes": int(codes)})


def label_size(p: dict) -> int:
    """The number of codes of a label encoder, which is also the code for a label it never saw."""
    return len(p["labels"]) if "labels" in p else p["codes"]


def _apply_label(df: DataFrame, p: dict) -> DataFrame:
    c = p["column"]
    if c not in df.columns:
        return df
    return _replace(_with_label(df, p, "__code"), {c: F.col("__code")}).drop("__code")


def _with_label(df: DataFrame, p: dict, out: str) -> DataFrame:
    label = F.coalesce(_text(df, p["column"]), F.lit(MISSING_LABEL))
    if "labels" in p:
        return with_code(df, label, p["labels"], out)
    table = df.sparkSession.read.parquet(p["table"])
    return lookup_by_value(df, label, table, "label", "n", p["rows"], {"code": out})


def with_code(df: DataFrame, label: Column, labels: Sequence[str], out: str) -> DataFrame:
    """Add the position of ``label`` in a short list, NULL when it is not there.

    A map literal is searched entry by entry, so beyond a few labels a broadcast hash join is used;
    the list never exceeds ``LABEL_INLINE_LIMIT`` entries.
    """
    if len(labels) <= 50:
        codes = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(i).cast("long"))])
        return df.withColumn(out, F.try_element_at(codes, label))
    table = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(labels)], f"__label string, `{out}` long")
    return df.join(F.broadcast(table), label == F.col("__label"), "left").drop("__label")


def label_mapping(df: DataFrame, fitted: Fitted, first: int | None = 10) -> DataFrame:
    """(label, code) of a fitted encoder, the first ones or all."""
    spark, p = df.sparkSession, fitted.params
    if "labels" in p:
        table = spark.createDataFrame([(v, i) for i, v in enumerate(p["labels"])], "label string, code long")
    else:
        table = spark.read.parquet(p["table"]).select("label", "code")
    return table if first is None else table.orderBy("code").limit(first)


# Constant fills


def fit_impute(df: DataFrame, cols: Sequence[str] | None = None, strategy: str = "median") -> Fitted:
    """Means or medians of numeric columns, to replace their missing values."""
    cols = pick_numeric(df, cols)
    if strategy == "median":
        values = exact_medians(df, cols)
    elif strategy == "mean":
        values = dict(zip(cols, run_aggregates(df, [F.avg(_number(df, c)) for c in cols])))
    else:
        raise ValueError("strategy must be 'median' or 'mean'")
    return Fitted("impute", {"values": {c: v for c, v in values.items() if v is not None}})


def _apply_impute(df: DataFrame, p: dict) -> DataFrame:
    return _replace(df, {c: F.coalesce(_number(df, c), F.lit(v)) for c, v in p["values"].items() if c in df.columns})


def fit_fill_value(df: DataFrame, column: str, strategy: str) -> Fitted:
    """The fill of one column as a recordable transform."""
    from tidemill.operators.cleaning import fit_fill

    value = fit_fill(df, column, strategy)
    if value is not None and not isinstance(value, (int, float, str, bool)):
        return Fitted("fill", {"column": column, "value": str(value), "cast": df.schema[column].dataType.simpleString()})
    return Fitted("fill", {"column": column, "value": value})


def _apply_fill_value(df: DataFrame, p: dict) -> DataFrame:
    from tidemill.operators.cleaning import apply_fill

    if p["column"] not in df.columns:
        return df
    if "cast" in p:
        filler = F.lit(p["value"]).cast(p["cast"])
        return _replace(df, {p["column"]: F.coalesce(name(p["column"]), filler)})
    return apply_fill(df, p["column"], p["value"])


def _apply_flags(df: DataFrame, p: dict) -> DataFrame:
    """Flags as 0/1; a missing flag counts as 0."""
    return _replace(df, {c: F.coalesce(name(c).cast("double"), F.lit(0.0)) for c in p["cols"] if c in df.columns})


def _apply_drop(df: DataFrame, p: dict) -> DataFrame:
    return df.drop(*p["cols"])


# Principal components


def fit_pca(df: DataFrame, k: int = 5, target: str | None = None, cols: Sequence[str] | None = None) -> Fitted:
    """Leading principal components of the numeric columns, missing values set to the median.

    The covariance matrix comes from one distributed job; only its columns x columns entries
    reach the driver. Each component's largest loading is made positive.
    """
    from tidemill.operators.correlation import pair_moments

    cols = [c for c in pick_numeric(df, cols) if c != target]
    if len(cols) < 2:
        raise ValueError("at least 2 numeric columns are needed")
    impute = fit_impute(df, cols)
    values = impute.apply(df.select(*[name(c) for c in cols]))
    values = values.select(*[name(c).cast("double").alias(c) for c in cols])
    m = pair_moments(values, cols)
    n = m[0, 0, 0]
    if n < 2:
        raise ValueError("at least 2 rows are needed")
    covariance = (m[:, :, 5] - m[:, :, 1] * m[:, :, 2] / n) / (n - 1)
    means = run_aggregates(values, [F.avg(name(c)) for c in cols])
    variances, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(variances)[::-1][: min(k, len(cols))]
    variances = np.maximum(variances, 0.0)
    loadings = vectors[:, order].T
    for row in loadings:
        if row[np.argmax(np.abs(row))] < 0:
            row *= -1
    total = variances.sum()
    return Fitted(
        "pca",
        {
            "cols": cols,
            "fill": impute.params["values"],
            "means": [float(v) for v in means],
            "loadings": loadings.tolist(),
            "ratios": (variances[order] / total if total > 0 else variances[order] * 0).tolist(),
        },
    )


def _apply_pca(df: DataFrame, p: dict) -> DataFrame:
    centred = [
        F.coalesce(_number(df, c), F.lit(p["fill"].get(c))) - F.lit(m) for c, m in zip(p["cols"], p["means"])
    ]
    added = []
    for i, loading in enumerate(p["loadings"]):
        score = F.lit(0.0)
        for x, w in zip(centred, loading):
            score = score + x * F.lit(w)
        added.append(score.alias(f"pca_{i + 1}"))
    return df.select(*[name(c) for c in df.columns if c not in p["cols"]], *added)


def pca_report(df: DataFrame, fitted: Fitted) -> DataFrame:
    """Variance share of each component and the running total, in percent."""
    rows, total = [], 0.0
    for i, ratio in enumerate(fitted.params["ratios"]):
        total += ratio
        rows.append((f"pca_{i + 1}", ratio * 100, total * 100))
    out = df.sparkSession.createDataFrame(rows, "component string, v double, c double")
    return out.select("component", tidy(F.col("v"), 2).alias("variance_explained"), tidy(F.col("c"), 2).alias("cumulative"))


# Polynomial terms


def fit_polynomial(df: DataFrame, cols: Sequence[str] | None = None, degree: int = 2) -> Fitted:
    """All products up to ``degree`` of the named columns, or of all numeric ones."""
    cols = pick_numeric(df, cols)
    if not cols or degree < 1:
        raise ValueError("at least one numeric column and degree 1 are needed")
    return Fitted("polynomial", {"cols": cols, "degree": degree, "fill": fit_impute(df, cols).params["values"]})


def polynomial_terms(cols: Sequence[str], degree: int) -> list[tuple[str, tuple[str, ...]]]:
    """(name, factors) of every term: ``a``, ``apow2``, ``a_b`` and so on, by rising degree."""
    terms = []
    for d in range(1, degree + 1):
        for factors in combinations_with_replacement(cols, d):
            powers: dict[str, int] = {}
            for c in factors:
                powers[c] = powers.get(c, 0) + 1
            label = "_".join(c if n == 1 else f"{c}pow{n}" for c, n in powers.items())
            terms.append((label.replace(" ", "_").replace("^", "pow"), factors))
    return terms


def _apply_polynomial(df: DataFrame, p: dict) -> DataFrame:
    x = {c: F.coalesce(_number(df, c), F.lit(p["fill"].get(c))) for c in p["cols"]}
    added = []
    for label, factors in polynomial_terms(p["cols"], p["degree"]):
        product = x[factors[0]]
        for c in factors[1:]:
            product = product * x[c]
        added.append(product.alias(label))
    return df.select(*[name(c) for c in df.columns if c not in p["cols"]], *added)


APPLIERS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "linear": _apply_linear,
    "log1p": _apply_log,
    "one_hot": _apply_one_hot,
    "label": _apply_label,
    "impute": _apply_impute,
    "fill": _apply_fill_value,
    "flags": _apply_flags,
    "drop": _apply_drop,
    "pca": _apply_pca,
    "polynomial": _apply_polynomial,
}


# Preparation of model inputs


def fit_features(df: DataFrame, target: str, strategy: str = "median", label_dir: str | None = None) -> list[Fitted]:
    """Label encoders for string features and fills for numeric ones, fitted on rows with a target."""
    require(df, [target])
    rows = known_target(df, target)
    features = [c for c in df.columns if c != target]
    texts = [c for c in features if c in string_columns(df)]
    numbers = [c for c in features if c in numeric_columns(df)]

    def encoder(c: str):
        path = f"{label_dir}/{texts.index(c)}" if label_dir else None
        return lambda: fit_label_encoder(rows, c, path)

    fits = [encoder(c) for c in texts]
    if numbers:
        fits.append(lambda: fit_impute(rows, numbers, strategy))
    return together(fits)


def known_target(df: DataFrame, target: str) -> DataFrame:
    return df.filter(present(target, df.schema[target].dataType).isNotNull())


def apply_all(df: DataFrame, steps: Sequence[Fitted]) -> DataFrame:
    """Replay recorded transforms in order, with their exact parameters."""
    for step in steps:
        df = step.apply(df)
    return df


def prepare_features(df: DataFrame, target: str, strategy: str = "median", label_dir: str | None = None) -> DataFrame:
    """Encoded and filled features with the target, ready for an assembler."""
    return apply_all(known_target(df, target), fit_features(df, target, strategy, label_dir))
