"""Pearson, Spearman and Kendall correlation of all pairs of numeric columns."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.columns import name, pick_numeric, present, tidy
from tidemill.functions.jobs import together
from tidemill.functions.order import (
    SMALL_TABLE,
    isolating_cuts,
    lookup_by_value,
    range_count,
    value_ranks,
    with_bucket,
)
from tidemill.functions.quantiles import run_aggregates
from tidemill.session import checkpointed

WIDE = 12  # above this many columns, per-task matrix products replace one sum per pair
SUMS_PER_JOB = 15  # larger aggregates outgrow what the JVM compiles; a job reads only its own columns
METHODS = ("pearson", "spearman", "kendall")
ONE_TASK_POINTS = 50_000  # distinct points up to which Kendall's pairs are counted without ranges


def _values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[present(c, df.schema[c].dataType).cast("double").alias(c) for c in cols])


def pearson_pairs(
    df: DataFrame, cols: Sequence[str], centre: Sequence[float] | None = None
) -> dict[tuple[str, str], float | None]:
    """r of every pair i < j over the rows where both are present.

    ``centre`` gives the column means when the caller knows them and no column has gaps.
    """
    values = _values(df, cols)
    index = range(len(cols))
    if len(cols) > WIDE:
        moments = pair_moments(values, cols)
        return {(cols[i], cols[j]): _r(moments[i, j]) for i, j in combinations(index, 2)}
    complete = [True] * len(cols)
    if centre is None:
        found = run_aggregates(values, [F.count("*"), *[f(name(c)) for c in cols for f in (F.count, F.avg)]])
        complete = [found[1 + 2 * i] == found[0] for i in index]
        centre = [found[2 + 2 * i] or 0.0 for i in index]
    x = [name(c) - F.lit(float(m)) for c, m in zip(cols, centre)]
    single = {i: (F.count(x[i]), F.sum(x[i]), F.sum(x[i] * x[i])) for i in index if complete[i]}
    wanted = [e for i in single for e in single[i]]
    slot = {i: 3 * k for k, i in enumerate(single)}
    pair_slot: dict[tuple[int, int], int] = {}
    for i, j in combinations(index, 2):
        pair_slot[i, j] = len(wanted)
        wanted.append(F.sum(x[i] * x[j]))
        if not (complete[i] and complete[j]):
            a, b = F.when(x[j].isNotNull(), x[i]), F.when(x[i].isNotNull(), x[j])
            wanted += [F.count(a), F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b)]
    got = run_aggregates(values, wanted, SUMS_PER_JOB)
    out = {}
    for (i, j), k in pair_slot.items():
        if complete[i] and complete[j]:
            (n, sa, saa), (_, sb, sbb) = (got[slot[q] : slot[q] + 3] for q in (i, j))
        else:
            n, sa, sb, saa, sbb = got[k + 1 : k + 6]
        out[cols[i], cols[j]] = _r([v or 0.0 for v in (n, sa, sb, saa, sbb, got[k])])
    return out


def _r(m) -> float | None:
    n, sa, sb, saa, sbb, sab = (float(v) for v in m)
    if n < 1:
        return None
    va, vb, cov = saa - sa * sa / n, sbb - sb * sb / n, sab - sa * sb / n
    if va <= 1e-13 * saa or vb <= 1e-13 * sbb:
        return None
    return max(-1.0, min(1.0, cov / math.sqrt(va) / math.sqrt(vb)))


def pair_moments(values: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Array [p, p, 6] of n, sum a, sum b, sum aa, sum bb, sum ab over pairwise complete rows.

    Each task multiplies its Arrow batches as matrices and sends one row per column, so the
    shuffle carries tasks x columns rows whatever the table size. Columns are centred on their
    means first, which keeps the sums accurate.
    """
    p = len(cols)
    centre = np.array([v or 0.0 for v in run_aggregates(values, [F.avg(name(c)) for c in cols])])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((5, p, p))
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan)
            mask = (~np.isnan(x)).astype(float)
            x = np.where(mask > 0, x - centre, 0.0)
            total += np.stack([mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x, np.zeros((p, p))])
        yield pd.DataFrame({"i": range(p), "sums": [total[:4, i, :].ravel().tolist() for i in range(p)]})

    rows = (
        values.mapInPandas(products, "i int, sums array<double>")
        .select("i", F.posexplode("sums").alias("k", "v"))
        .groupBy("i", "k")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    flat = np.zeros((p, 4 * p))
    for i, k, v in rows:
        flat[i, k] = v
    n, s, ss, ab = (flat.reshape(p, 4, p)[:, q, :] for q in range(4))
    return np.stack([n, s, s.T, ss, ss.T, ab], axis=2)


def spearman_pairs(df: DataFrame, cols: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """Pearson r of average ranks, ranked within the rows where both columns are present."""
    values = _values(df, cols)
    counted = run_aggregates(values, [F.count("*"), *[F.count(name(c)) for c in cols]])
    distinct = dict(zip(cols, run_aggregates(values, [F.approx_count_distinct(name(c)) for c in cols], 8)))
    total, filled = counted[0], dict(zip(cols, counted[1:]))
    out: dict[tuple[str, str], float | None] = {}
    whole = [c for c in cols if filled[c] == total]
    if len(whole) > 1:
        # Average ranks of n rows always have the mean (n + 1) / 2.
        out.update(pearson_pairs(_ranked(values, whole, total, distinct), whole, [(total + 1) / 2] * len(whole)))
    for a, b in combinations(cols, 2):
        if (a, b) not in out:
            both = values.select(name(a), name(b)).filter(name(a).isNotNull() & name(b).isNotNull())
            out[a, b] = pearson_pairs(_ranked(both, [a, b], total, distinct), [a, b])[a, b]
    return out


def _ranked(values: DataFrame, cols: Sequence[str], total: int, distinct: dict[str, int]) -> DataFrame:
    """Replace each value by its average rank."""
    out = values.select(*[name(c) for c in cols])
    for c in cols:
        small = distinct[c] <= SMALL_TABLE
        ranks = value_ranks(values, c, 0 if small else total)
        out = lookup_by_value(out, name(c), ranks, "value", "n", total, {"rank": "__r"}, small)
        out = out.select(*[F.col("__r").alias(c) if d == c else name(d) for d in cols])
    return out


def kendall_pairs(df: DataFrame, cols: Sequence[str]) -> dict[tuple[str, str], float | None]:
    values, pairs = _values(df, cols), list(combinations(cols, 2))
    return dict(zip(pairs, together([lambda p=p: kendall_tau(values, *p) for p in pairs], 4)))


def kendall_tau(df: DataFrame, a: str, b: str, parts: tuple[int, int] | None = None) -> float | None:
    """Tau-b over the rows where both columns are present, without comparing rows pairwise.

    Equal (x, y) rows are merged first. Each axis is cut into coarse ranges (bx, by) and, for large
    tables, each of these into finer ones (fx, fy); a very frequent value gets a range of its own.
    Every pair of rows then falls into exactly one of seven cases, by the finest ranges it shares,
    and each case is counted from rows merged to what that case needs. A range with a single value
    holds ties alone and is skipped, so no task ever receives a hot value's rows.
    """
    spark = df.sparkSession
    points = (
        df.select(name(a).cast("double").alias("x"), name(b).cast("double").alias("y"))
        .filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    )
    merged = points.groupBy("x", "y").agg(F.count("*").alias("n")).persist()
    try:
        distinct, rows = merged.agg(F.count("*"), F.sum("n")).first()
        if not rows or rows < 2:
            return None
        coarse, fine = parts or _part_counts(spark, distinct, rows)
        counts = merged
        for axis in ("x", "y"):
            cuts = isolating_cuts(points, F.col(axis), coarse)
            finer = cuts
            if fine > 1:
                ranged = with_bucket(points, F.col(axis), cuts, "b")
                finer = sorted({*cuts, *isolating_cuts(ranged, F.col(axis), fine, by="b")})
            counts = with_bucket(with_bucket(counts, F.col(axis), cuts, "b" + axis), F.col(axis), finer, "f" + axis)
        score = _within(counts, ["fx"], "x", "y")
        if coarse > 1:
            score += _between_ranges(counts, coarse)
            score += _within(counts, ["fy"], "bx", "y")
        if fine > 1:
            score += _within(counts, ["bx"], "fx", "by")
            score += _within(counts, ["by"], "bx", "fy")
            score += _within(counts, ["bx", "by"], "fx", "fy")
            score += _within(counts, ["bx", "fy"], "fx", "y")
        pairs = rows * (rows - 1) / 2
        spread = (pairs - _tied_pairs(merged, "x")) * (pairs - _tied_pairs(merged, "y"))
        return score / math.sqrt(spread) if spread > 0 else None
    finally:
        merged.unpersist()


def _tied_pairs(merged: DataFrame, axis: str) -> float:
    sizes = merged.groupBy(axis).agg(F.sum("n").cast("double").alias("n"))
    return sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]


def _part_counts(spark, distinct: int, rows: int) -> tuple[int, int]:
    """Coarse ranges, and fine ones in each, so that a finest range holds about a million points.

    A few distinct points are counted by one task.
    """
    if distinct <= ONE_TASK_POINTS:
        return 1, 1
    coarse = min(1000, range_count(spark, rows))
    return coarse, min(1000, math.ceil(rows / coarse / 1_000_000))


def _between_ranges(counts: DataFrame, coarse: int) -> float:
    """Concordant minus discordant pairs whose ranges differ on both axes, from range counts.

    The cells are cut into about ``sqrt`` as many blocks on each axis. Pairs of one block row or column are counted there; the
    pairs left differ in both blocks, of which there are no more than ranges.
    """
    width = math.ceil(math.sqrt(2 * coarse))
    cells = counts.groupBy("bx", "by").agg(F.sum("n").alias("n"))
    cells = checkpointed(cells.withColumn("cx", F.floor(F.col("bx") / width)).withColumn("cy", F.floor(F.col("by") / width)).withColumn("all", F.lit(0)))
    return _within(cells, ["cx"], "bx", "by") + _within(cells, ["cy"], "cx", "by") + _within(cells, ["all"], "cx", "cy")


def _within(counts: DataFrame, group: list[str], x: str, y: str) -> float:
    """Concordant minus discordant pairs inside each group, compared by ``x`` and ``y``."""
    merged = counts.groupBy(*group, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    merged = merged.agg(F.sum("n").alias("__n"))
    several = merged.groupBy(*group).agg(
        (F.min("__x") < F.max("__x")).alias("vx"), (F.min("__y") < F.max("__y")).alias("vy")
    )
    several = several.filter("vx AND vy").select(*group)
    inside = merged.join(several, group, "left_semi")

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [concordance(*(pdf[c].to_numpy(float) for c in ("__x", "__y", "__n")))]})

    return inside.groupBy(*group).applyInPandas(score, "s double").agg(F.sum("s")).first()[0] or 0.0


def concordance(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Weighted concordant minus discordant pairs; ties on either axis count as neither.

    Goes through the bits of y's dense rank from the top. Two points first differ at exactly one
    bit, so at each bit it is enough to compare zeros with ones among points that agree above it.
    """
    rank = np.unique(y, return_inverse=True)[1]
    order = np.lexsort((x,))
    x, rank, n = x[order], rank[order], n[order]
    total = 0.0
    for bit in range(int(rank.max()).bit_length() if len(rank) else 0):
        group = rank >> (bit + 1)
        by_group = np.argsort(group, kind="stable")  # keeps the order of x inside a group
        g, xs, w = group[by_group], x[by_group], n[by_group]
        one = ((rank[by_group] >> bit) & 1).astype(bool)
        start_group = np.r_[True, g[1:] != g[:-1]]
        start_x = start_group | np.r_[True, xs[1:] != xs[:-1]]
        at_x = np.maximum.accumulate(np.where(start_x, np.arange(len(g)), 0))
        at_group = np.maximum.accumulate(np.where(start_group, np.arange(len(g)), 0))
        zeros = np.r_[0.0, np.cumsum(np.where(one, 0.0, w))]
        ones = np.r_[0.0, np.cumsum(np.where(one, w, 0.0))]
        zeros_before, ones_before = zeros[at_x] - zeros[at_group], ones[at_x] - ones[at_group]
        total += float((w * np.where(one, zeros_before, -ones_before)).sum())
    return total


def correlation_pairs(df: DataFrame, method: str, cols: Sequence[str] | None = None) -> dict:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    cols = pick_numeric(df, cols)
    if len(cols) < 2:
        raise ValueError("at least 2 numeric columns are needed")
    return {"pearson": pearson_pairs, "spearman": spearman_pairs, "kendall": kendall_pairs}[method](df, cols)


def correlation_analysis(
    df: DataFrame,
    method: str = "pearson",
    min_correlation: float = 0.1,
    cols: Sequence[str] | None = None,
    top_n: int = 20,
) -> DataFrame:
    """The strongest pairs with strength and direction, and how many pairs passed the threshold."""
    found = correlation_pairs(df, method, cols)
    kept = [(a, b, r) for (a, b), r in found.items() if r is not None and abs(r) >= min_correlation]
    pairs = df.sparkSession.createDataFrame(kept, "column1 string, column2 string, r double")
    size = F.abs("r")
    return (
        pairs.select(
            F.lit(method).alias("method"),
            "column1",
            "column2",
            tidy(F.col("r"), 4).alias("correlation"),
            _strength(size).alias("strength"),
            F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"),
            F.lit(len(kept)).cast("long").alias("total_correlations"),
        )
        .orderBy(F.desc(F.abs("correlation")), "column1", "column2")
        .limit(top_n)
    )


def _strength(size: Column) -> Column:
    return F.when(size >= 0.7, "strong").when(size >= 0.3, "moderate").otherwise("weak")


def correlation_matrix(
    df: DataFrame, method: str = "pearson", cols: Sequence[str] | None = None, lower: bool = False
) -> DataFrame:
    """Long form (row_column, column, r); ``lower`` keeps the lower triangle with the diagonal."""
    cols = pick_numeric(df, cols)
    found = correlation_pairs(df, method, cols)
    values = _values(df, cols)
    varies = dict(zip(cols, run_aggregates(values, [F.min(name(c)) < F.max(name(c)) for c in cols])))
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if lower and j > i:
                continue
            r = (1.0 if varies[a] else None) if i == j else found[(a, b) if i < j else (b, a)]
            rows.append((i, j, a, b, r))
    out = df.sparkSession.createDataFrame(rows, "i int, j int, row_column string, column string, r double")
    return out.select("i", "j", "row_column", "column", tidy(F.col("r"), 4).alias("correlation"))
