"""Logistic regressions with two classes, many of them fitted in the same passes over one table.

Each fit leaves out one fold and has a penalty of its own. A pass sums loss and gradient of every fit still running inside the
tasks; only these sums, whose size depends on fits and features, reach the driver, and no fit keeps rows. Objective, steps and end
are those of Spark's LogisticRegression without standardisation: averaged loss plus ridge on coefficients in their own
units, quasi-Newton steps on centred and scaled features, a strong Wolfe line search.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemill.session import checkpointed

#: Fits that share a pass, rows that a task works on at a time, bytes of a block, and factors of at most 2 whose product is sure to be finite.
TOGETHER, SLICE, BLOCK, FACTORS = 64, 2048, 2048, 512
MEMORY, ZOOMS, DECREASE, CURVATURE, PAST = 10, 10, 1e-4, 0.9, 20


@dataclass
class Fit:
    """One regression: the fold that it leaves out, its ridge, and when it ends."""

    fold: int
    ridge: float
    max_iter: int
    tol: float


def _rows_of_block(width: int) -> int:
    return max(1, BLOCK // (8 * (width + 2)))


def packed(table: DataFrame, width: int) -> DataFrame:
    """Rows of ``f0``.., ``label`` and ``fold`` as blocks of numbers, row by row: these reach Python workers far faster than rows do."""
    per = _rows_of_block(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64, copy=False)
            yield pa.RecordBatch.from_arrays([pa.array([rows[at : at + per].tobytes() for at in range(0, len(rows), per)], type=pa.binary())], names=["rows"])

    return table.select(*[f"f{i}" for i in range(width)], "label", "fold").mapInArrow(run, "rows binary")


def totals(blocks: DataFrame, width: int, size: int, add: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``add(x, y, fold)``, a vector of ``size`` numbers for some rows."""
    some = max(1, SLICE // _rows_of_block(width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, some):
                rows = np.frombuffer(b"".join(batch.column("rows").slice(at, some).to_pylist())).reshape(-1, width + 2)
                total += add(rows[:, :width], rows[:, width], rows[:, width + 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["k", "v"])

    out = np.zeros(size)
    for k, v in blocks.mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v")).collect():
        out[k] = v
    return out


class _Failed(Exception):
    """A step that cannot be taken from the steps remembered."""


def minimised(start: np.ndarray, max_iter: int, tol: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Yields the points whose value and gradient it is sent; returns the lowest point."""
    x, (value, slope) = start, (yield start)
    first, values, past, steps, failed = value, [math.inf], [], 0, False
    while steps < max_iter:
        if len(values) > 1 and abs(value - max(values)) <= tol * first or np.linalg.norm(slope) <= max(tol * abs(value), 1e-8):
            break
        try:
            way = _direction(past, slope)
            rate, there, new, new_slope = yield from _searched(x, way, value, slope, 1 / np.linalg.norm(way) if steps == 0 else 1.0)
            if rate * np.linalg.norm(slope) < 1e-10:
                raise _Failed
        except _Failed:
            if failed:
                break
            failed, past = True, []
            continue
        failed, past = False, [(there - x, new_slope - slope), *past[: MEMORY - 1]]
        x, value, slope, steps = there, new, new_slope, steps + 1
        values = [*values, value][-PAST:]
    return x


def _direction(past: list[tuple[np.ndarray, np.ndarray]], slope: np.ndarray) -> np.ndarray:
    way, factors = slope.copy(), []
    for s, y in past:
        factors.append(s @ way / (s @ y) if s @ y else math.nan)
        way -= factors[-1] * y
    if past:
        s, y = past[0]
        if not s @ y >= 0 or any(map(math.isnan, factors)):
            raise _Failed
        way *= (s @ y) / (y @ y)
    for (s, y), a in zip(reversed(past), reversed(factors)):
        way += (a - y @ way / (s @ y)) * s
    return -way


def _searched(x: np.ndarray, way: np.ndarray, value: float, slope: np.ndarray, t: float):
    """(t, point, value, gradient) that meet the strong Wolfe conditions along ``way``."""
    fall = slope @ way
    if not fall <= 0:
        raise _Failed

    def at(t: float):
        there = x + way * t
        v, g = yield there
        return t, v, g @ way, there, g

    def enough(c, low) -> bool:
        return not (c[1] > value + DECREASE * c[0] * fall or c[1] >= low[1])

    def zoomed(low, high):
        for _ in range(ZOOMS):
            c = yield from at(_between(*sorted((low, high), key=lambda b: b[0])))
            if not enough(c, low):
                high = c
                continue
            if abs(c[2]) <= CURVATURE * abs(fall):
                return c
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise _Failed

    low, found = (0.0, value, fall, x, slope), None
    for i in range(ZOOMS):
        c = yield from at(t)
        if not math.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + DECREASE * t * fall or (c[1] >= low[1] and i > 0):
            found = yield from zoomed(low, c)
        elif abs(c[2]) <= CURVATURE * abs(fall):
            found = c
        elif c[2] >= 0:
            found = yield from zoomed(c, low)
        if found:
            t, v, _, there, g = found
            return t, there, v, g
        low, t = c, t * 1.5
    raise _Failed


def _between(left, right) -> float:
    """The lowest point of the cubic through two ends, kept off them."""
    (a, va, da, *_), (b, vb, db, *_) = left, right
    d1 = da + db - 3 * (va - vb) / (a - b)
    d2 = math.sqrt(max(d1 * d1 - da * db, 0.0))
    below = db - da + 2 * d2
    t = b - (b - a) * (db + d2 - d1) / below if below else (a + b) / 2
    return min(max(t, a + 0.1 * (b - a)), a + 0.9 * (b - a))


def margins(x: np.ndarray, centre: np.ndarray, unit: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Standardised rows, and the margins of each fit (rows x fits); ``weights`` has the constant last."""
    z = (x - centre) / unit
    return z, z @ weights[:, :-1].T + weights[:, -1]


def sums(z: np.ndarray, m: np.ndarray, y: np.ndarray, learns: np.ndarray) -> np.ndarray:
    """(fits x [gradient by standardised features, by the constant, loss]) over the rows that each fit learns from."""
    e = np.exp(-np.abs(m))
    off = (np.where(m >= 0, 1.0, e) / (1 + e) - y[:, None]) * learns
    loss = ((np.maximum(m, 0) - y[:, None] * m) * learns).sum(0)
    # Products of some factors 1 + e, so that few logarithms are taken.
    loss += np.log(np.multiply.reduceat(1 + e * learns, range(0, len(m), FACTORS), axis=0)).sum(0)
    return np.hstack([off.T @ z, off.sum(0)[:, None], loss[:, None]])


def fold_accuracy(table: DataFrame, width: int, folds: int, fits: Sequence[Fit]) -> list[float]:
    """Share of right predictions in the fold that each fit left out; rows have ``f0``.., ``label`` 0 or 1, and ``fold``."""
    blocks = checkpointed(packed(table, width))
    return [s for at in range(0, len(fits), TOGETHER) for s in _accuracy(blocks, width, folds, fits[at : at + TOGETHER])]


def _accuracy(blocks: DataFrame, width: int, folds: int, fits: Sequence[Fit]) -> list[float]:
    def by_fold(fold: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return ((fold[:, None] == np.arange(folds)).astype(float).T @ numbers).ravel()

    # Rows, ones and sums of each fold; then squares about the mean of all rows.
    got = totals(blocks, width, folds * (2 + width), lambda x, y, fold: by_fold(fold, np.column_stack([np.ones(len(y)), y, x]))).reshape(folds, -1)
    if not np.isfinite(got).all():
        raise ValueError("features must be finite numbers")
    rows, ones = got[:, 0], got[:, 1]
    centre = got[:, 2:].sum(0) / max(1.0, rows.sum())
    moved = totals(blocks, width, folds * 2 * width, lambda x, y, fold: by_fold(fold, np.hstack([x - centre, (x - centre) ** 2]))).reshape(folds, -1)
    unit = np.sqrt(moved[:, width:].sum(0) / max(1.0, rows.sum()))
    unit[unit == 0] = 1.0

    def rest(numbers: np.ndarray) -> np.ndarray:
        return np.stack([numbers[[i for i in range(folds) if i != f.fold]].sum(0) for f in fits])

    n, positive, first, second = rest(rows), rest(ones), rest(moved[:, :width]), rest(moved[:, width:])
    if not n.all():
        raise ValueError("no rows to learn from")
    spread = np.sqrt(np.maximum(second - first**2 / n[:, None], 0) / np.maximum(n - 1, 1)[:, None])
    spread[spread <= 1e-12 * np.maximum(np.abs(centre), unit)] = 0.0
    inverse = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)
    mean = first / n[:, None]  # from ``centre``

    def weights(k: int, w: np.ndarray) -> np.ndarray:
        """Weights of features standardised alike for all fits, from those on a fit's own scale."""
        own = w[:-1] * inverse[k]
        return np.append(own * unit, w[-1] - own @ mean[k])

    final = np.zeros((len(fits), width + 1))
    running = {}
    for k, f in enumerate(fits):
        if 0 < positive[k] < n[k]:
            running[k] = minimised(np.append(np.zeros(width), math.log(positive[k] / (n[k] - positive[k]))), f.max_iter, f.tol)
        else:
            final[k, -1] = 1.0 if positive[k] else -1.0  # one class only: it is what the fit predicts
    asked = {k: next(g) for k, g in running.items()}
    while asked:
        these = list(asked)
        now, left_out = np.stack([weights(k, asked[k]) for k in these]), np.array([fits[k].fold for k in these])

        def add(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
            z, m = margins(x, centre, unit, now)
            return sums(z, m, y, (fold[:, None] != left_out).astype(float)).ravel()

        found = totals(blocks, width, len(these) * (width + 2), add).reshape(len(these), -1)
        for k, row in zip(these, found):
            w, ridge = asked[k], fits[k].ridge * inverse[k] ** 2
            slope = np.append((row[:width] * unit - row[width] * mean[k]) * inverse[k], row[width]) / n[k]
            slope[:-1] += ridge * w[:-1]
            try:
                asked[k] = running[k].send((row[-1] / n[k] + 0.5 * float(ridge @ w[:-1] ** 2), slope))
            except StopIteration as end:
                final[k] = weights(k, end.value)
                del asked[k]
    held = np.array([f.fold for f in fits])

    def right(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        return (((margins(x, centre, unit, final)[1] > 0) == (y[:, None] > 0)) & (fold[:, None] == held)).sum(0)

    return [float(h / rows[f.fold]) if rows[f.fold] else 0.0 for h, f in zip(totals(blocks, width, len(fits), right), fits)]
