"""Support vector machines with a Gaussian kernel, for classes and for numbers.

The kernel is approximated by random Fourier features: cosines of random projections, whose inner products have the kernel as
their mean. On these the machine is linear. Its loss (hinge, or the distance beyond epsilon) and gradient
are sums over all rows: each task adds up its own, one row of sums for each task is shuffled, and only the sums reach
the driver, which takes the next quasi-Newton step. All classes are fitted in the same passes, each against the rest.
Class chances are sigmoids of the decision values (Platt's scaling), fitted by Newton steps on sums in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tidemill.operators.fitted import StateModel, matrix

#: Random features, half-width of the region where the corner of the loss is rounded, and how far a number may be off for free.
FEATURES, CORNER, EPSILON = 256, 0.05, 0.1


def corner(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """max(0, m) with its corner rounded between 0 and ``CORNER``, and the derivative."""
    inner = np.clip(m, 0.0, CORNER)
    return inner * inner / (2 * CORNER) + np.maximum(m - CORNER, 0.0), inner / CORNER


def fourier(x: np.ndarray, n: dict) -> np.ndarray:
    """Random features of standardised rows, and a constant."""
    z = (x - n["mean"]) / n["spread"]
    own = np.cos(z @ n["frequency"] + n["phase"]) * np.sqrt(2.0 / len(n["phase"]))
    return np.hstack([own, np.ones((len(x), 1))])


def losses(z: np.ndarray, y: np.ndarray, weights: np.ndarray, classes: int, epsilon: float) -> tuple[float, np.ndarray]:
    """Summed loss of the rows and its gradient by ``weights`` (outputs x features)."""
    f = z @ weights.T
    if classes:
        sign = np.where(y[:, None] == np.arange(len(weights)) + (classes == 2), 1.0, -1.0)
        value, slope = corner(1.0 - sign * f)
        slope = -slope * sign
    else:
        off = f - y[:, None]
        value, slope = corner(np.abs(off) - epsilon)
        slope = slope * np.sign(off)
    return float(value.sum()), slope.T @ z


def summed(table: DataFrame, width: int, size: int, add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``add(x, y)``, a vector of ``size`` numbers for some rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += add(matrix(batch.column("x"), width), batch.column("label").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["k", "v"])

    rows = table.select(vector_to_array("features").alias("x"), "label").mapInArrow(run, "k bigint, v double")
    out = np.zeros(size)
    for k, v in rows.groupBy("k").agg(F.sum("v")).collect():
        out[k] = v
    return out


def minimise(value_of: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, tolerance: float = 1e-5, memory: int = 8) -> np.ndarray:
    """L-BFGS with a halving line search."""
    w = start
    value, slope = value_of(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, factors = slope.copy(), []
        for s, y in reversed(past):
            a = s @ d / (s @ y)
            factors.append(a)
            d -= a * y
        if past:
            s, y = past[-1]
            d *= (s @ y) / (y @ y)
        else:
            d /= max(1.0, np.linalg.norm(slope))
        for (s, y), a in zip(past, reversed(factors)):
            d += (a - y @ d / (s @ y)) * s
        rate, fall = 1.0, slope @ d
        while True:
            there = w - rate * d
            new, new_slope = value_of(there)
            if new <= value - 1e-4 * rate * fall or rate < 1e-6:
                break
            rate /= 2
        if not np.isfinite(new) or new > value:
            break
        s, y = there - w, new_slope - slope
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y)]
        done = value - new <= tolerance * max(1.0, abs(value))
        w, value, slope = there, new, new_slope
        if done:
            break
    return w


class KernelMachine(StateModel):
    """A fitted machine; ``prediction`` goes by the decision values, ``probability`` by their sigmoids."""

    @staticmethod
    def outputs(numbers: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        n = {k: np.array(v) if isinstance(v, list) else v for k, v in numbers.items()}
        f = fourier(x, n) @ n["weights"].T
        if numbers["kind"] != "classification":
            return f[:, 0] * n["unit"] + n["centre"], None
        if n["classes"] < 2:
            return np.zeros(len(x)), np.ones((len(x), 1))
        chance = 1 / (1 + np.exp(np.clip(f * n["platt"][:, 0] + n["platt"][:, 1], -40, 40)))
        if f.shape[1] == 1:
            return (f[:, 0] > 0).astype(float), np.hstack([1 - chance, chance])
        chance = np.maximum(chance, 1e-12)
        return f.argmax(axis=1).astype(float), chance / chance.sum(axis=1, keepdims=True)

    @property
    def input_weights(self) -> list[float]:
        """How steeply the decision values follow each feature, from the weights of its frequencies."""
        n = self.numbers
        w = np.abs(np.array(n["weights"])[:, :-1]).mean(axis=0)
        return (np.sqrt(((np.array(n["frequency"]) * w) ** 2).sum(axis=1)) / np.array(n["spread"])).tolist()


class KernelSVM:
    """Trainer for rows of ``features`` and ``label`` (class numbers from 0, or numbers)."""

    def __init__(self, kind: str, classes: int, C: float = 1.0, gamma: float | None = None, epsilon: float = EPSILON, n_features: int = FEATURES, max_iter: int = 40, seed: int = 42):  # noqa: N803
        self.kind, self.classes, self.strength, self.gamma, self.epsilon = kind, classes if kind == "classification" else 0, C, gamma, epsilon
        self.n_features, self.max_iter, self.seed = n_features, max_iter, seed

    def fit(self, table: DataFrame) -> KernelMachine:
        classes = self.classes
        size = table.select(F.size(vector_to_array("features")).alias("n")).first()
        width = size[0] if size else 0
        # Count, sums and squares of each feature and of the label.
        sums = summed(table, width, 3 + 2 * width, lambda x, y: np.concatenate([[len(y), y.sum(), (y * y).sum()], x.sum(0), (x * x).sum(0)]))
        rows = max(1.0, sums[0])
        mean = sums[3 : 3 + width] / rows
        spread = np.sqrt(np.maximum(sums[3 + width :] / rows - mean**2, 0))
        spread[spread <= 1e-12 * np.maximum(1.0, np.abs(mean))] = 1.0
        centre, unit = (0.0, 1.0) if classes else (sums[1] / rows, max(1e-12, np.sqrt(max(0.0, sums[2] / rows - (sums[1] / rows) ** 2))))
        rng = np.random.default_rng(self.seed)
        gamma = self.gamma if self.gamma is not None else 1.0 / max(1, width)
        numbers = {
            "kind": self.kind, "classes": classes, "width": width, "mean": mean, "spread": spread, "centre": centre, "unit": unit,
            "frequency": rng.normal(0, np.sqrt(2 * gamma), (width, self.n_features)), "phase": rng.uniform(0, 2 * np.pi, self.n_features),
        }
        shape = (classes if classes > 2 else 1, self.n_features + 1)
        free = np.append(np.ones(self.n_features), 0.0)  # the constant is not held back
        epsilon, sent = self.epsilon, table.sparkSession.sparkContext.broadcast(numbers)

        def objective(flat: np.ndarray) -> tuple[float, np.ndarray]:
            w = flat.reshape(shape)

            def add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                n = sent.value
                value, slope = losses(fourier(x, n), y if classes else (y - centre) / unit, w, classes, epsilon)
                return np.append(slope.ravel(), value)

            got = summed(table, width, w.size + 1, add) * self.strength
            return got[-1] + 0.5 * float((w * w * free).sum()), got[:-1] + (w * free).ravel()

        weights = minimise(objective, np.zeros(shape[0] * shape[1]), self.max_iter).reshape(shape)
        platt = self._sigmoids(table, width, sent, weights) if classes else np.zeros((0, 2))
        return KernelMachine({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in (numbers | {"weights": weights, "platt": platt}).items()})

    def _sigmoids(self, table: DataFrame, width: int, sent, weights: np.ndarray, steps: int = 15) -> np.ndarray:
        """(slope, offset) of each output's chance ``1 / (1 + exp(slope * f + offset))``, with Platt's smoothed targets."""
        k, two = len(weights), self.classes == 2

        def member(y: np.ndarray) -> np.ndarray:
            return (y[:, None] == np.arange(k) + two).astype(float)

        sizes = summed(table, width, 1 + k, lambda x, y: np.append(len(y), member(y).sum(0)))
        total, ones = sizes[0], sizes[1:]
        high, low = (ones + 1) / (ones + 2), 1 / (total - ones + 2)
        found = np.stack([np.zeros(k), np.log((total - ones + 1) / (ones + 1))], axis=1)
        for _ in range(steps):
            now = found.copy()

            def add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                f = fourier(x, sent.value) @ weights.T
                p = 1 / (1 + np.exp(np.clip(f * now[:, 0] + now[:, 1], -40, 40)))
                d, v = np.where(member(y) > 0, high, low) - p, p * (1 - p)
                return np.concatenate([(d * f).sum(0), d.sum(0), (v * f * f).sum(0), (v * f).sum(0), v.sum(0)])

            ga, gb, aa, ab, bb = summed(table, width, 5 * k, add).reshape(5, k)
            aa, bb = aa + 1e-9, bb + 1e-9
            det = np.maximum(aa * bb - ab * ab, 1e-12)
            step = np.stack([(bb * ga - ab * gb) / det, (aa * gb - ab * ga) / det], axis=1)
            found = found - np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        return found
