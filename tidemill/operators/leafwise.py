"""Gradient-boosted trees that grow best leaf first, with second-order gains and one softmax over all classes.

Features are cut into bins at sketched quantiles once. A pass sums gradients, curvatures and counts by tree, leaf, feature
and bin inside the tasks; these histograms, whose size depends on leaves, features and bins only, are added up by
key and come to the driver, which picks splits. Of two new leaves only the smaller is counted; the other is what is left of
their parent. A pass counts the children of every leaf that may be split next, so a tree of 31 leaves takes about as
many passes as it is deep, and the leaves chosen are those of one-by-one growth. All classes grow their trees in the same passes.
Rows keep their scores in a stored table that is rewritten every few rounds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tidemill.functions.quantiles import sketched
from tidemill.operators.fitted import StateModel, matrix
from tidemill.session import checkpointed

BINS, LEAST_ROWS, LEAST_CURVATURE, REWRITE = 255, 20, 1e-3, 10
SUMS = 3  # gradient, curvature, rows


@dataclass
class Node:
    """A node of a growing tree; ``hist`` is features x bins x sums."""

    hist: np.ndarray
    value: float = 0.0
    gain: float = 0.0
    feature: int = -1
    bin: int = -1
    left: int = -1
    right: int = -1
    small: int = -1  # which child is counted
    taken: bool = False


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)
    leaves: int = 1


def best_split(hist: np.ndarray, least_rows: int, ridge: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split into bins up to ``bin`` and above; of equal ones the first. No gain: no split."""
    if not hist.shape[0]:
        return 0.0, -1, -1
    left = np.cumsum(hist, axis=1)
    whole = left[:, -1:, :]
    right = whole - left
    ok = (left[..., 2] >= least_rows) & (right[..., 2] >= least_rows) & (left[..., 1] >= LEAST_CURVATURE) & (right[..., 1] >= LEAST_CURVATURE)

    def score(x: np.ndarray) -> np.ndarray:
        return x[..., 0] ** 2 / np.maximum(x[..., 1] + ridge, 1e-12)

    gain = np.where(ok, score(left) + score(right) - score(whole), -np.inf)
    at = int(gain.argmax())
    f, b = divmod(at, hist.shape[1])
    return (float(gain[f, b]), f, b) if gain[f, b] > 1e-9 else (0.0, -1, -1)


def gradients(margin: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the scores (rows x trees)."""
    if not classes:
        return margin - y[:, None], np.ones_like(margin)
    if classes == 2:
        p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        return p - y[:, None], p * (1 - p)
    p = softmax(margin)
    return p - (y[:, None] == np.arange(classes)), p * (1 - p)


def softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def flat(tree: Tree, edges: list[list[float]], rate: float, chosen: bool) -> dict:
    """A tree as parallel lists; with ``chosen`` only what was taken into it, else all that is laid out so far."""
    out: dict[str, list] = {"feature": [], "bin": [], "edge": [], "left": [], "right": [], "value": [], "gain": []}
    for node in tree.nodes:
        inner = node.left >= 0 and (node.taken or not chosen)
        out["feature"].append(node.feature if inner else -1)
        out["bin"].append(node.bin if inner else -1)
        out["edge"].append(edges[node.feature][node.bin] if inner else 0.0)
        out["left"].append(node.left if inner else -1)
        out["right"].append(node.right if inner else -1)
        out["value"].append(node.value * rate)
        out["gain"].append(node.gain if inner else 0.0)
    return out


def walk(tree: dict, x: np.ndarray, binned: bool) -> np.ndarray:
    """The node of the tree in which each row ends."""
    feature, left, right = (np.array(tree[k], dtype=np.int64) for k in ("feature", "left", "right"))
    bound = np.array(tree["bin"]) if binned else np.array(tree["edge"])
    at = np.zeros(len(x), dtype=np.int64)
    going = np.flatnonzero(feature[at] >= 0)
    while len(going):
        here = at[going]
        down = x[going, feature[here]] <= bound[here]
        at[going] = np.where(down, left[here], right[here])
        going = going[feature[at[going]] >= 0]
    return at


class LeafwiseTrees(StateModel):
    """Fitted trees."""

    @staticmethod
    def outputs(numbers: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        margin = np.tile(np.array(numbers["start"]), (len(x), 1))
        for trees in numbers["rounds"]:
            for k, tree in enumerate(trees):
                margin[:, k] += np.array(tree["value"])[walk(tree, x, False)]
        if numbers["kind"] != "classification":
            return margin[:, 0], None
        if numbers["classes"] < 2:
            return np.zeros(len(x)), np.ones((len(x), 1))
        if numbers["classes"] == 2:
            p = 1 / (1 + np.exp(-np.clip(margin[:, 0], -40, 40)))
            chances = np.stack([1 - p, p], axis=1)
        else:
            chances = softmax(margin)
        return chances.argmax(axis=1).astype(float), chances

    @property
    def input_weights(self) -> list[float]:
        """Share of all gains that comes from splits on each feature."""
        n = self.numbers
        out = np.zeros(n["width"])
        for trees in n["rounds"]:
            for tree in trees:
                f = np.array(tree["feature"])
                np.add.at(out, f[f >= 0], np.array(tree["gain"])[f >= 0])
        return (out / max(out.sum(), 1e-300)).tolist()


class LeafwiseBoosting:
    """Trainer for rows of ``features`` and ``label`` (class numbers from 0, or numbers)."""

    def __init__(self, kind: str, classes: int, n_estimators: int = 100, num_leaves: int = 31, learning_rate: float = 0.1, max_depth: int | None = None, least_rows: int = LEAST_ROWS, ridge: float = 0.0, bins: int = BINS):
        self.kind, self.classes = kind, classes if kind == "classification" else 0
        self.rounds, self.leaves, self.rate, self.depth = n_estimators, num_leaves, learning_rate, max_depth
        self.least_rows, self.ridge, self.bins = least_rows, ridge, bins

    def fit(self, table: DataFrame) -> LeafwiseTrees:
        first = table.select(F.size(vector_to_array("features"))).first()
        width = first[0] if first else 0
        edges = self._edges(table, width)
        trees = self.classes if self.classes > 2 else 1
        start = self._start(table, trees)
        rows = checkpointed(self._binned(table, edges, width, start))
        rounds: list[list[dict]] = []
        pending: list[list[dict]] = []
        for _ in range(self.rounds if self.classes != 1 else 0):
            grown = self._grow(rows, width, trees, edges, pending)
            found = [flat(t, edges, self.rate, True) for t in grown]
            rounds.append(found)
            if all(len(t.nodes) == 1 or not t.nodes[0].taken for t in grown):
                break
            pending.append(found)
            if len(pending) == REWRITE:
                rows, pending = checkpointed(self._scored(rows, width, trees, pending)), []
        return LeafwiseTrees({"kind": self.kind, "classes": self.classes, "width": width, "start": start, "rounds": rounds})

    def _edges(self, table: DataFrame, width: int) -> list[list[float]]:
        """Upper ends of all bins but the last, of each feature."""
        x = table.select(vector_to_array("features").alias("x"))
        ranks = [i / self.bins for i in range(1, self.bins)]
        found = sketched(x, [F.col("x")[i] for i in range(width)], [ranks] * width, 2000) if width else []
        return [sorted({float(c) for c in (found[4 * i + 3] or []) if c < found[4 * i + 2]}) for i in range(width)]

    def _start(self, table: DataFrame, trees: int) -> list[float]:
        if not self.classes:
            return [float(table.agg(F.avg("label")).first()[0] or 0.0)]
        counts = {int(r[0]): r[1] for r in table.groupBy("label").count().collect()}
        total = sum(counts.values())
        shares = [(counts.get(k, 0) + 1e-9) / (total + 1e-9) for k in range(max(self.classes, 1))]
        if self.classes == 2:
            return [float(np.log(max(shares[1], 1e-9) / max(shares[0], 1e-9)))]
        return [float(np.log(max(s, 1e-9))) for s in shares][:trees]

    @staticmethod
    def _binned(table: DataFrame, edges: list[list[float]], width: int, start: list[float]) -> DataFrame:
        cuts = [np.array(e) for e in edges]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("x"), width)
                out = np.empty(x.shape, dtype=np.uint8)
                for i, e in enumerate(cuts):
                    out[:, i] = np.searchsorted(e, x[:, i], side="left")
                margin = pa.array([start] * len(x), type=pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in out], type=pa.binary()), batch.column("label"), margin], names=["bins", "label", "margin"])

        return table.select(vector_to_array("features").alias("x"), "label").mapInArrow(run, "bins binary, label double, margin array<double>")

    @staticmethod
    def _read(batch: pa.RecordBatch, width: int, trees: int, pending: list[list[dict]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bins, labels and scores of some rows, those of the pending rounds added."""
        x = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, width)
        margin = matrix(batch.column("margin"), trees).copy()
        for own in pending:
            for k, tree in enumerate(own):
                margin[:, k] += np.array(tree["value"])[walk(tree, x, True)]
        return x, batch.column("label").to_numpy(zero_copy_only=False), margin

    def _scored(self, rows: DataFrame, width: int, trees: int, pending: list[list[dict]]) -> DataFrame:
        read = self._read

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, _, margin = read(batch, width, trees, pending)
                yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("label"), pa.array(margin.tolist(), type=pa.list_(pa.float64()))], names=["bins", "label", "margin"])

        return rows.mapInArrow(run, "bins binary, label double, margin array<double>")

    def _count(self, rows: DataFrame, width: int, laid: list[dict], wanted: list[tuple[int, int]], pending: list[list[dict]]) -> dict[tuple[int, int], np.ndarray]:
        """Histograms of the ``wanted`` (tree, node) pairs."""
        read, classes, bins, trees = self._read, self.classes, self.bins, len(laid)
        places = {}
        for i, (k, node) in enumerate(wanted):
            places.setdefault(k, {})[node] = i
        size = width * bins * SUMS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(wanted), width, bins * SUMS))
            for batch in batches:
                x, y, margin = read(batch, width, trees, pending)
                g, h = gradients(margin, y, classes)
                for k, own in places.items():
                    slot = np.full(len(laid[k]["feature"]), -1)
                    slot[list(own)] = list(own.values())
                    at = slot[walk(laid[k], x, True)]
                    here = np.flatnonzero(at >= 0)
                    for f in range(width):
                        cell = (at[here] * bins + x[here, f]) * SUMS
                        for j, v in enumerate((g[here, k], h[here, k], None)):
                            total[:, f, :] += np.bincount(cell + j, v, len(wanted) * bins * SUMS).reshape(len(wanted), -1)
            filled = np.flatnonzero(total.any(axis=2).ravel())
            values = total.reshape(len(wanted) * width, -1)[filled]
            yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int64)), pa.array(list(values), type=pa.list_(pa.float64()))], names=["k", "v"])

        def add(part: pa.Table) -> pa.Table:
            v = part.column("v").combine_chunks()
            return pa.table({"k": part.column("k")[:1], "v": pa.array([v.flatten().to_numpy().reshape(len(v), -1).sum(axis=0)], type=pa.list_(pa.float64()))})

        parts = rows.mapInArrow(run, "k bigint, v array<double>").groupBy("k").applyInArrow(add, "k bigint, v array<double>")
        out = np.zeros((len(wanted) * width, bins * SUMS))
        for k, v in parts.collect():
            out[k] = v
        out = out.reshape(len(wanted), size)
        return {key: out[i].reshape(width, bins, SUMS) for i, key in enumerate(wanted)}

    def _judged(self, hist: np.ndarray, depth: int) -> Node:
        g, h, n = hist[0].sum(axis=0) if len(hist) else (0.0, 0.0, 0.0)
        node = Node(hist, -g / max(h + self.ridge, 1e-12) if n else 0.0)
        if self.depth is None or depth < self.depth:
            node.gain, node.feature, node.bin = best_split(hist, self.least_rows, self.ridge)
        return node

    def _grow(self, rows: DataFrame, width: int, trees: int, edges: list[list[float]], pending: list[list[dict]]) -> list[Tree]:
        """One tree for each output, each up to ``leaves`` leaves, the leaf of the largest gain first."""
        empty = {"feature": [-1], "bin": [-1], "edge": [0.0], "left": [-1], "right": [-1], "value": [0.0]}
        roots = self._count(rows, width, [empty] * trees, [(k, 0) for k in range(trees)], pending)
        grown, heaps, depths = [], [], []
        for k in range(trees):
            root = self._judged(roots[k, 0], 0)
            grown.append(Tree([root]))
            heaps.append([(-root.gain, 0)] if root.gain > 0 else [])
            depths.append({0: 0})
        while True:
            wanted = []
            for k, (tree, heap) in enumerate(zip(grown, heaps)):
                while heap and tree.leaves < self.leaves and tree.nodes[heap[0][1]].left >= 0:
                    _, at = heapq.heappop(heap)
                    tree.nodes[at].taken = True
                    tree.leaves += 1
                    for child in (tree.nodes[at].left, tree.nodes[at].right):
                        if tree.nodes[child].gain > 0:
                            heapq.heappush(heap, (-tree.nodes[child].gain, child))
                if heap and tree.leaves < self.leaves:
                    # All leaves that may be split before the tree is full.
                    for _, at in heapq.nsmallest(self.leaves - tree.leaves, heap):
                        node = tree.nodes[at]
                        if node.left < 0:
                            node.left, node.right = len(tree.nodes), len(tree.nodes) + 1
                            tree.nodes += [Node(np.zeros(0)), Node(np.zeros(0))]
                            below = node.hist[node.feature, : node.bin + 1, 2].sum()
                            node.small = node.left if 2 * below <= node.hist[node.feature, :, 2].sum() else node.right
                            wanted.append((k, at, node.small))
            if not wanted:
                return grown
            laid = [flat(t, edges, 1.0, False) for t in grown]
            found = self._count(rows, width, laid, [(k, small) for k, _, small in wanted], pending)
            for k, at, small in wanted:
                tree, node = grown[k], grown[k].nodes[at]
                other = node.right if small == node.left else node.left
                depth = depths[k][at] + 1
                depths[k] |= {small: depth, other: depth}
                tree.nodes[small] = self._judged(found[k, small], depth)
                tree.nodes[other] = self._judged(node.hist - found[k, small], depth)
                node.hist = node.hist[:1]
