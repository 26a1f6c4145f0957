"""Kernel machines and leaf-wise trees against plain numpy versions."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidemill.operators import kernel, leafwise, modeling as m
from tidemill.sources import model_table


def vectors(spark, x, y, parts=5):
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y)]
    names = [f"f{i}" for i in range(x.shape[1])]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", label double").repartition(parts)
    return VectorAssembler(inputCols=names, outputCol="features").transform(frame).select(*names, "features", "label")


def ring(n=1500, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 2))
    return x * [1.0, 50.0] + [0, 7], (np.hypot(*x.T) > 1.2).astype(int)


def test_a_ring_is_learned_with_its_chances(spark):
    x, y = ring()
    table = vectors(spark, x, y)
    fitted = kernel.KernelSVM("classification", 2).fit(table)
    out = fitted.transform(table).select("label", "prediction", F.col("probability").cast("string")).collect()
    assert np.mean([r.label == r.prediction for r in out]) > 0.97
    p, chances = kernel.KernelMachine.outputs(fitted.numbers, x)
    assert np.allclose(chances.sum(1), 1) and chances[y == 1, 1].mean() > 0.9 > 0.1 > chances[y == 0, 1].mean()
    # The fitted weights lie at the least loss that a plain version finds.
    n = {k: np.array(v) if isinstance(v, list) else v for k, v in fitted.numbers.items()}
    z = kernel.fourier(x, n)
    assert z[:, :-1] @ z[:5, :-1].T == pytest.approx(np.exp(-0.5 * (((x[:, None] - x[None, :5]) / n["spread"]) ** 2).sum(2)), abs=0.45)

    def objective(flat):
        w, sign = flat.reshape(1, -1), np.where(y == 1, 1.0, -1.0)
        over = 1 - sign * (z @ w[0])
        rounded = np.where(over <= 0, 0, np.where(over < kernel.CORNER, over**2 / (2 * kernel.CORNER), over - kernel.CORNER / 2))
        slope = -(np.clip(over, 0, kernel.CORNER) / kernel.CORNER * sign) @ z
        free = np.append(np.ones(z.shape[1] - 1), 0)
        return rounded.sum() + 0.5 * (w[0] ** 2 * free).sum(), slope + w[0] * free

    mine = objective(n["weights"].ravel())[0]
    best = objective(kernel.minimise(objective, np.zeros(z.shape[1]), 400, 1e-9))[0]
    assert best <= mine <= 1.05 * best


def test_support_vector_regression_and_several_classes(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-3, 3, (900, 1))
    y = 10 * np.sin(2 * x[:, 0]) + 3
    fitted = kernel.KernelSVM("regression", 0, C=5.0, gamma=4.0).fit(vectors(spark, x, y))
    p, none = kernel.KernelMachine.outputs(fitted.numbers, x)
    assert none is None and np.abs(p - y).mean() < 1.2
    z = rng.normal(0, 1, (900, 2))
    group = (z[:, 0] > 0) + 2 * (z[:, 1] > 0)
    several = kernel.KernelSVM("classification", 4).fit(vectors(spark, z, group))
    p, chances = kernel.KernelMachine.outputs(several.numbers, z)
    assert np.mean(p == group) > 0.95 and chances.shape == (900, 4)


def plain_trees(x, y, classes, edges, rounds, leaves, rate, least):
    """Best leaf first, one split at a time, straight from the rows."""
    bins = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1)
    k = classes if classes > 2 else 1
    if not classes:
        start = [y.mean()]
    else:
        shares = np.bincount(y.astype(int), minlength=classes) / len(y)
        start = [np.log(shares[1] / shares[0])] if classes == 2 else np.log(shares)
    margin = np.tile(np.array(start, dtype=float), (len(x), 1))
    for _ in range(rounds):
        g, h = leafwise.gradients(margin, y, classes)
        for t in range(k):
            parts = [np.arange(len(x))]

            def best(rows):
                found = (1e-9, None)
                total = g[rows, t].sum() ** 2 / h[rows, t].sum()
                for f in range(x.shape[1]):
                    for b in np.unique(bins[rows, f]):
                        left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                        if min(len(left), len(right)) < least:
                            continue
                        gain = sum(g[s, t].sum() ** 2 / h[s, t].sum() for s in (left, right)) - total
                        if gain > found[0] + 1e-9:
                            found = (gain, (left, right))
                return found

            known = [best(parts[0])]
            while len(parts) < leaves:
                i = max(range(len(parts)), key=lambda i: known[i][0])
                if known[i][1] is None:
                    break
                left, right = known[i][1]
                parts[i : i + 1], known[i : i + 1] = [left, right], [best(left), best(right)]
            for rows in parts:
                margin[rows, t] += -rate * g[rows, t].sum() / h[rows, t].sum()
    return margin


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_leafwise_trees_equal_a_plain_grower(spark, monkeypatch, classes):
    monkeypatch.setattr(leafwise, "REWRITE", 2)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(0, 1, (260, 3)), 1)
    score = x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(0, 0.1, 260)
    y = score if not classes else (np.digitize(score, [-0.4, 0.6][: classes - 1])).astype(float)
    trainer = leafwise.LeafwiseBoosting("classification" if classes else "regression", classes, n_estimators=3, num_leaves=7, learning_rate=0.3, least_rows=8, bins=16)
    table = vectors(spark, x, y)
    fitted = trainer.fit(table)
    n = fitted.numbers
    margin = np.tile(np.array(n["start"]), (len(x), 1))
    for trees in n["rounds"]:
        assert max(sum(f < 0 and i in {0, *t["left"], *t["right"]} for i, f in enumerate(t["feature"])) for t in trees) <= 7
        for k, tree in enumerate(trees):
            margin[:, k] += np.array(tree["value"])[leafwise.walk(tree, x, False)]
    want = plain_trees(x, y, classes, trainer._edges(table, 3), 3, 7, 0.3, 8)
    assert margin == pytest.approx(want, abs=1e-6)


def test_new_models_through_training_saving_and_scoring(spark, tmp_path):
    x, y = ring(600, 9)
    frame = spark.createDataFrame([(i, *map(float, r), "out" if t else "in") for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, side string")
    for name, params in (("svm", {}), ("lightgbm", {"n_estimators": 20, "num_leaves": 8})):
        trained = m.train_model(frame, "side", name, key=["id"], exclude=["id"], params=params)
        assert trained.metrics["accuracy"] > 0.9 and trained.metrics["roc_auc"] > 0.95
        assert {f for f, v in m.importances(trained) if v > 0} == {"a", "b"}
        again = model_table.load_model(spark, str(tmp_path), model_table.save_model(spark, str(tmp_path), trained))
        rows = {r.id: (r.prediction, r.confidence) for r in m.score(again, frame, ["id"]).collect()}
        assert rows == {r.id: (r.prediction, r.confidence) for r in m.score(trained, frame, ["id"]).collect()}
    one = leafwise.LeafwiseBoosting("classification", 1, n_estimators=2).fit(vectors(spark, x[:40], np.zeros(40)))
    assert one.transform(vectors(spark, x[:3], [0, 0, 0])).select("prediction").distinct().collect() == [(0.0,)]
