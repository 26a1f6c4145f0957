"""Exact quantiles of whole columns and of groups against numpy, with sketches merged in two levels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import grouped, quantiles
from tidemill.operators import charts, correlation, modeling

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def grouped_rows():
    rng = random.Random(4)
    rows = [("hot", rng.gauss(0, 5)) for _ in range(9000)]
    rows += [("ties", float(rng.choice([1, 1, 1, 2, 3]))) for _ in range(3000)] + [("one", 7.0)] * 2000
    rows += [(f"s{i}", float(rng.randint(0, 9))) for i in range(60) for _ in range(rng.randint(1, 9))]
    rows += [("hot", None), ("none", None), (None, 5.0), ("hot", float("nan"))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small,few", [(10_000, 100_000), (50, 100_000), (50, 0)])
def test_grouped_quantiles_equal_numpy(spark, monkeypatch, small, few):
    monkeypatch.setattr(grouped, "SMALL_GROUP", small)
    monkeypatch.setattr(grouped, "FEW_GROUPS", few)
    rows = grouped_rows()
    frame = spark.createDataFrame(rows, "k string, v double").repartition(9)
    got = {r.g: (r.n, r.q) for r in grouped.grouped_quantiles(frame, F.col("k"), F.col("v"), PROBS).collect()}
    by = {}
    for k, v in rows:
        if k is not None and v is not None and not np.isnan(v):
            by.setdefault(k, []).append(v)
    assert set(got) == set(by)
    for k, values in by.items():
        assert got[k][0] == len(values)
        assert got[k][1] == pytest.approx(np.quantile(values, PROBS).tolist(), abs=1e-12), k


def test_grouped_quantiles_of_an_empty_table_and_of_hashes(spark, monkeypatch):
    empty = spark.createDataFrame([], "k string, v double")
    assert grouped.grouped_quantiles(empty, F.col("k"), F.col("v"), [0.5]).collect() == []
    monkeypatch.setattr(grouped, "SMALL_GROUP", 100)
    frame = spark.range(20_000).select((F.col("id") % 3).alias("k"), modeling.hash_unit(["id"]).alias("v"))
    got = {r.g: r.q for r in grouped.grouped_quantiles(frame, F.col("k"), F.col("v"), [0.2, 0.8], uniform=True).collect()}
    values = frame.toPandas()
    assert got == {k: pytest.approx(np.quantile(own.v, [0.2, 0.8]).tolist(), abs=1e-15) for k, own in values.groupby("k")}


def test_a_sketch_that_is_off_is_noticed(spark, monkeypatch):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 1, 20_000), rng.normal(1e6, 1, 30)])
    frame = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(6)
    # Brackets of a far too small sketch miss; the counts tell.
    monkeypatch.setattr(quantiles, "sketch_size", lambda accuracy: 64)
    monkeypatch.setattr(grouped, "sketch_size", lambda accuracy: 64)
    monkeypatch.setattr(grouped, "SMALL_GROUP", 500)
    want = np.quantile(values, PROBS).tolist()
    assert quantiles.exact_quantiles(frame, {"v": F.col("v")}, PROBS, fetch_limit=3000)["v"] == pytest.approx(want, abs=1e-12)
    got = grouped.grouped_quantiles(frame, F.lit("all"), F.col("v"), PROBS).first()
    assert got.q == pytest.approx(want, abs=1e-12)


def test_sketches_merge_in_two_levels(spark):
    frame = spark.range(0, 100_000, 1, 50).select(F.col("id").cast("double").alias("v"))
    groups = {r[0]: r[1] for r in frame.withColumn("g", quantiles.partition_group()).select("g", F.spark_partition_id().alias("p")).distinct().groupBy("g").count().collect()}
    assert max(groups.values()) <= 2 * 8 and len(groups) <= 8
    n, low, high, cuts = quantiles.sketched(frame, [F.col("v")], [[0.1, 0.5]], 1000)
    assert (n, low, high) == (100_000, 0.0, 99_999.0) and cuts == pytest.approx([10_000, 50_000], abs=300)
    assert quantiles.sketched(frame.where("v < 0"), [F.col("v")], [[0.5]], 1000) == [0, None, None, None]


def test_boxes_of_stated_groups(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 99.0), ("b", 5.0), ("c", None), (None, 1.0)], "k string, v double")
    got = {r.group: (r["count"], r.median, r.whisker_high, r.outlier_count) for r in charts.group_box_plots(frame, "v", "k").collect()}
    assert got == {"a": (4, 2.5, 3.0, 1), "b": (1, 5.0, 5.0, 0)}
    assert [r.group for r in charts.group_box_plots(frame, "v", "k", ["b", "c"]).collect()] == ["b"]


def test_stratified_split_of_very_many_classes(spark):
    frame = spark.range(6000).select("id", (F.col("id") % 1500).alias("c"))
    train, test = modeling.train_test(frame, "c", ["id"], 0.25, stratify=True)
    assert test.count() == 1500 and test.select("c").distinct().count() == 1500
    assert train.columns == ["id", "c"]


def test_kendall_by_ranges_equals_one_task(spark):
    rng = random.Random(8)
    rows = [(float(rng.choice([1, 2, 2, 2, 9]) if i % 3 else rng.random() * 10), float(rng.randint(0, 40) + (i % 7))) for i in range(4000)]
    frame = spark.createDataFrame(rows, "a double, b double")
    whole = correlation.kendall_tau(frame, "a", "b", (1, 1))
    for parts in ((4, 1), (12, 1), (5, 3)):
        assert correlation.kendall_tau(frame, "a", "b", parts) == pytest.approx(whole, abs=1e-12)
