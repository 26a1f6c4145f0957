import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.functions.order import global_index
from tidemill.operators import cleaning


def test_fills(crates):
    ages = lambda s: [r["weight"] for r in cleaning.fill_missing(crates, "weight", s).filter("price = 420").collect()]
    assert ages("median") == [14.25] and ages("mean") == [pytest.approx(19.7857142857)]
    assert cleaning.fill_missing(crates, "market", "mode").filter("price = 365").first()["market"] == "Oslo"
    assert cleaning.fill_missing(crates, "weight", "drop").count() == 14
    with pytest.raises(ValueError, match="not numeric"):
        cleaning.fill_missing(crates, "market", "mean")
    with pytest.raises(ValueError, match="order_by"):
        cleaning.fill_missing(crates, "weight", "forward_fill")


def test_mode_ties_and_all_missing(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "x string")
    assert cleaning.fit_fill(df, "x", "mode") == "a"
    empty = spark.createDataFrame([(None,), (None,)], "x string")
    assert cleaning.fill_missing(empty, "x", "mode").filter("x IS NULL").count() == 2


def test_forward_fill_across_partitions(spark):
    """Gaps longer than a partition, and one key with most of the rows."""
    rng = np.random.default_rng(0)
    n = 4000
    pdf = pd.DataFrame({"t": np.arange(n), "k": np.where(rng.random(n) < 0.7, 0, rng.integers(1, 30, n)), "v": rng.normal(size=n)})
    pdf.loc[rng.random(n) < 0.97, "v"] = np.nan
    pdf.loc[500:2500, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None))).repartition(9)
    got = cleaning.fill_missing(df, "v", "forward_fill", ["t"]).toPandas().sort_values("t")
    assert np.array_equal(got["v"].to_numpy(float), pdf["v"].ffill().to_numpy(), equal_nan=True)
    got = cleaning.fill_missing(df, "v", "forward_fill", ["t"], ["k"]).toPandas().sort_values("t")
    assert np.array_equal(got["v"].to_numpy(float), pdf.groupby("k")["v"].ffill().to_numpy(), equal_nan=True)


def test_duplicates(crates):
    assert cleaning.remove_duplicates(crates).count() == 12
    kept = cleaning.remove_duplicates(crates, ["kind"], "last", ["price"])
    assert {(r["kind"], r["price"]) for r in kept.collect()} == {("plum", 510), ("pear", 350), ("fig", 480)}
    again = cleaning.remove_duplicates(cleaning.remove_duplicates(crates))
    assert again.count() == 12
    report = cleaning.duplicate_report(crates).first()
    assert tuple(report) == (15, 3, 12)


def test_outliers(crates):
    r = cleaning.detect_outliers(crates, "weight").first()
    assert (r["lower_bound"], r["upper_bound"], r["outlier_count"]) == (6.1875, 23.6875, 1)
    assert cleaning.remove_outliers(crates, "weight").count() == 13
    assert cleaning.detect_outliers(crates, "weight", "zscore", 3).first()["outlier_count"] == 1
    assert cleaning.remove_outliers(crates, "weight", "zscore", 3).count() == 13


def test_constant_column_has_no_outliers(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,)], "x double")
    assert cleaning.detect_outliers(df, "x", "zscore").first()["outlier_count"] == 0
    assert cleaning.remove_outliers(df, "x", "zscore").count() == 2


def test_global_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(13)
    assert global_index(df, ["x"]).filter("x <> row_index").count() == 0
