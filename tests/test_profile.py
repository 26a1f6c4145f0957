"""Profiles against the known values of the small crates table."""

import pytest
from pyspark.sql import functions as F

from tidemill.functions.quantiles import exact_quantiles
from tidemill.operators import charts, cleaning, correlation, profile


def one(df):
    return df.first().asDict()


def test_missing(crates):
    rows = {r["column"]: r for r in profile.missing_values(crates).collect()}
    assert set(rows) == {"weight", "market"}
    assert (rows["weight"]["null_count"], rows["weight"]["null_percentage"]) == (1, 6.67)


def test_column_statistics(crates):
    s = one(profile.column_statistics(crates, "weight"))
    expected = dict(
        mean=19.7857, median=14.25, std=20.3486, min=11, max=90, q25=12.75, q75=17.125, skewness=3.6528, kurtosis=13.5249, unique_count=11
    )
    assert {k: s[k] for k in expected} == expected


def test_column_statistics_text(crates):
    s = one(profile.column_statistics(crates, "kind"))
    assert (s["most_frequent"], s["most_frequent_count"], s["unique_count"]) == ("plum", 6, 3)
    assert s["top_5_values"] == ["plum=6", "pear=5", "fig=4"]


def test_overview(crates):
    rows = {r["column"]: r for r in profile.dataset_overview(crates).collect()}
    price = rows["price"]
    assert [price[k] for k in ("mean", "std", "median", "min", "max")] == [374.67, 82.17, 350.0, 275.0, 510.0]
    assert rows["market"]["most_frequent"] == "Oslo"
    assert price["missing_percentage"] == 2.22
    assert (price["total_missing"], price["columns_with_missing"]) == (2, 2)


def test_value_counts(crates):
    got = [(r["value"], r["count"], r["percentage"]) for r in profile.value_counts(crates, "kind").collect()]
    assert got == [("plum", 6, 40.0), ("pear", 5, 33.33), ("fig", 4, 26.67)]
    city = {r["value"]: r["count"] for r in profile.value_counts(crates, "market").collect()}
    assert city == {"Oslo": 6, "Bergen": 5, "Tromso": 3, "NULL": 1}
    shares = profile.value_counts(crates, "kind", normalize=True).collect()
    assert shares[0]["fraction"] == 0.4


def test_duplicates_and_quality(crates):
    assert one(profile.duplicate_count(crates)) == {"duplicate_rows": 3, "duplicate_percentage": 20.0, "total_rows": 15}
    assert one(profile.duplicate_count(crates, digest=True))["duplicate_rows"] == 3
    checks = {(r["check"], r["item"]): r for r in profile.data_quality_report(crates).collect()}
    assert checks["duplicates", "duplicate_rows"]["flagged"] is True
    assert checks["missing", "total_missing"]["value"] == 2


def test_profile_classes(crates):
    rows = {r["column"]: r["class"] for r in profile.column_profile(crates).collect()}
    assert rows["weight"] == "numeric" and rows["organic"] == "boolean" and rows["market"] == "categorical"


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    s = one(profile.column_statistics(df, "x"))
    assert (s["null_count"], s["mean"], s["max"], s["unique_count"]) == (2, 2.0, 3.0, 2)


def test_constant_column(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 3.0), (5.0, 4.0)], "x double, y double")
    s = one(profile.column_statistics(df, "x"))
    assert (s["skewness"], s["kurtosis"], s["std"]) == (0.0, 0.0, 0.0)
    assert correlation.pearson_pairs(df, ["x", "y"])["x", "y"] is None


def test_problem_type(crates):
    assert profile.problem_type(crates, "kind") == "classification"
    assert profile.problem_type(crates, "price") == "regression"


def test_missing_column_is_an_error(crates):
    with pytest.raises(ValueError, match="not found"):
        profile.column_statistics(crates, "nope")
    with pytest.raises(ValueError, match="not numeric"):
        cleaning.detect_outliers(crates, "market")


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_partitioning_does_not_matter(crates, parts):
    base = profile.column_profile(crates, samples=0).collect()
    assert profile.column_profile(crates.repartition(parts), samples=0).collect() == base


def test_quantiles_match_numpy_on_skewed_data(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    x = np.where(rng.random(5000) < 0.35, 7.25, rng.lognormal(2, 1.5, 5000))
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    # A small sketch and a small fetch limit force several narrowing rounds.
    got = exact_quantiles(df, {"x": F.col("x")}, probs, accuracy=20, fetch_limit=50)["x"]
    assert got == pytest.approx(list(np.quantile(x, probs)), rel=1e-12)


def test_histogram(crates):
    rows = charts.histogram(crates, "weight", 10).collect()
    assert len(rows) == 10 and sum(r["count"] for r in rows) == 14
    flat = crates.select(F.lit(3).alias("x"))
    assert sum(r["count"] for r in charts.histogram(flat, "x", 4).collect()) == 15


def test_box_plot(crates):
    box = one(charts.box_plot(crates.select("weight")))
    assert (box["lower_bound"], box["upper_bound"], box["outlier_count"], box["whisker_high"]) == (6.1875, 23.6875, 1, 18.0)


def test_samples_of_a_column_that_starts_with_gaps(spark):
    df = spark.range(1000, numPartitions=1).selectExpr("id", "case when id >= 500 then id end as late")
    found = {r["column"]: r["samples"] for r in profile.column_profile(df, samples=3).collect()}
    assert found == {"id": ["0", "1", "2"], "late": ["500", "501", "502"]}


def test_scatter_grid_keeps_every_group(spark):
    df = spark.range(60).selectExpr("id as x", "id * 2 as y", "case when id % 20 > 0 then id % 20 end as g")
    grid = charts.scatter_grid(df, "x", "y", "g", bins=4)
    assert grid.select("group").distinct().count() == 20 and grid.groupBy().sum("count").first()[0] == 60
