import numpy as np
import pandas as pd
import pytest

from tidemill.operators import correlation as c


def brute_tau(x, y):
    dx, dy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    n = len(x)
    pairs = n * (n - 1) / 2
    tied = [((d == 0).sum() - n) / 2 for d in (dx, dy)]
    return (dx * dy).sum() / 2 / np.sqrt((pairs - tied[0]) * (pairs - tied[1]))


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows share one x and another third share one y; both have gaps."""
    rng = np.random.default_rng(3)
    n = 700
    x = np.where(rng.random(n) < 0.34, 5.0, rng.integers(0, 150, n))
    y = np.where(rng.random(n) < 0.34, 7.0, x * 0.02 + rng.normal(size=n).round(2))
    z = np.where(rng.random(n) < 0.2, np.nan, x + rng.normal(size=n) * 30)
    return pd.DataFrame({"x": x.astype(float), "y": y, "z": z})


def test_known_values(crates):
    cols = ["weight", "price", "rating"]
    pearson = {k: round(v, 4) for k, v in c.pearson_pairs(crates, cols).items()}
    assert pearson == {("weight", "price"): 0.1878, ("weight", "rating"): -0.5446, ("price", "rating"): -0.4005}
    spearman = {k: round(v, 4) for k, v in c.spearman_pairs(crates, cols).items()}
    assert spearman == {("weight", "price"): 0.8628, ("weight", "rating"): -0.6607, ("price", "rating"): -0.3747}


@pytest.mark.parametrize("parts", [None, (1, 1), (6, 1), (5, 4), (3, 9)])
def test_kendall_by_ranges_equals_all_pairs(spark, skewed, parts):
    df = spark.createDataFrame(skewed[["x", "y"]]).repartition(5)
    assert c.kendall_tau(df, "x", "y", parts) == pytest.approx(brute_tau(skewed.x.to_numpy(), skewed.y.to_numpy()), abs=1e-12)


def test_all_methods_match_pandas_with_gaps(spark, skewed):
    df = spark.createDataFrame(skewed)
    whole = skewed.dropna()
    assert c.pearson_pairs(df, ["x", "z"])["x", "z"] == pytest.approx(skewed.corr()["x"]["z"])
    assert c.spearman_pairs(df, ["x", "z"])["x", "z"] == pytest.approx(whole.rank().corr()["x"]["z"])
    assert c.kendall_tau(df, "x", "z") == pytest.approx(brute_tau(whole.x.to_numpy(), whole.z.to_numpy()))


def test_ranks_through_the_shuffle_join(spark, skewed, monkeypatch):
    monkeypatch.setattr(c, "SMALL_TABLE", 0)
    df = spark.createDataFrame(skewed[["x", "y"]])
    assert c.spearman_pairs(df, ["x", "y"])["x", "y"] == pytest.approx(skewed[["x", "y"]].rank().corr()["x"]["y"])


def test_wide_path_equals_narrow_path(spark, skewed, monkeypatch):
    df = spark.createDataFrame(skewed)
    narrow = c.pearson_pairs(df, ["x", "y", "z"])
    monkeypatch.setattr(c, "WIDE", 1)
    wide = c.pearson_pairs(df, ["x", "y", "z"])
    assert wide == pytest.approx(narrow)


def test_concordance_of_small_arrays():
    assert c.concordance(np.array([1.0, 2, 3]), np.array([1.0, 2, 3]), np.ones(3)) == 3
    assert c.concordance(np.array([1.0, 2, 3]), np.array([3.0, 2, 1]), np.ones(3)) == -3
    assert c.concordance(np.array([1.0, 1, 1]), np.array([3.0, 2, 1]), np.ones(3)) == 0


def test_report(crates):
    rows = c.correlation_analysis(crates, "pearson", 0.1).collect()
    assert rows[0]["column2"] == "rating" and rows[0]["strength"] == "moderate" and rows[0]["total_correlations"] == 3
    with pytest.raises(ValueError):
        c.correlation_analysis(crates.select("weight"))
