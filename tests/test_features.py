import pytest
from pyspark.sql import functions as F

from tidemill.operators import features as f


def test_scalers_centre_and_scale(crates):
    s = f.scaling_report(crates, f.fit_standard_scaler(crates, ["price", "rating"])).collect()
    assert all(r["mean_after"] == 0 for r in s)
    low, high = f.fit_min_max_scaler(crates, ["price"]).apply(crates).agg(F.min("price"), F.max("price")).first()
    assert (low, high) == (0.0, 1.0)
    out = f.fit_robust_scaler(crates, ["weight"]).apply(crates)
    assert out.filter("price = 290").first()["weight"] == pytest.approx((11 - 14.25) / 4.375)


def test_constant_columns(spark):
    df = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert [r["x"] for r in f.fit_standard_scaler(df).apply(df).collect()] == [0.0, 0.0]
    assert [r["x"] for r in f.fit_min_max_scaler(df, low=2, high=5).apply(df).collect()] == [2.0, 2.0]


def test_encoders(crates):
    hot = f.fit_one_hot(crates, ["market"]).apply(crates)
    assert hot.columns[-2:] == ["market_Oslo", "market_Tromso"]
    missing = hot.filter("price = 365").first()
    assert (missing["market_Oslo"], missing["market_Tromso"]) == (0.0, 0.0)
    label = f.fit_label_encoder(crates, "market")
    assert label.params["labels"] == ["Bergen", "Oslo", "Tromso", "nan"]
    assert label.apply(crates).filter("price = 365").first()["market"] == 3


def test_one_hot_above_the_limit_is_a_vector(crates):
    fitted = f.Fitted.from_json(f.fit_one_hot(crates, ["market"], limit=2).to_json())
    got = {r["market"]: list(r["market_vec"]) for r in fitted.apply(crates).join(crates.select("price", "market").distinct(), "price").collect()}
    assert got == {"Bergen": [0.0, 0.0], "Oslo": [1.0, 0.0], "Tromso": [0.0, 1.0], None: [0.0, 0.0]}
    every = f.fit_one_hot(crates, ["market"], drop_first=False, limit=2).apply(crates)
    assert list(every.filter("price = 310").first()["market_vec"]) == [0.0, 1.0, 0.0]
    assert list(every.filter("price = 365").first()["market_vec"]) == [0.0, 0.0, 0.0]


def test_many_labels_through_a_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(f, "LABEL_INLINE_LIMIT", 3)
    # One label holds most of the rows.
    df = spark.range(600).select("id", F.when(F.col("id") % 3 > 0, "m").otherwise(F.col("id").cast("string")).alias("x"))
    fitted = f.fit_label_encoder(df, "x", str(tmp_path / "labels"))
    order = {v: i for i, v in enumerate(sorted({r["x"] for r in df.collect()}))}
    got = f.Fitted.from_json(fitted.to_json()).apply(df.withColumn("label", F.col("x")))
    assert all(order[r["label"]] == r["x"] for r in got.collect())


def test_log_and_polynomial(crates):
    with pytest.raises(ValueError, match="negative"):
        f.fit_log_transform(crates.select((-F.col("price")).alias("x")), "x")
    names = [n for n, _ in f.polynomial_terms(["a", "b"], 3)]
    assert names == ["a", "b", "apow2", "a_b", "bpow2", "apow3", "apow2_b", "a_bpow2", "bpow3"]
    out = f.fit_polynomial(crates, ["weight", "rating"]).apply(crates)
    assert out.filter("price = 420").first()["weight_rating"] == 14.25 * 8
    six = crates.select("weight", "price", "rating", *[(F.col("rating") + i).alias(f"r{i}") for i in range(3)])
    assert len(f.fit_polynomial(six).params["cols"]) == 6


def test_pca_keeps_total_variance(crates):
    fitted = f.fit_pca(crates, 3)
    assert sum(fitted.params["ratios"]) == pytest.approx(1.0)
    assert all(max(row, key=abs) > 0 for row in fitted.params["loadings"])
    out = fitted.apply(crates)
    assert out.columns[-3:] == ["pca_1", "pca_2", "pca_3"]
    means = out.agg(F.avg("pca_1"), F.avg("pca_2"), F.avg("pca_3")).first()
    assert all(abs(m) < 1e-6 for m in means)
    with pytest.raises(ValueError):
        f.fit_pca(crates.select("weight"), 2)


def test_replay_after_json(crates):
    steps = [f.fit_impute(crates, ["weight"]), f.fit_standard_scaler(crates, ["price"]), f.fit_one_hot(crates, ["kind"])]
    stored = [f.Fitted.from_json(s.to_json()) for s in steps]
    assert f.apply_all(crates, stored).collect() == f.apply_all(crates, steps).collect()


def test_prepare_features(crates):
    out = f.prepare_features(crates.select("weight", "market", "rating"), "rating")
    assert dict(out.dtypes)["market"] == "bigint" and out.filter("weight IS NULL").count() == 0
