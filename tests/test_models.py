"""Training, scoring, the model table and step runs on a small separable table."""

import pytest
from pyspark.sql import functions as F

from tidemill.operators import metrics, modeling as m
from tidemill.operators.features import fit_standard_scaler
from tidemill.plans import automatic, steps
from tidemill.sources import model_table

TREES = {"n_estimators": 5, "max_depth": 3}


@pytest.fixture(scope="module")
def staff(spark):
    """Who leaves depends on satisfaction; one feature has gaps and one is text."""
    u = lambda seed: F.rand(seed)
    df = spark.range(400, numPartitions=4).select(
        "id",
        F.when(u(1) > 0.1, F.round(u(2) * 9 + 1, 2)).alias("satisfaction"),
        F.round(u(3) * 40 + 20, 1).alias("hours"),
        F.element_at(F.array(*[F.lit(v) for v in ("HR", "IT", "Ops")]), (F.floor(u(4) * 3) + 1).cast("int")).alias("team"),
    )
    quits = (F.coalesce("satisfaction", F.lit(9)) < 5).cast("int")
    rows = df.select("*", quits.alias("will_quit")).collect()
    return spark.createDataFrame(rows, "id long, satisfaction double, hours double, team string, will_quit int").persist()


def test_split_covers_each_row_once_and_keeps_shares(staff):
    train, test = m.train_test(staff, "will_quit", ["id"], 0.25, stratify=True)
    assert train.count() + test.count() == 400 and train.join(test, "id").count() == 0
    for label in (0, 1):
        total, held = staff.filter(f"will_quit = {label}").count(), test.filter(f"will_quit = {label}").count()
        assert abs(held - 0.25 * total) <= 1
    moved = m.train_test(staff.repartition(7), "will_quit", ["id"], 0.25, stratify=True)[1]
    assert {r["id"] for r in moved.collect()} == {r["id"] for r in test.collect()}


def test_folds_cover_all_rows(staff):
    counts = m.with_folds(staff, ["id"], 5).groupBy("fold").count().collect()
    assert len(counts) == 5 and sum(r["count"] for r in counts) == 400


def test_train_compare_score_save(spark, staff, tmp_path):
    found = m.auto_train(
        staff, "will_quit", 2, key=["id"], exclude=["id"], models=("random_forest", "logistic_regression", "no_such_model"),
        params={"random_forest": TREES},
    )
    rows = found.results.collect()
    assert [r["model_name"] for r in rows if r["metric"] == "error"] == ["no_such_model"]
    assert found.best.metrics["accuracy"] > 0.8 and found.best.metrics["roc_auc"] > 0.8
    flagged = {r["model_name"] for r in m.compare_models(found.models, found.test).collect() if r["best"]}
    assert len(flagged) == 1
    assert m.importances(found.models[0])[0][0] == "satisfaction"
    scored = m.score(found.models[0], staff.drop("will_quit"), ["id"])
    assert scored.count() == 400 and scored.filter("confidence < 0.5 OR prediction NOT IN ('0', '1')").count() == 0
    with pytest.raises(ValueError, match="missing features"):
        m.score(found.best, staff.drop("hours"))
    root = str(tmp_path)
    first = model_table.save_model(spark, root, found.models[0])
    second = model_table.save_model(spark, root, found.models[1])
    assert [r["model_id"] for r in model_table.list_models(spark, root).collect()] == [second, first]
    again = m.score(model_table.load_model(spark, root, first), staff, ["id"])
    assert again.orderBy("id").collect() == scored.orderBy("id").collect()
    assert model_table.delete_model(spark, root, second) and not model_table.delete_model(spark, root, second)
    assert model_table.model_summary(model_table.list_models(spark, root)).first()["models"] == 1


def test_cross_validation_and_search(staff):
    folds = m.cross_validate(staff, "hours", "linear_regression", 3, ["id"], exclude=["id"]).collect()
    assert len(folds) == 3 and folds[0]["scoring"] == "r2" and folds[0]["model"] == "linear_regression"
    best = m.tune(staff, "will_quit", "random_forest", 2, ["id"], {"n_estimators": [3], "max_depth": [1, 3]}, exclude=["id"]).collect()
    assert [r["place"] for r in best] == [1, 2] and best[0]["mean_score"] >= best[1]["mean_score"]


def test_three_classes_and_errors(staff):
    gbt = m.train_model(staff, "team", "gbt", key=["id"], params={"n_estimators": 2, "max_depth": 2}, exclude=["id"])
    assert m.score(gbt, staff, ["id"]).select("prediction").distinct().count() <= 3
    assert m.train_model(staff, "will_quit", "svm", key=["id"], params={"max_iter": 5}, exclude=["id"]).metrics["accuracy"] > 0.7
    assert "rmse" in m.train_model(staff, "hours", "svm", key=["id"], exclude=["id"]).metrics
    with pytest.raises(ValueError, match="classification"):
        m.train_model(staff, "hours", "logistic")
    with pytest.raises(ValueError, match="unknown parameters"):
        m.build_estimator("random_forest", "classification", 2, 10, {"nope": 1})


def test_auc_with_and_without_ranges(staff, monkeypatch):
    direct = metrics.roc_auc(staff, "will_quit", "hours").first()
    monkeypatch.setattr(metrics, "SMALL_TABLE", 0)
    assert metrics.roc_auc(staff, "will_quit", "hours").first() == direct


def test_metrics_of_a_class_that_is_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "a")], "y string, p string")
    assert tuple(metrics.classification_metrics(df, "y", "p").first()) == (0.3333, 0.3333, 0.3333, 0.3333, 3)


def test_failing_step_leaves_the_table(crates):
    plan = [
        steps.Step("fill_missing_values", {"column": "weight", "strategy": "median"}, "cleaning"),
        steps.Step("drop_columns", {"column": "absent"}, "cleaning"),
        steps.Step("no_such_tool", {}, "cleaning"),
        steps.Step(lambda df: df.withColumn("twice", F.col("weight") * 2), {}, "feature_engineering"),
        steps.Step("one_hot_encode", {"columns_to_encode": "kind, market", "drop_first": "false"}, "feature_engineering"),
        steps.Step("create_histogram", {"column": "weight", "title": ""}, "visualization"),
    ]
    run = steps.run_steps(crates, plan)
    assert [r[4] for r in run.log] == [True, False, False, True, True, True]
    assert "kind_plum" in run.table.columns and "twice" in run.table.columns and run.table.count() == 15
    summary = {r["phase"]: (r["steps"], r["errors"]) for r in steps.run_summary(run.log_table()).collect()}
    assert summary == {"cleaning": (3, 2), "feature_engineering": (2, 0), "visualization": (1, 0)}
    later = steps.run_steps(crates, plan, start=5)
    assert len(later.log) == 1


def test_predictions_replay_the_recorded_transforms(staff):
    plan = [
        steps.Step("standard_scaler", {"columns_to_scale": "hours"}),
        steps.Step("train_specific_model", {"target_column": "will_quit", "model_type": "random_forest", "n_estimators": 3}),
    ]
    run = steps.run_steps(staff.drop("id"), plan)
    assert all(r[4] for r in run.log)
    raw = staff.drop("will_quit")
    direct = m.score(run.models[0].__class__(**{**run.models[0].__dict__, "history": []}), fit_standard_scaler(staff, ["hours"]).apply(raw), ["id"])
    replayed = steps.make_predictions(run, raw).select("id", "prediction", "probabilities", "confidence")
    assert replayed.orderBy("id").collect() == direct.orderBy("id").collect()


def test_kept_columns_come_before_the_recorded_transforms(staff):
    run = steps.run_steps(staff, [
        steps.Step("standard_scaler", {"columns_to_scale": "hours"}),
        steps.Step("train_specific_model", {"target_column": "will_quit", "model_type": "random_forest", "n_estimators": 3}),
    ])
    kept = m.score(run.models[0], staff, ["id", "hours"]).select("id", "hours")
    assert kept.orderBy("id").collect() == staff.select("id", "hours").orderBy("id").collect()


def test_rows_of_an_unseen_class_are_errors(staff):
    model = m.train_model(staff, "will_quit", "random_forest", key=["id"], exclude=["id"], params=TREES)
    known = {r["metric"]: r["value"] for r in m.evaluate_model(model, staff).collect()}
    more = staff.unionByName(staff.withColumn("will_quit", F.lit(7)))
    found = {r["metric"]: r["value"] for r in m.evaluate_model(model, more).collect()}
    assert found["accuracy"] == pytest.approx(known["accuracy"] / 2, abs=1e-3) and found["roc_auc"] == known["roc_auc"]


def test_a_step_that_fails_while_running_is_logged(crates):
    run = steps.run_steps(crates, [
        steps.Step(lambda df: df.withColumn("n", F.col("kind").cast("int")), {}),
        steps.Step("drop_columns", {"column": "weight"}),
    ])
    assert [r[4] for r in run.log] == [False, True]
    assert "n" not in run.table.columns and "weight" not in run.table.columns and run.table.count() == crates.count()


def test_targets_and_plans(staff, crates):
    assert automatic.resolve_target(crates, "PRICE") == "price"
    assert automatic.resolve_target(crates, "absent") == "rating"
    assert automatic.resolve_target(crates.withColumn("Price", F.lit(1))) == "Price"
    found = automatic.suggest_steps(crates, done=["create_box_plot"])
    assert [s.priority for s in found] == sorted(s.priority for s in found)
    assert found[0].tool == "remove_duplicates" and all(s.tool != "create_box_plot" for s in found)


def test_texts_of_any_cardinality_and_unseen_ones(spark, staff, tmp_path, monkeypatch):
    from tidemill.operators import features

    monkeypatch.setattr(features, "LABEL_INLINE_LIMIT", 3)
    named = staff.withColumn("who", F.concat(F.lit("n"), F.col("id").cast("string")))
    model = m.train_model(named, "will_quit", "random_forest", key=["id"], exclude=["id"], params=TREES)
    table = next(s.params for s in model.prepared.steps if s.params.get("column") == "who")
    assert model.prepared.blank("who") == table["codes"] and model.prepared.blank("hours") == 0.0
    loaded = model_table.load_model(spark, str(tmp_path), model_table.save_model(spark, str(tmp_path), model))
    kept = [s.params["table"] for s in loaded.prepared.steps if "table" in s.params]
    assert kept and all(p.startswith(str(tmp_path)) for p in kept)
    assert m.score(loaded, named, ["id"]).orderBy("id").collect() == m.score(model, named, ["id"]).orderBy("id").collect()


def test_stated_problem_and_bounded_rows(staff):
    found = m.train_model(staff, "id", "linear_regression", key=["id"], problem="regression")
    assert found.kind == "regression"
    with pytest.raises(ValueError, match="numeric target"):
        m.train_model(staff, "team", problem="regression")
    with pytest.raises(ValueError, match="problem must be"):
        m.train_model(staff, "team", problem="ranking")
    n = staff.count()
    assert m.bounded(staff, ["id"], n).count() == n and 0 < m.bounded(staff, ["id"], n // 2).count() < n


def test_stratified_folds(staff):
    rows = m.with_folds(staff, ["id"], 5, stratify_by="team").groupBy("team", "fold").count().collect()
    for team in {r["team"] for r in rows}:
        sizes = [r["count"] for r in rows if r["team"] == team]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_plans_have_no_limits(spark):
    wide = spark.range(20).select(*[F.when(F.col("id") > i, F.col("id")).alias(f"c{i}") for i in range(10)])
    assert len([s for s in automatic.cleaning_steps(wide) if s.tool_name == "fill_missing_values"]) == 10


def test_box_plot_keeps_every_row(crates):
    from tidemill.operators import charts

    rows = {r["group"]: r["count"] for r in charts.box_plot(crates, "price", "market", groups=1).collect()}
    assert set(rows) == {"Oslo", "(other)"} and sum(rows.values()) == crates.count()


def test_hours_are_in_utc(spark):
    from tidemill.operators import logs

    df = spark.createDataFrame([(0,)], "s long").select(F.timestamp_seconds(F.col("s") + 3600 * 5).alias("ts"))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        assert logs.hourly(df, F.lit(False)).first()["hour"] == "1970-01-01T05"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_late_rows_of_a_stream(spark, tmp_path):
    from datetime import datetime

    from tidemill.streaming import jobs

    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def batch(*hours):
        spark.createDataFrame([(datetime(2024, 1, 1, h, 30),) for h in hours], "ts timestamp_ntz").coalesce(1).write.mode("append").parquet(source)
        stream = jobs.hourly_stream(jobs.read_stream(spark, source, spark.read.parquet(source).schema), F.lit(False))
        jobs.start_keyed(stream, out, str(tmp_path / "state"), interval=None).awaitTermination()
        return {r["hour"][-2:]: r["total"] for r in jobs.latest(spark, out, stream.schema, ["hour"]).collect()}

    assert batch(1, 5, 5) == {"01": 1, "05": 2}
    # The watermark now stands at 04:30, so the row of hour 1 comes too late.
    assert batch(1, 5, 6) == {"01": 1, "05": 3, "06": 1}


def test_bounded_fits_are_scored_on_whole_folds(staff, monkeypatch):
    fitted, scored, learned = [], [], []
    fit, score_of, prepare = m._fit, m._score_of, m.prepare
    monkeypatch.setattr(m, "_fit", lambda model, p, table, *rest: (fitted.append(table.count()), fit(model, p, table, *rest))[1])
    monkeypatch.setattr(m, "_score_of", lambda kind, rows: (scored.append(rows.count()), score_of(kind, rows))[1])
    monkeypatch.setattr(m, "prepare", lambda df, *rest, **more: (learned.append(df.count()), prepare(df, *rest, **more))[1])
    found = m.auto_train(staff, "will_quit", 3, key=["id"], models=("logistic_regression",), exclude=["id"], max_rows=100)
    train = m.train_test(staff, "will_quit", ["id"], 0.2, 42, True)[0].count()
    assert found.best is not None and sum(scored) == train and learned == [train]
    assert len(fitted) == 4 and all(60 <= n <= 140 for n in fitted)
    m.train_model(staff, "will_quit", "logistic_regression", key=["id"], exclude=["id"], max_rows=100)
    m.feature_importance(staff, "will_quit", "logistic_regression", exclude=["id"], max_rows=100)
    assert learned[1:] == [train, 400] and all(60 <= n <= 140 for n in fitted[4:])


def test_fits_of_a_search_learn_from_rows_kept_apart(spark):
    rows = spark.range(4_000).select("id", (F.col("id") % 4).alias("fold"), F.col("id").cast("double").alias("features"), F.lit(0.0).alias("label"))
    rows = rows.withColumn("unit", m.bound_unit(["id"])).repartition(8, "id").persist()
    try:
        for most in (500, 3_500, None):
            learned = m._Learned(rows, most)
            for fold in (None, 0, 3):
                own = rows if fold is None else rows.where(F.col("fold") != fold)
                want = m._within(own, most, "unit").select("features", "label").rdd.glom().collect()
                assert learned.without(fold).rdd.glom().collect() == want
            assert (learned.part is rows) == (most != 500)
            if most == 500:
                # Fits scan a kept table of few rows, not the whole one.
                assert learned.part.storageLevel.useMemory and learned.part.count() < 800
                learned.part.unpersist()
    finally:
        rows.unpersist()


def test_a_search_of_logistic_regressions_keeps_no_rows_in_executors(spark, staff, monkeypatch):
    """All fits share passes over stored rows; each score is that of Spark's trainer on the same rows."""
    monkeypatch.setattr(m, "_fit", None)  # no fit of its own, which would cache its rows
    fold_table, stored = m._fold_table, []
    monkeypatch.setattr(m, "_fold_table", lambda *args: (stored.append(fold_table(*args)), stored[-1])[1])
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    found = {r["params"]: r for r in m.tune(staff, "will_quit", "logistic_regression", 3, ["id"], {"C": [0.01, 10]}, exclude=["id"]).collect()}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    prepared, _, table, rows = stored[0]
    for c in (0.01, 10):
        scores = []
        for fold in range(3):
            est = m.build_estimator("logistic_regression", "classification", 2, rows - rows // 3, {"C": c})
            scores.append(m._score_of("classification", est.fit(table.filter(F.col("fold") != fold)).transform(table.filter(F.col("fold") == fold))))
        assert found[str({"C": c})]["mean_score"] == round(sum(scores) / 3, 4)


def test_logistic_fits_that_share_passes_equal_sparks(spark, monkeypatch):
    import numpy as np
    from pyspark.ml.classification import LogisticRegression

    from tidemill.operators import logistic

    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(5e4, 3e4, 900), rng.normal(size=900), np.full(900, 7.0), rng.integers(0, 3, 900)])
    y = (x[:, 0] / 3e4 + x[:, 1] + rng.normal(size=900) > 2).astype(float)
    rows = [(*map(float, r), float(v), i % 3) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "f0 double, f1 double, f2 double, f3 double, label double, fold int").repartition(4)
    monkeypatch.setattr(logistic, "TOGETHER", 2)
    for ridge in (0.0, 0.3):
        fits = [logistic.Fit(i, ridge, 500, 1e-6) for i in range(3)]
        found = logistic.fold_accuracy(df, 4, 3, fits)
        for i, share in enumerate(found):
            model = LogisticRegression(maxIter=500, regParam=ridge, standardization=False).fit(m.assembler(4).transform(df.where(F.col("fold") != i)))
            assert share == m._score_of("classification", model.transform(m.assembler(4).transform(df.where(F.col("fold") == i))))
    # Folds of one class only: the rest is learned, or the one class is what is predicted.
    one = df.withColumn("label", F.when(F.col("fold") == 0, 1.0).otherwise(0.0))
    assert logistic.fold_accuracy(one, 4, 2, [logistic.Fit(0, 0.1, 500, 1e-6)]) == [0.0]
    with pytest.raises(ValueError, match="finite"):
        logistic.fold_accuracy(df.withColumn("f1", F.lit(float("nan"))), 4, 3, [logistic.Fit(0, 0.1, 500, 1e-6)])


@pytest.mark.parametrize("name", ["auto_train", "compare_models", "automatic_run"])
def test_registered_comparisons_learn_from_all_rows(spark, monkeypatch, name):
    from inspect import signature

    from tidemill.queries import QUERIES, models

    class Asked(Exception):
        pass

    def ask(fn):
        def asked(*args, **more):
            raise Asked(signature(fn).bind(*args, **more).arguments.get("max_rows"))

        return asked

    monkeypatch.setattr(models.modeling, "auto_train", ask(m.auto_train))
    monkeypatch.setattr(models.automatic, "automatic_run", ask(automatic.automatic_run))
    with pytest.raises(Asked) as bound:
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert bound.value.args == (None,)
