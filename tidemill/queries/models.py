"""Splits, metrics, training, scoring and runs of several steps."""

from pyspark.sql import functions as F

from tidemill.operators import features, metrics, modeling
from tidemill.plans import automatic, steps
from tidemill.queries.base import ORDERS_GAPS, fresh_path, orders_gaps, pct, query, rd, table
from tidemill.sources import model_table

UNIT = "(('0x' || substr(md5({seed} || '|' || {key}), 1, 8))::bigint / 4294967296.0)"
ORDER_UNIT = UNIT.format(seed="'42'", key="o_orderkey")
#: Single tree models of the default size learn from about this many rows, chosen by key hash; comparisons of models learn from all.
FIT_ROWS = 20_000
#: Boosting rounds run one after the other, so comparisons of several models keep them few.
FEW_ROUNDS = {"n_estimators": 5, "max_depth": 3}


@query(
    "split_statistics_class",
    f"""select 'rows' as statistic, 'total' as item, count(*)::double as value from orders
    union all select 'rows', 'train', count(*)::double from orders where {ORDER_UNIT} >= 0.2
    union all select 'rows', 'test', count(*)::double from orders where {ORDER_UNIT} < 0.2
    union all select 'class_share', o_orderstatus, {rd('count(*)::double / (select count(*) from orders)', 3)} from orders group by o_orderstatus""",
)
def _(spark, folder):
    return modeling.split_statistics(table(spark, folder, "orders"), "o_orderstatus", ["o_orderkey"])


@query(
    "split_statistics_stratified",
    f"""with u as (select o_orderstatus s, {ORDER_UNIT} u from orders), q as (select s, quantile_cont(u, 0.25) t from u group by s),
    k as (select u.s, u < t as test from u join q on u.s = q.s)
    select 'rows' as statistic, 'total' as item, count(*)::double as value from k
    union all select 'rows', 'train', count(*)::double from k where not test
    union all select 'rows', 'test', count(*)::double from k where test
    union all select 'class_share', s, {rd('count(*)::double / (select count(*) from k)', 3)} from k group by s""",
)
def _(spark, folder):
    return modeling.split_statistics(table(spark, folder, "orders"), "o_orderstatus", ["o_orderkey"], 0.25, stratify=True)


@query(
    "split_statistics_regression",
    f"""with g as (select * from {ORDERS_GAPS} where o_totalprice is not null)
    select 'rows' as statistic, 'total' as item, count(*)::double as value from g
    union all select 'rows', 'train', count(*)::double from g where {ORDER_UNIT} >= 0.3
    union all select 'rows', 'test', count(*)::double from g where {ORDER_UNIT} < 0.3
    union all select 'target', 'mean', {rd('avg(o_totalprice)', 4)} from g union all select 'target', 'std', {rd('stddev_samp(o_totalprice)', 4)} from g
    union all select 'target', 'min', {rd('min(o_totalprice)', 4)} from g union all select 'target', 'max', {rd('max(o_totalprice)', 4)} from g""",
)
def _(spark, folder):
    return modeling.split_statistics(orders_gaps(spark, folder), "o_totalprice", ["o_orderkey"], 0.3)


@query("fold_sizes", f"select least(floor({ORDER_UNIT} * 5), 4)::int as fold, count(*) as n, {rd('avg(o_totalprice)', 4)} as mean_price from orders group by 1")
def _(spark, folder):
    rows = modeling.with_folds(table(spark, folder, "orders"), ["o_orderkey"], 5)
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.round(F.avg("o_totalprice"), 10), 4).alias("mean_price"))


@query(
    "fold_sizes_stratified",
    f"""with u as (select o_orderstatus s, {ORDER_UNIT} u from orders), q as (select s, quantile_cont(u, [0.2, 0.4, 0.6, 0.8]) t from u group by s)
    select s as o_orderstatus, ((u >= t[1])::int + (u >= t[2])::int + (u >= t[3])::int + (u >= t[4])::int)::int as fold, count(*) as n
    from u join q using (s) group by 1, 2""",
)
def _(spark, folder):
    rows = modeling.with_folds(table(spark, folder, "orders"), ["o_orderkey"], 5, stratify_by="o_orderstatus")
    return rows.groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n"))


@query(
    "split_statistics_many_classes",
    f"""with u as (select o_custkey s, {ORDER_UNIT} u from orders), q as (select s, quantile_cont(u, 0.25) t from u group by s),
    k as (select u.s, u < t as test from u join q on u.s = q.s)
    select 'rows' as statistic, 'total' as item, count(*)::double as value from k
    union all select 'rows', 'train', count(*)::double from k where not test
    union all select 'rows', 'test', count(*)::double from k where test
    union all select 'class_share', s::varchar, {rd('count(*)::double / (select count(*) from k)', 3)} from k group by s""",
)
def _(spark, folder):
    return modeling.split_statistics(table(spark, folder, "orders"), "o_custkey", ["o_orderkey"], 0.25, stratify=True, problem="classification")


@query(
    "fold_sizes_many_classes",
    f"""with u as (select o_custkey s, {ORDER_UNIT} u from orders), q as (select s, quantile_cont(u, [0.2, 0.4, 0.6, 0.8]) t from u group by s)
    select s as o_custkey, ((u >= t[1])::int + (u >= t[2])::int + (u >= t[3])::int + (u >= t[4])::int)::int as fold, count(*) as n
    from u join q using (s) group by 1, 2""",
)
def _(spark, folder):
    rows = modeling.with_folds(table(spark, folder, "orders"), ["o_orderkey"], 5, stratify_by="o_custkey")
    return rows.groupBy("o_custkey", "fold").agg(F.count("*").alias("n"))


# Predictions by a fixed rule, so that the metrics can be checked on their own.
GUESS = "(select l_returnflag as label, case when l_quantity > 34 then 'A' when l_quantity > 17 then 'N' else 'X' end as guess from lineitem)"


def guesses(spark, folder):
    q = F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("label"), F.when(q > 34, "A").when(q > 17, "N").otherwise("X").alias("guess")
    )


@query("confusion_matrix", f"select label, guess as prediction, count(*) as n from {GUESS} group by 1, 2")
def _(spark, folder):
    return metrics.confusion_matrix(guesses(spark, folder), "label", "guess")


PER_CLASS = f"""c as (select label v from {GUESS} union select guess from {GUESS}),
  k as (select v, (select count(*) from {GUESS} where label = v) s, (select count(*) from {GUESS} where guess = v) p,
    (select count(*) from {GUESS} where label = v and guess = v) h from c),
  r as (select *, coalesce(h::double / nullif(p, 0), 0) pr, coalesce(h::double / nullif(s, 0), 0) re from k),
  f as (select *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) f1 from r)"""


@query(
    "classification_metrics",
    f"""with {PER_CLASS} select {rd('sum(h)::double / sum(s)', 4)} as accuracy, {rd('sum(pr * s) / sum(s)', 4)} as precision,
    {rd('sum(re * s) / sum(s)', 4)} as recall, {rd('sum(f1 * s) / sum(s)', 4)} as f1_score, sum(s)::bigint as rows from f""",
)
def _(spark, folder):
    return metrics.classification_metrics(guesses(spark, folder), "label", "guess")


@query("class_report", f"with {PER_CLASS} select v as class, {rd('pr', 4)} as precision, {rd('re', 4)} as recall, s as support from f")
def _(spark, folder):
    return metrics.class_report(guesses(spark, folder), "label", "guess")


@query(
    "roc_auc",
    f"""with g as (select (l_returnflag = 'A')::int y, l_extendedprice + l_quantity * 100 s from lineitem),
    r as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 k from g),
    t as (select sum(y)::double p, sum(1 - y)::double n, sum(case when y = 1 then k end) w from r)
    select {rd('(w - p * (p + 1) / 2) / (p * n)', 4)} as roc_auc, p::bigint as positives, n::bigint as negatives from t""",
)
def _(spark, folder):
    li = table(spark, folder, "lineitem")
    scored = li.select(
        (F.col("l_returnflag") == "A").cast("int").alias("y"), (F.col("l_extendedprice") + F.col("l_quantity") * 100).alias("s")
    )
    return metrics.roc_auc(scored, "y", "s")


RULE = "(select l_extendedprice y, l_quantity * 1500 + l_tax * 1000 p from lineitem)"


def ruled(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500 + F.col("l_tax") * 1000).alias("p")
    )


@query(
    "regression_metrics",
    f"""select {rd('1 - avg((y - p) * (y - p)) / var_pop(y)', 4)} as r2_score, {rd('sqrt(avg((y - p) * (y - p)))', 4)} as rmse,
    {rd('avg(abs(y - p))', 4)} as mae, {rd('avg((y - p) * (y - p))', 4)} as mse, count(*) as rows from {RULE}""",
)
def _(spark, folder):
    return metrics.regression_metrics(ruled(spark, folder), "y", "p")


@query(
    "actual_vs_predicted",
    f"""with s as (select min(y) y0, max(y) y1, min(p) p0, max(p) p1, corr(y, p) r from {RULE})
    select least(floor((y - y0) / ((y1 - y0) / 25)), 24)::int as actual_bin, least(floor((p - p0) / ((p1 - p0) / 25)), 24)::int as predicted_bin,
    count(*) as count, {rd('any_value(r)', 4)} as correlation from {RULE}, s group by 1, 2""",
)
def _(spark, folder):
    return metrics.actual_vs_predicted(ruled(spark, folder), "y", "p", bins=25)


# Trained models


def lines(spark, folder):
    return table(spark, folder, "lineitem")


LINE_KEY = ["l_orderkey", "l_partkey", "l_extendedprice"]
#: Keys of other tables say nothing about a line; all other columns are features.
OUT = ["l_orderkey", "l_partkey", "l_suppkey"]


@query(
    "score_linear_model",
    f"""with g as (select o_orderkey k, o_totalprice y, o_custkey x from orders),
    t as (select regr_slope(y, x) b, regr_intercept(y, x) a from g where {UNIT.format(seed="'42'", key="k")} >= 0.2)
    select k as o_orderkey, {rd('a + b * x', 2)} as prediction from g, t""",
)
def _(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    model = modeling.train_model(df, "o_totalprice", "linear_regression", key=["o_orderkey"], exclude=["o_orderkey"])
    out = modeling.score(model, df, ["o_orderkey"])
    return out.select("o_orderkey", F.round(F.round("prediction", 8), 2).alias("prediction"))


@query(
    "evaluate_linear_model",
    f"""with g as (select o_totalprice y, o_custkey x, {ORDER_UNIT} u from orders),
    t as (select regr_slope(y, x) b, regr_intercept(y, x) a from g where u >= 0.2),
    e as (select y, a + b * x p from g, t where u < 0.2),
    m as (select avg((y - p) * (y - p)) mse, avg(abs(y - p)) mae, var_pop(y) v from e)
    select 'r2_score' as metric, {rd('1 - mse / v', 3)} as value from m union all select 'rmse', {rd('sqrt(mse)', 3)} from m
    union all select 'mae', {rd('mae', 3)} from m""",
)
def _(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    model = modeling.train_model(df, "o_totalprice", "linear_regression", key=["o_orderkey"], exclude=["o_orderkey"])
    _, test = modeling.train_test(df, "o_totalprice", ["o_orderkey"])
    out = modeling.evaluate_model(model, test).filter("metric <> 'mse'")
    return out.select("metric", F.round("value", 3).alias("value"))


FOLDS = f"(select o_custkey::double x, o_totalprice y, least(floor({ORDER_UNIT} * 5), 4)::int f from orders)"


@query(
    "cross_validate_linear",
    f"""with g as {FOLDS}, m as (select k.f, regr_slope(y, x) b, regr_intercept(y, x) a from (select distinct f from g) k join g on g.f <> k.f group by k.f),
    s as (select f, 1 - sum((y - a - b * x) * (y - a - b * x)) / (var_pop(y) * count(*)) r from m join g using (f) group by f),
    t as (select avg(r) m, stddev_pop(r) d, min(r) lo, max(r) hi from s)
    select 'linear_regression' as model, 'r2' as scoring, f as fold, {rd('r', 4)} as score, {rd('m', 4)} as mean_score, {rd('d', 4)} as std_score,
    {rd('lo', 4)} as min_score, {rd('hi', 4)} as max_score, {rd('m - 2 * d', 4)} as ci95_low, {rd('m + 2 * d', 4)} as ci95_high from s, t""",
)
def _(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return modeling.cross_validate(df, "o_totalprice", "linear_regression", 5, ["o_orderkey"], exclude=["o_orderkey"])


@query("feature_importance_linear", f"select 1 as place, 'l_quantity' as feature, {rd('abs(regr_slope(l_extendedprice, l_quantity))', 6)} as importance from lineitem")
def _(spark, folder):
    df = table(spark, folder, "lineitem").select("l_extendedprice", "l_quantity")
    return modeling.feature_importance(df, "l_extendedprice", "linear_regression", problem="regression")


LINE_UNIT = UNIT.format(seed="'42'", key="l_orderkey")


def line_fit(x: str, model: str) -> str:
    return f"""select '{model}' m, 1 - sum((y - a - b * x) * (y - a - b * x)) / (var_pop(y) * count(*)) r2, sqrt(avg((y - a - b * x) * (y - a - b * x))) rmse,
      avg(abs(y - a - b * x)) mae from (select l_extendedprice y, {x}::double x from lineitem where {LINE_UNIT} < 0.2),
      (select regr_slope(l_extendedprice, {x}) b, regr_intercept(l_extendedprice, {x}) a from lineitem where {LINE_UNIT} >= 0.2)"""


@query(
    "compare_linear_models",
    f"""with s as ({line_fit('l_quantity', 'by_quantity')} union all {line_fit('l_discount', 'by_discount')}), k as (select m from s order by r2 desc limit 1)
    select m as model_name, 'r2_score' as metric, {rd('r2', 2)} as value, m = (select m from k) as best from s
    union all select m, 'rmse', {rd('rmse', 2)}, m = (select m from k) from s union all select m, 'mae', {rd('mae', 2)}, m = (select m from k) from s""",
)
def _(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_extendedprice")
    found = [
        modeling.train_model(
            df, "l_extendedprice", "linear_regression", key=["l_orderkey"], exclude=["l_orderkey", left_out], model_name=label, problem="regression"
        )
        for label, left_out in (("by_quantity", "l_discount"), ("by_discount", "l_quantity"))
    ]
    _, test = modeling.train_test(df, "l_extendedprice", ["l_orderkey"])
    out = modeling.compare_models(found, test).filter("metric <> 'mse'")
    return out.select("model_name", "metric", F.round(F.round("value", 6), 2).alias("value"), "best")


@query(
    "score_after_logarithm",
    f"""with t as (select regr_slope(o_totalprice, ln(1 + o_custkey)) b, regr_intercept(o_totalprice, ln(1 + o_custkey)) a from orders where {ORDER_UNIT} >= 0.2)
    select o_orderkey, o_custkey, {rd('a + b * ln(1 + o_custkey)', 2)} as prediction from orders, t""",
)
def _(spark, folder):
    raw = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    fitted = [features.fit_log_transform(raw, "o_custkey")]
    fitted.append(features.fit_standard_scaler(fitted[0].apply(raw), ["o_custkey"]))
    ready = features.apply_all(raw, fitted)
    model = modeling.train_model(ready, "o_totalprice", "linear_regression", key=["o_orderkey"], exclude=["o_orderkey"])
    model.history = fitted
    out = modeling.score(model, raw.drop("o_totalprice"), ["o_orderkey", "o_custkey"])
    return out.withColumn("prediction", F.round(F.round("prediction", 8), 2))


@query(
    "load_and_score",
    f"""with t as (select regr_slope(o_totalprice, o_custkey) b, regr_intercept(o_totalprice, o_custkey) a from orders where {ORDER_UNIT} >= 0.2)
    select o_orderkey, {rd('a + b * o_custkey', 2)} as prediction from orders, t""",
)
def _(spark, folder):
    root = fresh_path(spark, "models")
    df = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    model = modeling.train_model(df, "o_totalprice", "linear_regression", key=["o_orderkey"], exclude=["o_orderkey"])
    again = model_table.load_model(spark, root, model_table.save_model(spark, root, model))
    out = modeling.score(again, df.drop("o_totalprice"), ["o_orderkey"])
    return out.select("o_orderkey", F.round(F.round("prediction", 8), 2).alias("prediction"))


@query(
    "class_probabilities",
    f"""with g as (select l_quantity > 25 x, case when l_extendedprice > 30000 then 'high' else 'low' end y, {LINE_UNIT} u from lineitem),
    q as (select y, quantile_cont(u, 0.2) t from g group by y),
    p as (select x, avg((y = 'high')::int) h from g join q using (y) where u >= t group by x)
    select x, {rd('h', 2)} as high, {rd('greatest(h, 1 - h)', 2)} as confidence, case when h > 0.5 then 'high' else 'low' end as prediction, count(*) as n
    from g join p using (x) group by x, h""",
)
def _(spark, folder):
    x, high = F.col("l_quantity") > 25, F.col("l_extendedprice") > 30000
    df = table(spark, folder, "lineitem").select("l_orderkey", x.alias("x"), F.when(high, "high").otherwise("low").alias("y"))
    model = modeling.train_model(df, "y", "logistic_regression", key=["l_orderkey"], exclude=["l_orderkey"], params={"C": 1e6})
    out = modeling.score(model, df, ["x"])
    shown = [F.round(F.col("probabilities")["high"], 2).alias("high"), F.round("confidence", 2).alias("confidence")]
    return out.select("x", *shown, "prediction").groupBy("x", "high", "confidence", "prediction").agg(F.count("*").alias("n"))


@query("train_model_on_names")
def _(spark, folder):
    """Texts of any cardinality are features: here every customer has a name of its own."""
    df = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    model = modeling.train_model(df, "c_mktsegment", "logistic_regression", key=["c_custkey"], exclude=["c_custkey"])
    return modeling.score(model, df, ["c_custkey"])


@query("train_model")
def _(spark, folder):
    model = modeling.train_model(lines(spark, folder), "l_returnflag", "random_forest", key=LINE_KEY, exclude=OUT, max_rows=FIT_ROWS)
    return modeling.metrics_table(spark, [model])


@query("cross_validate")
def _(spark, folder):
    return modeling.cross_validate(lines(spark, folder), "l_linestatus", "logistic_regression", 5, LINE_KEY, exclude=OUT)


@query("tune_model")
def _(spark, folder):
    return modeling.tune(lines(spark, folder), "l_linestatus", "logistic_regression", 5, LINE_KEY, exclude=OUT)


@query("auto_train")
def _(spark, folder):
    found = modeling.auto_train(
        lines(spark, folder), "l_linestatus", 5, key=LINE_KEY, exclude=OUT, models=("random_forest", "gbt", "gbt_deep", "logistic_regression"),
        params={"gbt": FEW_ROUNDS, "gbt_deep": {"n_estimators": 3}},
    )
    return found.results


@query("compare_models")
def _(spark, folder):
    found = modeling.auto_train(
        lines(spark, folder), "l_linestatus", 0, key=LINE_KEY, exclude=OUT, models=("random_forest", "logistic_regression", "svm"),
    )
    return modeling.compare_models(found.models, found.test)


@query("feature_importance")
def _(spark, folder):
    return modeling.feature_importance(lines(spark, folder), "l_returnflag", "random_forest", exclude=OUT, max_rows=FIT_ROWS)


@query("embedding_classifier")
def _(spark, folder):
    vectors = table(spark, folder, "embeddings")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    df = vectors.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(width)])
    model = modeling.train_model(df, "label", "random_forest", key=["vec_id"], exclude=["vec_id"], max_rows=FIT_ROWS)
    return modeling.score(model, df, ["vec_id", "label"])


@query("score_with_transforms")
def _(spark, folder):
    raw = lines(spark, folder).drop(*OUT)
    fitted = [features.fit_log_transform(raw, "l_extendedprice")]
    fitted.append(features.fit_standard_scaler(fitted[0].apply(raw), ["l_quantity", "l_extendedprice"]))
    ready = features.apply_all(raw, fitted)
    model = modeling.train_model(ready, "l_linestatus", "logistic_regression", key=["l_extendedprice", "l_quantity"])
    model.history = fitted
    return modeling.score(model, raw.drop("l_linestatus", "l_tax"), ["l_quantity", "l_extendedprice"], fill_absent=True)


@query("model_table")
def _(spark, folder):
    root = fresh_path(spark, "models")
    df = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    kept = modeling.train_model(df, "o_orderstatus", "logistic_regression", key=["o_orderkey"], exclude=["o_orderkey"])
    other = modeling.train_model(df, "o_totalprice", "linear_regression", key=["o_orderkey"], exclude=["o_orderkey"])
    model_table.save_model(spark, root, kept)
    gone = model_table.save_model(spark, root, other)
    model_table.delete_model(spark, root, gone)
    return model_table.model_summary(model_table.list_models(spark, root))


# Several steps over one table

STEPS = [
    steps.Step("fill_missing_values", {"column": "o_totalprice", "strategy": "median"}, "cleaning"),
    steps.Step("fill_missing_values", {"column": "no_such_column", "strategy": "mean"}, "cleaning"),
    steps.Step("remove_outliers", {"column": "o_totalprice", "method": "zscore", "threshold": "1.5"}, "cleaning"),
    steps.Step("detect_missing_values", {}, "eda"),
    steps.Step("standard_scaler", {"columns_to_scale": "o_totalprice"}, "preprocessing"),
    steps.Step("label_encode", {"column": "o_orderpriority"}, "preprocessing"),
]


@query(
    "step_run_table",
    f"""with g as {ORDERS_GAPS}, a as (select o_orderkey, coalesce(o_orderpriority, 'nan') v,
      coalesce(o_totalprice, (select quantile_cont(o_totalprice, 0.5) from g)) p from g),
    z as (select avg(p) m, stddev_samp(p) s from a), b as (select a.* from a, z where abs((p - m) / s) <= 1.5),
    t as (select avg(p) m, stddev_pop(p) s from b), c as (select v, row_number() over (order by v) - 1 as code from (select distinct v from b))
    select o_orderkey, {rd('(p - m) / s', 6)} as o_totalprice, code as o_orderpriority from b join c using (v), t""",
)
def _(spark, folder):
    out = steps.run_steps(orders_gaps(spark, folder), STEPS).table
    return out.select("o_orderkey", F.round(F.round("o_totalprice", 12), 6).alias("o_totalprice"), "o_orderpriority")


# The log of the steps above: a step on a column that the table lacks fails, and times only have to be there.
STEP_LOG = """(select place, phase, tool, tool as label, ok as success, true as timed, not ok as failed
    from (select place, phase, tool, c in (select column_name from (describe orders)) ok from (values (0, 'cleaning', 'fill_missing_values', 'o_totalprice'),
    (1, 'cleaning', 'fill_missing_values', 'no_such_column'), (2, 'cleaning', 'remove_outliers', 'o_totalprice'), (3, 'eda', 'detect_missing_values', 'o_orderkey'),
    (4, 'preprocessing', 'standard_scaler', 'o_totalprice'), (5, 'preprocessing', 'label_encode', 'o_orderpriority')) v(place, phase, tool, c)))"""


@query("step_run_log", f"select * from {STEP_LOG}")
def _(spark, folder):
    log = steps.run_steps(orders_gaps(spark, folder), STEPS).log_table()
    return log.select("place", "phase", "tool", "label", "success", (F.col("milliseconds") >= 0).alias("timed"), F.col("error").isNotNull().alias("failed"))


@query(
    "run_summary",
    f"select phase, count(*) as steps, count(case when success then 1 end) as successes, count(case when failed then 1 end) as errors from {STEP_LOG} group by 1",
)
def _(spark, folder):
    return steps.run_summary(steps.run_steps(orders_gaps(spark, folder), STEPS).log_table()).drop("milliseconds")


@query("step_call_counts", f"select tool, count(*) as calls, count(case when failed then 1 end) as errors from {STEP_LOG} group by 1")
def _(spark, folder):
    return steps.call_counts(steps.run_steps(orders_gaps(spark, folder), STEPS).log_table())


@query("suggest_steps")
def _(spark, folder):
    found = automatic.suggest_steps(orders_gaps(spark, folder), done=["dataset_overview"])
    return spark.createDataFrame([(i, s.priority, s.tool_name, str(dict(s.args))) for i, s in enumerate(found)], "place int, priority int, tool string, args string")


@query("automatic_run")
def _(spark, folder):
    run = automatic.automatic_run(orders_gaps(spark, folder), "o_orderstatus", models=["logistic_regression", "random_forest"])
    return run.log_table()
