"""Fitted transforms."""

from pyspark.sql import functions as F

from tidemill.operators import features
from tidemill.queries.base import LINES_GAPS, ORDERS_GAPS, fresh_path, lines_gaps, orders_gaps, query, rd, table

COLS = ["c_acctbal", "c_nationkey"]


def scaled_sql(source: str, key: str, stats: str, exprs: dict[str, str]) -> str:
    return f"with s as (select {stats} from {source}) select {key}, " + ", ".join(f"{rd(e, 6)} as {c}" for c, e in exprs.items()) + f" from {source}, s"


def rounded(df, key, cols, places=6):
    return df.select(*key, *[F.round(F.round(c, places + 6), places).alias(c) for c in cols])


@query(
    "standard_scaler",
    scaled_sql("customer", "c_custkey", "avg(c_acctbal) m0, stddev_pop(c_acctbal) s0, avg(c_nationkey) m1, stddev_pop(c_nationkey) s1",
               {"c_acctbal": "(c_acctbal - m0) / s0", "c_nationkey": "(c_nationkey - m1) / s1"}),
)
def _(spark, folder):
    df = table(spark, folder, "customer")
    return rounded(features.fit_standard_scaler(df, COLS).apply(df), ["c_custkey"], COLS)


@query(
    "scaling_report",
    " union all ".join(
        f"""select '{c}' as "column", {rd('any_value(m)', 4)} as mean_before, {rd('any_value(d)', 4)} as std_before,
        {rd(f'avg(({c} - m) / p)', 4)} as mean_after, {rd(f'stddev_samp(({c} - m) / p)', 4)} as std_after
        from customer, (select avg({c}) m, stddev_samp({c}) d, stddev_pop({c}) p from customer)"""
        for c in COLS
    ),
)
def _(spark, folder):
    df = table(spark, folder, "customer")
    return features.scaling_report(df, features.fit_standard_scaler(df, COLS))


@query(
    "min_max_scaler",
    scaled_sql("customer", "c_custkey", "min(c_acctbal) a0, max(c_acctbal) b0, min(c_nationkey) a1, max(c_nationkey) b1",
               {"c_acctbal": "(c_acctbal - a0) / (b0 - a0) * 2 - 1", "c_nationkey": "(c_nationkey - a1)::double / (b1 - a1) * 2 - 1"}),
)
def _(spark, folder):
    df = table(spark, folder, "customer")
    return rounded(features.fit_min_max_scaler(df, COLS, -1, 1).apply(df), ["c_custkey"], COLS)


@query(
    "robust_scaler",
    scaled_sql("events", "event_id", "quantile_cont(value, 0.25) q1, quantile_cont(value, 0.5) q2, quantile_cont(value, 0.75) q3",
               {"value": "(value - q2) / (q3 - q1)"}),
)
def _(spark, folder):
    df = table(spark, folder, "events")
    return rounded(features.fit_robust_scaler(df, ["value"]).apply(df), ["event_id"], ["value"])


@query("log_transform", f"select event_id, {rd('ln(1 + value)', 6)} as value from events")
def _(spark, folder):
    df = table(spark, folder, "events")
    return rounded(features.fit_log_transform(df, "value").apply(df), ["event_id"], ["value"])


@query(
    "log_report",
    f"""select 'value' as "column", {rd('skewness(value)', 4)} as skewness_before, {rd('skewness(ln(1 + value))', 4)} as skewness_after,
    {rd('abs(' + rd('skewness(value)', 4) + ') - abs(' + rd('skewness(ln(1 + value))', 4) + ')', 4)} as improvement from events""",
)
def _(spark, folder):
    return features.log_report(table(spark, folder, "events"), "value")


STATUS, PRIORITIES = ["O", "P"], ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "one_hot_encode",
    "select o_orderkey, "
    + ", ".join(f"case when o_orderstatus = '{v}' then 1.0::double else 0.0 end as \"o_orderstatus_{v}\"" for v in STATUS)
    + ", "
    + ", ".join(f"case when o_orderpriority = '{v}' then 1.0::double else 0.0 end as \"o_orderpriority_{v}\"" for v in PRIORITIES)
    + f" from {ORDERS_GAPS}",
)
def _(spark, folder):
    df = orders_gaps(spark, folder).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return features.fit_one_hot(df).apply(df)


@query(
    "label_encode",
    f"""with g as (select o_orderkey, coalesce(o_orderpriority, 'nan') v from {ORDERS_GAPS}),
    c as (select v, row_number() over (order by v) - 1 as code from (select distinct v from g))
    select o_orderkey, code as o_orderpriority from g join c using (v)""",
)
def _(spark, folder):
    df = orders_gaps(spark, folder).select("o_orderkey", "o_orderpriority")
    return features.fit_label_encoder(df, "o_orderpriority").apply(df)


@query("label_table", "select text as label, count(*) as n, row_number() over (order by text) - 1 as code from documents group by text")
def _(spark, folder):
    return features.label_table(table(spark, folder, "documents"), "text")


@query(
    "label_encode_many",
    """with c as (select v, row_number() over (order by v) - 1 as code from (select distinct l_extendedprice::varchar v from lineitem))
    select l_orderkey, l_extendedprice::varchar as price, code from lineitem join c on v = l_extendedprice::varchar""",
)
def _(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("string").alias("price"))
    coded = df.withColumn("code", F.col("price"))
    return features.fit_label_encoder(coded, "code", fresh_path(spark, "labels")).apply(coded)


@query(
    "polynomial_features",
    f"""with m as (select quantile_cont(l_discount, 0.5) d, quantile_cont(l_tax, 0.5) t from {LINES_GAPS}),
    g as (select l_returnflag, coalesce(l_discount, d) a, coalesce(l_tax, t) b from {LINES_GAPS}, m)
    select l_returnflag, {rd('a', 6)} as l_discount, {rd('b', 6)} as l_tax, {rd('a * a', 6)} as l_discountpow2,
    {rd('a * b', 6)} as l_discount_l_tax, {rd('b * b', 6)} as l_taxpow2 from g""",
)
def _(spark, folder):
    df = lines_gaps(spark, folder).select("l_returnflag", "l_discount", "l_tax")
    out = features.fit_polynomial(df).apply(df)
    return rounded(out, ["l_returnflag"], out.columns[1:])


PCA = """with g as (select c_custkey, c_acctbal a, c_nationkey::double * 100 b from customer),
  s as (select var_samp(a) va, var_samp(b) vb, covar_samp(a, b) c, avg(a) ma, avg(b) mb from g),
  e as (select *, (va + vb) / 2 + sqrt((va - vb) * (va - vb) / 4 + c * c) l1, va + vb t from s),
  v as (select *, c / sqrt(c * c + (l1 - va) * (l1 - va)) x0, (l1 - va) / sqrt(c * c + (l1 - va) * (l1 - va)) y0 from e),
  w as (select *, case when abs(x0) >= abs(y0) then sign(x0) else sign(y0) end f, case when abs(x0) > abs(y0) then -1 else 1 end h from v),
  u as (select *, x0 * f x1, y0 * f y1, -y0 * sign(-y0 * (case when abs(y0) >= abs(x0) then 1 else 0 end) + x0 * (case when abs(y0) >= abs(x0) then 0 else 1 end)) x2,
    x0 * sign(-y0 * (case when abs(y0) >= abs(x0) then 1 else 0 end) + x0 * (case when abs(y0) >= abs(x0) then 0 else 1 end)) y2 from w)"""


def pca_input(spark, folder):
    c = table(spark, folder, "customer")
    return c.select("c_custkey", "c_acctbal", (F.col("c_nationkey").cast("double") * 100).alias("scaled_nation"))


@query(
    "pca_report",
    f"""{PCA} select 'pca_1' as component, {rd('l1 / t * 100', 2)} as variance_explained, {rd('l1 / t * 100', 2)} as cumulative from e
    union all select 'pca_2', {rd('(t - l1) / t * 100', 2)}, 100.0::double from e""",
)
def _(spark, folder):
    df = pca_input(spark, folder)
    return features.pca_report(df, features.fit_pca(df, 2, "c_custkey"))


@query(
    "pca_transform",
    f"""{PCA} select c_custkey, {rd('(a - ma) * x1 + (b - mb) * y1', 3)} as pca_1, {rd('(a - ma) * x2 + (b - mb) * y2', 3)} as pca_2 from g, u""",
)
def _(spark, folder):
    df = pca_input(spark, folder)
    return rounded(features.fit_pca(df, 2, "c_custkey").apply(df), ["c_custkey"], ["pca_1", "pca_2"], 3)


@query(
    "prepare_features",
    f"""with g as (select * from {LINES_GAPS} where l_tax is not null),
    m as (select quantile_cont(l_discount, 0.5) d from g),
    f as (select l_returnflag v, row_number() over (order by l_returnflag) - 1 as k from (select distinct l_returnflag from g)),
    s as (select l_linestatus w, row_number() over (order by l_linestatus) - 1 as j from (select distinct l_linestatus from g))
    select l_quantity, l_extendedprice, {rd('coalesce(l_discount, d)', 4)} as l_discount, l_tax, k as l_returnflag, j as l_linestatus
    from g join f on l_returnflag = v join s on l_linestatus = w, m""",
)
def _(spark, folder):
    out = features.prepare_features(lines_gaps(spark, folder), "l_tax")
    return out.withColumn("l_discount", F.round(F.round("l_discount", 10), 4))


@query(
    "replay_transforms",
    f"""with g as (select o_orderkey, o_orderstatus, coalesce(o_totalprice, (select quantile_cont(o_totalprice, 0.5) from {ORDERS_GAPS})) p from {ORDERS_GAPS}),
    l as (select *, ln(1 + p) q from g), s as (select avg(q) m, stddev_pop(q) d from l)
    select o_orderkey, {rd('(q - m) / d', 6)} as o_totalprice, case when o_orderstatus = 'O' then 1.0::double else 0.0 end as "o_orderstatus_O",
    case when o_orderstatus = 'P' then 1.0::double else 0.0 end as "o_orderstatus_P" from l, s""",
)
def _(spark, folder):
    raw = orders_gaps(spark, folder).select("o_orderkey", "o_orderstatus", "o_totalprice")
    steps, df = [], raw
    for fit in (
        lambda d: features.fit_fill_value(d, "o_totalprice", "median"),
        lambda d: features.fit_log_transform(d, "o_totalprice"),
        lambda d: features.fit_standard_scaler(d, ["o_totalprice"]),
        lambda d: features.fit_one_hot(d, ["o_orderstatus"]),
    ):
        steps.append(fit(df))
        df = steps[-1].apply(df)
    stored = [features.Fitted.from_json(s.to_json()) for s in steps]
    return rounded(features.apply_all(raw, stored), ["o_orderkey", "o_orderstatus_O", "o_orderstatus_P"], ["o_totalprice"])
