"""Fills, duplicates, outliers and dropped columns."""

from pyspark.sql import functions as F

from tidemill.operators import cleaning
from tidemill.queries.base import ORDERS_GAPS, orders_gaps, pct, query, rd, table

KEYED = ["o_orderkey", "o_totalprice"]


def filled_sql(value: str) -> str:
    return f"with g as {ORDERS_GAPS} select o_orderkey, {rd(f'coalesce(o_totalprice, {value})', 4)} as o_totalprice from g"


def _filled(spark, folder, strategy, **how):
    out = cleaning.fill_missing(orders_gaps(spark, folder), "o_totalprice", strategy, **how)
    return out.select("o_orderkey", F.round(F.round("o_totalprice", 10), 4).alias("o_totalprice"))


@query("fill_mean", filled_sql("(select avg(o_totalprice) from g)"))
def _(spark, folder):
    return _filled(spark, folder, "mean")


@query("fill_median", filled_sql("(select quantile_cont(o_totalprice, 0.5) from g)"))
def _(spark, folder):
    return _filled(spark, folder, "median")


@query(
    "fill_mode",
    f"""with g as {ORDERS_GAPS} select o_orderkey, coalesce(o_orderpriority,
    (select o_orderpriority from g where o_orderpriority is not null group by 1 order by count(*) desc, 1 limit 1)) as o_orderpriority from g""",
)
def _(spark, folder):
    return cleaning.fill_missing(orders_gaps(spark, folder), "o_orderpriority", "mode").select("o_orderkey", "o_orderpriority")


@query(
    "forward_fill",
    f"""select o_orderkey, last_value(o_totalprice ignore nulls) over (order by o_orderkey) as o_totalprice from {ORDERS_GAPS}""",
)
def _(spark, folder):
    return cleaning.fill_missing(orders_gaps(spark, folder), "o_totalprice", "forward_fill", ["o_orderkey"]).select(*KEYED)


@query(
    "forward_fill_by_group",
    f"""select o_orderkey, last_value(o_totalprice ignore nulls) over (partition by o_orderstatus order by o_orderdate, o_orderkey) as o_totalprice
    from {ORDERS_GAPS}""",
)
def _(spark, folder):
    out = cleaning.fill_missing(
        orders_gaps(spark, folder), "o_totalprice", "forward_fill", ["o_orderdate", "o_orderkey"], ["o_orderstatus"]
    )
    return out.select(*KEYED)


@query("drop_missing", f"select o_orderkey, o_totalprice from {ORDERS_GAPS} where o_totalprice is not null")
def _(spark, folder):
    return cleaning.fill_missing(orders_gaps(spark, folder), "o_totalprice", "drop").select(*KEYED)


@query(
    "fill_report",
    f"""select 'o_totalprice' as "column", 'median' as strategy, count(*) - count(o_totalprice) as nulls_before, 0::bigint as nulls_after,
    count(*) as rows_after from {ORDERS_GAPS}""",
)
def _(spark, folder):
    before = orders_gaps(spark, folder)
    return cleaning.fill_report(before, cleaning.fill_missing(before, "o_totalprice", "median"), "o_totalprice", "median")


@query("drop_columns", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def _(spark, folder):
    return cleaning.drop_columns(table(spark, folder, "orders"), ["o_orderdate", "o_orderpriority"])


@query("remove_duplicates", "select distinct l_returnflag, l_linestatus, l_quantity, nullif(l_tax, 0.0) as l_tax from lineitem")
def _(spark, folder):
    li = table(spark, folder, "lineitem")
    return cleaning.remove_duplicates(li.select("l_returnflag", "l_linestatus", "l_quantity", F.nullif("l_tax", F.lit(0.0)).alias("l_tax")))


def kept_sql(direction: str) -> str:
    return f"""select doc_id, lang, source, n_chars from (select *, row_number() over (partition by text order by doc_id {direction}) k
    from documents) where k = 1"""


@query("remove_duplicates_first", kept_sql("asc"))
def _(spark, folder):
    docs = table(spark, folder, "documents")
    return cleaning.remove_duplicates(docs, ["text"], "first", ["doc_id"]).drop("text")


@query("remove_duplicates_last", kept_sql("desc"))
def _(spark, folder):
    docs = table(spark, folder, "documents")
    return cleaning.remove_duplicates(docs, ["text"], "last", ["doc_id"]).drop("text")


@query(
    "duplicate_report",
    "select count(*) as original_rows, count(*) - count(distinct text) as duplicates_removed, count(distinct text) as rows_remaining from documents",
)
def _(spark, folder):
    return cleaning.duplicate_report(table(spark, folder, "documents"), ["text"])


QUARTILES = "(select quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 from events)"
LIMITS = f"(select q1 - 1.5 * (q3 - q1) lo, q3 + 1.5 * (q3 - q1) hi from {QUARTILES})"
MOMENTS = "(select avg(value) m, stddev_samp(value) s from events)"


@query(
    "detect_outliers_iqr",
    f"""select 'value' as "column", 'iqr' as method, 1.5::double as threshold, count(case when value < lo or value > hi then 1 end) as outlier_count,
    {pct('count(case when value < lo or value > hi then 1 end)', 'count(*)')} as outlier_percentage, count(*) as total_rows,
    {rd('any_value(lo)', 6)} as lower_bound, {rd('any_value(hi)', 6)} as upper_bound from events, {LIMITS}""",
)
def _(spark, folder):
    return cleaning.detect_outliers(table(spark, folder, "events"), "value")


@query(
    "detect_outliers_zscore",
    f"""select 'value' as "column", 'zscore' as method, 3.0::double as threshold, count(case when abs((value - m) / s) > 3 then 1 end) as outlier_count,
    {pct('count(case when abs((value - m) / s) > 3 then 1 end)', 'count(*)')} as outlier_percentage, count(*) as total_rows,
    null::double as lower_bound, null::double as upper_bound from events, {MOMENTS}""",
)
def _(spark, folder):
    return cleaning.detect_outliers(table(spark, folder, "events"), "value", "zscore", 3.0)


@query("remove_outliers_iqr", f"select event_id, value from events, {LIMITS} where value >= lo and value <= hi")
def _(spark, folder):
    return cleaning.remove_outliers(table(spark, folder, "events"), "value").select("event_id", "value")


@query("remove_outliers_zscore", f"select event_id, value from events, {MOMENTS} where abs((value - m) / s) <= 1.5")
def _(spark, folder):
    return cleaning.remove_outliers(table(spark, folder, "events"), "value", "zscore").select("event_id", "value")


@query(
    "removal_report",
    f"""select 'value' as "column", count(*) - count(case when value between lo and hi then 1 end) as rows_removed,
    count(case when value between lo and hi then 1 end) as rows_remaining,
    {pct('count(*) - count(case when value between lo and hi then 1 end)', 'count(*)')} as removal_percentage from events, {LIMITS}""",
)
def _(spark, folder):
    events = table(spark, folder, "events")
    return cleaning.removal_report(events, cleaning.fit_outliers(events, "value"))
