"""Chart numbers and correlations."""

from pyspark.sql import functions as F

from tidemill.operators import charts, correlation
from tidemill.queries.base import LINES_GAPS, lines_gaps, pct, query, rd, table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "histogram",
    f"""with s as (select avg(value) m, stddev_samp(value) d, min(value) lo, max(value) hi, count(value) n from events),
    b as (select range::int as bin from range(30)),
    c as (select least(floor((value - lo) / ((hi - lo) / 30)), 29)::int as bin, count(*) k from events, s where value is not null group by 1)
    select b.bin, {rd('lo + b.bin * ((hi - lo) / 30)', 6)} as bin_start, {rd('lo + (b.bin + 1) * ((hi - lo) / 30)', 6)} as bin_end,
    coalesce(k, 0)::bigint as count, {rd('m', 4)} as mean, {rd('d', 4)} as std, lo as min, hi as max, n as total
    from b left join c on b.bin = c.bin cross join s""",
)
def _(spark, folder):
    return charts.histogram(table(spark, folder, "events"), "value")


@query(
    "bar_chart",
    """with c as (select p_type v, count(*) n from part where p_type is not null group by 1)
    select v as value, n as count, (select count(*) from c) as total_categories from c order by n desc, v limit 10""",
)
def _(spark, folder):
    return charts.bar_chart(table(spark, folder, "part"), "p_type")


@query(
    "scatter_grid",
    f"""with s as (select min(l_quantity) x0, max(l_quantity) x1, min(l_extendedprice) y0, max(l_extendedprice) y1,
      corr(l_quantity, l_extendedprice) r from lineitem)
    select least(floor((l_quantity - x0) / ((x1 - x0) / 20)), 19)::int as x_bin,
      least(floor((l_extendedprice - y0) / ((y1 - y0) / 20)), 19)::int as y_bin, l_returnflag as "group", count(*) as count,
      {rd('any_value(r)', 4)} as correlation
    from lineitem, s where l_quantity is not null and l_extendedprice is not null group by 1, 2, 3""",
)
def _(spark, folder):
    return charts.scatter_grid(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag", bins=20)


@query(
    "scatter_sample",
    """with n as (select least(1.0, 500::double / count(*)) f from events)
    select event_id, value, user_id from events, n
    where ('0x' || substr(md5('42|' || event_id), 1, 8))::bigint / 4294967296.0 < f""",
)
def _(spark, folder):
    return charts.scatter_sample(table(spark, folder, "events"), "value", "user_id", ["event_id"], 500)


def pair_sql(rows: list[str]) -> str:
    return " union all ".join(rows)


def guarded(a: str, b: str) -> str:
    x, y = f"case when {b} is not null then {a} end", f"case when {a} is not null then {b} end"
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def analysis_sql(method: str, pairs: str, least: float) -> str:
    """Shape of the report around a (a, b, r) relation."""
    return f"""with p as ({pairs}), k as (select * from p where r is not null and abs(r) >= {least})
    select '{method}' as method, a as column1, b as column2, {rd('r', 4)} as correlation,
    case when abs(r) >= 0.7 then 'strong' when abs(r) >= 0.3 then 'moderate' else 'weak' end as strength,
    case when r > 0 then 'positive' else 'negative' end as direction, (select count(*) from k) as total_correlations
    from k order by abs({rd('r', 4)}) desc, a, b limit 20"""


PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


@query(
    "correlation_pearson",
    analysis_sql("pearson", " union all ".join(f"select '{a}' a, '{b}' b, {guarded(a, b)} r from {LINES_GAPS}" for a, b in PAIRS), 0.0),
)
def _(spark, folder):
    return correlation.correlation_analysis(lines_gaps(spark, folder), "pearson", 0.0, NUMBERS)


WIDE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *NUMBERS]
WIDE_SQL = {c: c for c in WIDE} | {f"{c}_sq": f"({c}::double * {c})" for c in NUMBERS} | {"qd": "(l_quantity * l_discount)", "qt": "(l_quantity * l_tax)"}
WIDE_PAIRS = [(a, b) for i, a in enumerate(WIDE_SQL) for b in list(WIDE_SQL)[i + 1 :]]


@query(
    "correlation_wide",
    analysis_sql("pearson", " union all ".join(f"select '{a}' a, '{b}' b, corr({WIDE_SQL[a]}, {WIDE_SQL[b]}) r from lineitem" for a, b in WIDE_PAIRS), 0.1),
)
def _(spark, folder):
    li = table(spark, folder, "lineitem")
    wide = li.select(*WIDE, *[(F.col(c) * F.col(c)).alias(f"{c}_sq") for c in NUMBERS],
                     (F.col("l_quantity") * F.col("l_discount")).alias("qd"), (F.col("l_quantity") * F.col("l_tax")).alias("qt"))
    return correlation.correlation_analysis(wide, "pearson", 0.1)


def ranked(a: str, b: str, source: str) -> str:
    rank = "(rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0)"
    return (
        f"select '{a}' a, '{b}' b, corr(x, y) r from (select {rank.format(a)} x, {rank.format(b)} y from {source}"
        f" where {a} is not null and {b} is not null)"
    )


@query("correlation_spearman", analysis_sql("spearman", " union all ".join(ranked(a, b, "lineitem") for a, b in PAIRS), 0.0))
def _(spark, folder):
    return correlation.correlation_analysis(table(spark, folder, "lineitem"), "spearman", 0.0, NUMBERS)


GAP_PAIRS = [("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]


@query("correlation_spearman_gaps", analysis_sql("spearman", " union all ".join(ranked(a, b, LINES_GAPS) for a, b in GAP_PAIRS), 0.0))
def _(spark, folder):
    return correlation.correlation_analysis(lines_gaps(spark, folder), "spearman", 0.0, ["l_extendedprice", "l_discount", "l_tax"])


def tau(a: str, b: str, source: str) -> str:
    """Tau-b from merged (x, y) counts."""
    return f"""select '{a}' a, '{b}' b, (select sum(p.n * q.n * sign(p.x - q.x) * sign(p.y - q.y)) / 2.0 from m p, m q)
      / sqrt((n0 - (select sum(n * (n - 1) / 2.0) from (select sum(n) n from m group by x)))
           * (n0 - (select sum(n * (n - 1) / 2.0) from (select sum(n) n from m group by y)))) r
      from (select sum(n) * (sum(n) - 1) / 2.0 n0 from m)"""


def tau_sql(pairs, source: str) -> str:
    parts = []
    for i, (a, b) in enumerate(pairs):
        m = f"(select {a}::double x, {b}::double y, count(*)::double n from {source} where {a} is not null and {b} is not null group by 1, 2)"
        parts.append(f"select * from (with m as {m} {tau(a, b, source)})")
    return " union all ".join(parts)


FEW = ["l_linenumber", "l_discount", "l_tax"]
FEW_PAIRS = [(a, b) for i, a in enumerate(FEW) for b in FEW[i + 1 :]]


@query("correlation_kendall", analysis_sql("kendall", tau_sql(FEW_PAIRS, "lineitem"), 0.0))
def _(spark, folder):
    return correlation.correlation_analysis(table(spark, folder, "lineitem"), "kendall", 0.0, FEW)


@query(
    "correlation_heatmap",
    " union all ".join(
        f"select {i}::int as i, {j}::int as j, '{a}' as row_column, '{b}' as \"column\", {rd('1.0' if i == j else guarded(b, a), 4)} as correlation"
        + ("" if i == j else f" from {LINES_GAPS}")
        for i, a in enumerate(NUMBERS) for j, b in enumerate(NUMBERS) if j <= i
    ),
)
def _(spark, folder):
    return charts.correlation_heatmap(lines_gaps(spark, folder), "pearson", NUMBERS)


BOX = f"""with q as (select event_type g, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.5) q2, quantile_cont(value, 0.75) q3 from events group by 1),
    l as (select *, q3 - q1 iqr, q1 - 1.5 * (q3 - q1) lo, q3 + 1.5 * (q3 - q1) hi from q)
    select g as "group", count(value) as count, {rd('any_value(q1)', 4)} as q1, {rd('any_value(q2)', 4)} as median, {rd('any_value(q3)', 4)} as q3,
    {rd('any_value(iqr)', 4)} as iqr, {rd('any_value(lo)', 4)} as lower_bound, {rd('any_value(hi)', 4)} as upper_bound,
    min(case when value between lo and hi then value end) as whisker_low, max(case when value between lo and hi then value end) as whisker_high,
    count(case when value < lo or value > hi then 1 end) as outlier_count,
    {pct('count(case when value < lo or value > hi then 1 end)', '(select count(*) from events)')} as outlier_percentage
    from events join l on event_type = g group by g"""


@query("box_plot_by_group", BOX)
def _(spark, folder):
    return charts.box_plot(table(spark, folder, "events"), "value", "event_type")


@query("box_plot", BOX.replace("event_type g,", "'value' g,").replace("group by 1)", ")").replace("join l on event_type = g", "cross join l"))
def _(spark, folder):
    return charts.box_plot(table(spark, folder, "events").select("value"))


def group_box_sql(table_name: str, column: str, group: str) -> str:
    """The box of every group; the share of outliers is that of the group's values."""
    out = BOX.replace("event_type", f"{group}::varchar").replace("events", table_name).replace("any_value", "any_").replace("value", column).replace("any_", "any_value")
    # A quarter of a large number is not exact: seven places are rounded off first.
    out = out.replace(f"(select count(*) from {table_name})", f"count({column})").replace("decimal(38,10)", "decimal(38,7)")
    return out.replace(f"from {table_name} group by 1", f"from {table_name} where {group} is not null group by 1")


@query("box_plot_every_customer", group_box_sql("orders", "o_totalprice", "o_custkey"))
def _(spark, folder):
    return charts.group_box_plots(table(spark, folder, "orders"), "o_totalprice", "o_custkey")


@query("box_plot_every_flag", group_box_sql("lineitem", "l_extendedprice", "l_returnflag"))
def _(spark, folder):
    return charts.group_box_plots(table(spark, folder, "lineitem"), "l_extendedprice", "l_returnflag")


def sorted_tau(a: str, b: str) -> str:
    """Tau-b by sorting: two points first differ at one bit of the rank of y, and are counted there, zeros before ones."""
    return f"""select '{a}' as a, '{b}' as b, (select sum(case when o then zb else -ob end) from (
        select (y >> bit) & 1 = 1 as o, sum(case when (y >> bit) & 1 = 0 then 1 else 0 end) over (partition by bit, y >> (bit + 1) order by x) - sum(case when (y >> bit) & 1 = 0 then 1 else 0 end) over (partition by bit, y >> (bit + 1), x) as zb,
          sum((y >> bit) & 1) over (partition by bit, y >> (bit + 1) order by x) - sum((y >> bit) & 1) over (partition by bit, y >> (bit + 1), x) as ob
        from (select {a} as x, (dense_rank() over (order by {b}) - 1)::bigint as y from lineitem), (select unnest(range(0, 24))::bigint as bit)))
      / sqrt(((select count(*)::double * (count(*) - 1) / 2 from lineitem) - (select sum(n * (n - 1) / 2.0) from (select count(*)::double n from lineitem group by {a})))
           * ((select count(*)::double * (count(*) - 1) / 2 from lineitem) - (select sum(n * (n - 1) / 2.0) from (select count(*)::double n from lineitem group by {b})))) as r"""


NUMBER_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


@query("correlation_kendall_prices", analysis_sql("kendall", " union all ".join(sorted_tau(a, b) for a, b in NUMBER_PAIRS), 0.0))
def _(spark, folder):
    return correlation.correlation_analysis(table(spark, folder, "lineitem"), "kendall", 0.0, NUMBERS)
