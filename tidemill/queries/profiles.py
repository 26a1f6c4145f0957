"""Sources, profiles, frequency tables and the quality report."""

from pyspark.sql import functions as F

from tidemill.operators import profile
from tidemill.queries.base import LINES_GAPS, ORDERS_GAPS, fresh_path, lines_gaps, orders_gaps, pct, query, rd, table
from tidemill.sources import tables

LINEITEM = {
    "l_orderkey": "numeric", "l_partkey": "numeric", "l_suppkey": "numeric", "l_linenumber": "numeric",
    "l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric", "l_tax": "numeric",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "datetime",
}
ORDERS = {
    "o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "string", "o_totalprice": "numeric",
    "o_orderdate": "datetime", "o_orderpriority": "string",
}
GAPS = {c: "numeric" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}


def class_sql(c: str, kind: str) -> str:
    if kind != "string":
        return f"'{kind}'"
    d = f"count(distinct {c})"
    return f"case when {d} < 50 or {d}::double / nullif(count(*), 0) < 0.05 then 'categorical' else 'text' end"


def profile_sql(source: str, columns: dict[str, str]) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns.items()):
        x = f"{c}::double"
        if kind == "numeric":
            numbers = {
                "mean": rd(f"avg({x})", 4), "median": rd(f"quantile_cont({x}, 0.5)", 4), "std": rd(f"stddev_samp({x})", 4),
                "min": f"min({x})", "max": f"max({x})", "q25": rd(f"quantile_cont({x}, 0.25)", 4),
                "q75": rd(f"quantile_cont({x}, 0.75)", 4), "skewness": rd(f"skewness({x})", 4), "kurtosis": rd(f"kurtosis({x})", 4),
            }
        else:
            numbers = {k: "null::double" for k in ("mean", "median", "std", "min", "max", "q25", "q75", "skewness", "kurtosis")}
        parts.append(
            f"select {i}::int as position, '{c}' as \"column\", {class_sql(c, kind)} as class, count(*) as total_rows,"
            f" count(*) - count({c}) as null_count, {pct(f'count(*) - count({c})', 'count(*)')} as null_percentage,"
            f" count(distinct {c}) as unique_count, " + ", ".join(f'{v} as "{k}"' for k, v in numbers.items()) + f" from {source}"
        )
    return " union all ".join(parts)


@query("column_profile_lineitem", profile_sql("lineitem", LINEITEM))
def _(spark, folder):
    return profile.column_profile(table(spark, folder, "lineitem"), samples=0).drop("dtype", "samples")


@query("column_profile_gaps", profile_sql(ORDERS_GAPS, ORDERS))
def _(spark, folder):
    return profile.column_profile(orders_gaps(spark, folder), samples=0).drop("dtype", "samples")


SAMPLED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query(
    "column_profile_samples",
    " union all ".join(f"select '{c}' as \"column\", array_to_string((list({c}::varchar order by o_orderkey) filter ({c} is not null))[1:4], '|') as samples, count({c}) as present from {ORDERS_GAPS}" for c in SAMPLED),
)
def _(spark, folder):
    found = profile.column_profile(orders_gaps(spark, folder).select(*SAMPLED), samples=4, sample_order=["o_orderkey"])
    return found.select("column", F.array_join("samples", "|").alias("samples"), (F.col("total_rows") - F.col("null_count")).alias("present"))


@query(
    "column_classes",
    " union all ".join(
        f"select {i}::int as position, '{c}' as \"column\", {class_sql(c, k)} as class from documents having count(*) >= 0"
        for i, (c, k) in enumerate({"doc_id": "numeric", "text": "string", "lang": "string", "source": "string", "n_chars": "numeric"}.items())
    ),
)
def _(spark, folder):
    return profile.column_classes(table(spark, folder, "documents")).drop("dtype")


@query(
    "numeric_summary",
    " union all ".join(
        f"select '{c}' as \"column\", {rd(f'avg({c})', 4)} as mean, {rd(f'stddev_samp({c})', 4)} as std,"
        f" min({c})::double as min, max({c})::double as max from {LINES_GAPS}"
        for c in GAPS
    ),
)
def _(spark, folder):
    return profile.numeric_summary(lines_gaps(spark, folder))


@query(
    "missing_values",
    "select * from ("
    + " union all ".join(
        f"select {i}::int as position, '{c}' as \"column\", count(*) - count({c}) as null_count,"
        f" {pct(f'count(*) - count({c})', 'count(*)')} as null_percentage, count(*) as total_rows from {ORDERS_GAPS}"
        for i, c in enumerate(ORDERS)
    )
    + ") where null_count > 0",
)
def _(spark, folder):
    return profile.missing_values(orders_gaps(spark, folder))


def overview_sql() -> str:
    missing = " + ".join(f"(count(*) - count({c}))" for c in ORDERS)
    touched = " + ".join(f"(case when count(*) > count({c}) then 1 else 0 end)" for c in ORDERS)
    parts = []
    for i, (c, kind) in enumerate(ORDERS.items()):
        x = f"{c}::double"
        num = kind == "numeric"
        top = f"(select struct_pack(v := {c}::varchar, n := count(*)) from g where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"
        parts.append(
            f"select {i}::int as position, '{c}' as \"column\", '{kind}' as class, count(*) as total_rows, 6::int as total_columns,"
            f" (count(*) - count({c}))::bigint as null_count, ({missing})::bigint as total_missing, ({touched})::int as columns_with_missing,"
            f" {rd(f'avg({x})', 2) if num else 'null::double'} as mean, {rd(f'stddev_samp({x})', 2) if num else 'null::double'} as std,"
            f" {rd(f'quantile_cont({x}, 0.5)', 2) if num else 'null::double'} as median,"
            f" {f'min({x})' if num else 'null::double'} as min, {f'max({x})' if num else 'null::double'} as max,"
            f" {f'count(distinct {c})' if kind == 'string' else 'null::bigint'} as unique_count,"
            f" {f'({top}).v' if kind == 'string' else 'null::varchar'} as most_frequent,"
            f" {f'({top}).n' if kind == 'string' else 'null::bigint'} as most_frequent_count,"
            f" {pct(missing, 'count(*) * 6')} as missing_percentage from g"
        )
    return f"with g as {ORDERS_GAPS} " + " union all ".join(parts)


@query("dataset_overview", overview_sql())
def _(spark, folder):
    return profile.dataset_overview(orders_gaps(spark, folder))


@query(
    "column_statistics_numeric",
    f"""select 'value' as "column", count(*) as total_count, count(*) - count(value) as null_count,
    {pct('count(*) - count(value)', 'count(*)')} as null_percentage, count(distinct value) as unique_count,
    {rd('avg(value)', 4)} as mean, {rd('quantile_cont(value, 0.5)', 4)} as median, {rd('stddev_samp(value)', 4)} as std,
    min(value) as min, max(value) as max, {rd('quantile_cont(value, 0.25)', 4)} as q25, {rd('quantile_cont(value, 0.75)', 4)} as q75,
    {rd('skewness(value)', 4)} as skewness, {rd('kurtosis(value)', 4)} as kurtosis from events""",
)
def _(spark, folder):
    return profile.column_statistics(table(spark, folder, "events"), "value")


@query(
    "column_statistics_categorical",
    f"""with g as {ORDERS_GAPS}, c as (select o_orderpriority v, count(*) n from g where o_orderpriority is not null group by 1)
    select 'o_orderpriority' as "column", count(*) as total_count, count(*) - count(o_orderpriority) as null_count,
    {pct('count(*) - count(o_orderpriority)', 'count(*)')} as null_percentage, count(distinct o_orderpriority) as unique_count,
    (select v from c order by n desc, v limit 1) as most_frequent, (select n from c order by n desc, v limit 1) as most_frequent_count,
    (select string_agg(v || '=' || n, ';' order by n desc, v) from (select * from c order by n desc, v limit 5)) as top_5_values
    from g""",
)
def _(spark, folder):
    out = profile.column_statistics(orders_gaps(spark, folder), "o_orderpriority")
    return out.withColumn("top_5_values", F.concat_ws(";", "top_5_values"))


@query(
    "value_counts",
    f"""with c as (select l_quantity v, count(*) n from lineitem group by 1), t as (select sum(n) r, count(*) d from c)
    select v::varchar as value, n as count, {pct('n', 'r')} as percentage, d as total_unique_values, r::bigint as total_rows,
    least(10, d)::bigint as showing_top from c, t order by n desc, v limit 10""",
)
def _(spark, folder):
    return profile.value_counts(table(spark, folder, "lineitem"), "l_quantity")


@query(
    "value_counts_normalized",
    f"""with g as {ORDERS_GAPS}, c as (select o_orderpriority v, count(*) n from g group by 1),
    t as (select sum(n) r, count(v) d, count(*) s from c)
    select coalesce(v, 'NULL') as value, {rd('n::double / r', 4)} as fraction, {pct('n', 'r')} as percentage,
    d as total_unique_values, r::bigint as total_rows, least(4, s)::bigint as showing_top from c, t order by n desc, v nulls last limit 4""",
)
def _(spark, folder):
    return profile.value_counts(orders_gaps(spark, folder), "o_orderpriority", 4, normalize=True)


DUP = "select l_returnflag, l_linestatus, l_quantity, l_discount, nullif(l_tax, 0.0) as l_tax from lineitem"


@query(
    "duplicate_count",
    f"""with c as (select count(*) n from ({DUP}) group by l_returnflag, l_linestatus, l_quantity, l_discount, l_tax)
    select sum(n - 1)::bigint as duplicate_rows, {pct('sum(n - 1)', 'sum(n)')} as duplicate_percentage, sum(n)::bigint as total_rows from c""",
)
def _(spark, folder):
    return profile.duplicate_count(lines_gaps(spark, folder).withColumn("l_discount", F.coalesce("l_discount", F.lit(0.0))).drop("l_extendedprice"))


@query(
    "duplicate_count_digest",
    f"""with c as (select count(*) n from documents group by text)
    select sum(n - 1)::bigint as duplicate_rows, {pct('sum(n - 1)', 'sum(n)')} as duplicate_percentage, sum(n)::bigint as total_rows from c""",
)
def _(spark, folder):
    return profile.duplicate_count(table(spark, folder, "documents").select("text"), digest=True)


def quality_sql() -> str:
    missing = " + ".join(f"count(*) - count({c})" for c in ORDERS)
    parts = [
        "select 'size' as \"check\", 'rows' as item, count(*)::double as value, null::boolean as flagged from g",
        "select 'size', 'columns', 6.0::double, null",
        f"select 'missing', 'total_missing', ({missing})::double, ({missing})::double / (count(*) * 6) > 0.1 from g",
        "select 'missing', 'columns_affected', count(*)::double, null from m where n > 0",
        "select 'duplicates', 'duplicate_rows', d::double, d::double / r > 0.05 from dup",
        f"select 'duplicates', 'duplicate_percentage', {pct('d', 'r')}, null from dup",
        f"select * from (select 'worst_missing', c, {pct('n', 'r')}, null::boolean from m where n > 0 order by n desc, i limit 5)",
        "select 'dtype', 'bigint', 2.0::double, null", "select 'dtype', 'string', 2.0::double, null",
        "select 'dtype', 'double', 1.0::double, null", "select 'dtype', 'timestamp_ntz', 1.0::double, null",
        "select 'constant_column', c, u::double, true from m where u <= 1",
        "select 'high_cardinality', c, u::double, true from m where s and u > 0.8 * r",
    ]
    per = " union all ".join(
        f"select {i} i, '{c}' c, {str(k == 'string').lower()} s, count(*) - count({c}) n, count(distinct {c}) u, count(*) r from g"
        for i, (c, k) in enumerate(ORDERS.items())
    )
    return (
        f"with g as {ORDERS_GAPS}, m as ({per}),"
        " dup as (select sum(n - 1) d, sum(n) r from (select count(*) n from g group by all_cols))".replace("all_cols", ", ".join(ORDERS))
        + " " + " union all ".join(parts)
    )


@query("data_quality_report", quality_sql())
def _(spark, folder):
    return profile.data_quality_report(orders_gaps(spark, folder))


@query(
    "problem_types",
    " union all ".join(
        f"select '{c}' as \"column\", count(distinct {c}) as unique_count, count({c}) as non_null,"
        f" case when {'true' if k == 'string' else 'false'} or count(distinct {c}) <= 10 or count(distinct {c})::double / count({c}) < 0.05"
        f" then 'classification' else 'regression' end as problem_type from lineitem"
        for c, k in LINEITEM.items() if k != "datetime"
    ),
)
def _(spark, folder):
    return profile.problem_types(table(spark, folder, "lineitem"), [c for c, k in LINEITEM.items() if k != "datetime"])


@query(
    "csv_round_trip",
    f"""select c_mktsegment, count(*) as n, count(distinct c_custkey) as keys, {rd('sum(c_acctbal)', 2)} as balance,
    max(c_nationkey)::bigint as top_nation from customer group by 1""",
)
def _(spark, folder):
    path = fresh_path(spark, "customer.csv")
    tables.write_csv(table(spark, folder, "customer"), path)
    back = tables.infer_types(spark.read.option("header", True).option("escape", '"').csv(path))
    return back.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.count_distinct("c_custkey").alias("keys"),
        F.round(F.round(F.sum("c_acctbal"), 8), 2).alias("balance"), F.max("c_nationkey").alias("top_nation"),
    )


@query("csv_line_breaks", "select doc_id, lang, source, nullif(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '') as text, n_chars from documents")
def _(spark, folder):
    """Texts with line breaks, quotes and commas, read back from several splits."""
    path = fresh_path(spark, "documents.csv")
    docs = table(spark, folder, "documents")
    tables.write_csv(docs.withColumn("text", F.trim("text", F.lit(" \t\n\x0b\f\r"))), path)
    return tables.read_csv(spark, f"{path}/*.csv", docs.schema).select("doc_id", "lang", "source", "text", "n_chars")


@query("csv_typed", "select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer")
def _(spark, folder):
    path = fresh_path(spark, "customer.csv")
    tables.write_csv(table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), path)
    return tables.read_csv(spark, f"{path}/*.csv")
