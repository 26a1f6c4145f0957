"""Log search, counts and rollups."""

from datetime import datetime

from pyspark.sql import functions as F

from tidemill.operators import logs, redact
from tidemill.queries.base import NOW, NOW_SQL, pct, query, rd, table, text_time, text_time_sql

DAY = f"ts >= {NOW_SQL} - interval 24 hour"
LOG_COLS = ["event_id", "user_id", "event_type", "value"]
LOG_SQL = ", ".join(LOG_COLS) + ", " + text_time_sql("ts")


def is_error():
    return F.col("event_type") == "error"


FILTERED = """events where event_type = 'click' and ts >= timestamp '2024-01-05 00:00:00' and ts <= timestamp '2024-01-25 00:00:00'
    and (contains(lower(props), '"k": 1') or contains(lower(event_type), '"k": 1'))"""


def filtered(spark, folder):
    return logs.filter_log(
        table(spark, folder, "events"), {"event_type": "click"}, None, datetime(2024, 1, 5), datetime(2024, 1, 25), '"K": 1', ["props", "event_type"]
    )


@query("filter_log", f"select {LOG_SQL} from {FILTERED}")
def _(spark, folder):
    return filtered(spark, folder).select(*LOG_COLS, text_time("ts"))


@query(
    "filter_log_contains",
    "select event_type, count(*) as n from events where contains(lower(event_type), 'ic') or contains(lower(event_type), 'zz') group by 1",
)
def _(spark, folder):
    rows = logs.filter_log(table(spark, folder, "events"), containing={"event_type": "IC"})
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "log_page",
    f"""select {LOG_SQL}, (select count(*) from {FILTERED}) as total, ceil((select count(*) from {FILTERED}) / 20.0)::bigint as pages
    from (select * from {FILTERED} order by ts desc, event_id desc limit 20 offset 20)""",
)
def _(spark, folder):
    return logs.page_of(filtered(spark, folder), page=2, limit=20).select(*LOG_COLS, text_time("ts"), "total", "pages")


@query(
    "log_page_after",
    f"""select {LOG_SQL} from (select * from events where ts < timestamp '2024-01-15 00:00:00' order by ts desc, event_id desc limit 50)""",
)
def _(spark, folder):
    return logs.page_after(table(spark, folder, "events"), datetime(2024, 1, 15), -1).select(*LOG_COLS, text_time("ts"))


@query("recent_activity", f"select {LOG_SQL} from (select * from events order by ts desc, event_id desc limit 30)")
def _(spark, folder):
    return logs.recent(table(spark, folder, "events")).select(*LOG_COLS, text_time("ts"))


@query("count_recent", f"select count(*) as count from events where {DAY}")
def _(spark, folder):
    return logs.count_recent(table(spark, folder, "events"), NOW)


@query("count_errors", f"select count(*) as count from events where {DAY} and event_type = 'error'")
def _(spark, folder):
    return logs.count_recent(table(spark, folder, "events"), NOW, where=is_error())


@query(
    "top_endpoints",
    f"select event_type, count(*) as count from events where ts >= {NOW_SQL} - interval 168 hour group by 1 order by 2 desc, 1 limit 10",
)
def _(spark, folder):
    return logs.top_keys(table(spark, folder, "events"), ["event_type"], now=NOW, hours=168)


@query("top_users", f"select user_id, event_type, count(*) as count from events where {DAY} group by 1, 2 order by 3 desc, 1, 2 limit 10")
def _(spark, folder):
    return logs.top_keys(table(spark, folder, "events"), ["user_id", "event_type"], now=NOW)


HOURLY = "select strftime(date_trunc('hour', ts), '%Y-%m-%dT%H') as hour, count(*) as total, count(case when event_type = 'error' then 1 end) as errors from events"


@query("hourly_stats", f"{HOURLY} group by 1")
def _(spark, folder):
    return logs.hourly(table(spark, folder, "events"), is_error())


@query("hourly_stats_recent", f"{HOURLY} where {DAY} group by 1")
def _(spark, folder):
    return logs.hourly(table(spark, folder, "events"), is_error(), NOW)


USERS = f"""with u as (select user_id, min(ts) f, max(ts) l from events group by 1)
    select count(*) as total_users, count(case when l >= {NOW_SQL} - interval 24 hour then 1 end) as active_users,
    count(case when f >= {NOW_SQL} - interval 168 hour then 1 end) as new_users from u"""


@query("active_new_users", USERS)
def _(spark, folder):
    return logs.active_and_new_users(table(spark, folder, "events"), NOW)


# Orders stand in for jobs: their status letters map to three of the five job statuses.
JOBS = """(select o_orderkey, o_custkey, o_orderdate, o_orderpriority,
    case o_orderstatus when 'O' then 'pending' when 'P' then 'running' else 'completed' end as status from orders)"""


def jobs(spark, folder):
    s = F.col("o_orderstatus")
    status = F.when(s == "O", "pending").when(s == "P", "running").otherwise("completed")
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", status.alias("status"))


@query(
    "kpi_row",
    f"""select u.*, d.*, case when requests_24h > 0 then {pct('errors_24h', 'requests_24h')} else 0 end as error_rate,
    (select count(*) from conversations) as total_chats, (select count(*) from orders) as total_orders, j.*
    from ({USERS}) u, (select count(*) as requests_24h, count(case when event_type = 'error' then 1 end) as errors_24h from events where {DAY}) d,
    (select {', '.join(f"count(case when status = '{s}' then 1 end) as jobs_{s}" for s in logs.JOB_STATUSES)} from {JOBS}) j""",
)
def _(spark, folder):
    return logs.kpis(
        table(spark, folder, "events"), NOW, is_error(),
        {"chats": table(spark, folder, "conversations"), "orders": table(spark, folder, "orders")}, jobs(spark, folder),
    )


@query(
    "users_with_counts",
    """select c_custkey, c_name, (select count(*) from orders where o_custkey = c_custkey) as orders,
    (select count(*) from events where user_id = c_custkey) as events from customer""",
)
def _(spark, folder):
    users = table(spark, folder, "customer").select("c_custkey", "c_name")
    children = {"orders": (table(spark, folder, "orders"), "o_custkey"), "events": (table(spark, folder, "events"), "user_id")}
    return logs.with_child_counts(users, "c_custkey", children)


@query(
    "users_page",
    """with l as (select user_id, max(ts) t, count(*) n from events where event_type = 'signup' group by 1),
    p as (select c_custkey, c_name, t, coalesce(n, 0) n from customer left join l on user_id = c_custkey
      order by t desc nulls last, c_custkey desc limit 20 offset 20)
    select c_custkey, c_name, strftime(t, '%Y-%m-%d %H:%M:%S.%f') as last_login, n as login_count,
    (select count(*) from orders where o_custkey = c_custkey) as orders, (select count(*) from customer) as total,
    (select ceil(count(*) / 20)::bigint from customer) as pages from p""",
)
def _(spark, folder):
    users = table(spark, folder, "customer").select("c_custkey", "c_name")
    logins = table(spark, folder, "events").filter("event_type = 'signup'")
    found = logs.users_page(users, logins, {"orders": (table(spark, folder, "orders"), "o_custkey")}, 2, 20, "c_custkey")
    return found.withColumn("last_login", text_time("last_login"))


@query("user_activity_user", "select c_custkey as user_id, c_name, c_acctbal from customer where c_custkey = 7")
def _(spark, folder):
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_acctbal")
    return logs.user_activity(7, users, table(spark, folder, "events"), {})["user"]


@query(
    "user_activity_by_time",
    """select o_orderkey, o_totalprice, (select count(*) from lineitem where l_orderkey = o_orderkey) as children
    from (select * from orders where o_custkey = 7 order by o_orderdate desc, o_orderkey desc limit 20)""",
)
def _(spark, folder):
    o, li, log = (table(spark, folder, t) for t in ("orders", "lineitem", "events"))
    users = log.select("user_id").distinct()
    found = logs.user_activity(7, users, log, {"orders": (o, "o_custkey", "o_orderdate")}, {"orders": (li, "l_orderkey", "o_orderkey")})
    return found["orders"].select("o_orderkey", "o_totalprice", "children")


@query("user_activity_log", f"select {LOG_SQL} from (select * from events where user_id = 7 order by ts desc, event_id desc limit 50)")
def _(spark, folder):
    ev = table(spark, folder, "events")
    found = logs.user_activity(7, ev.select("user_id").distinct(), ev, {})
    return found["log"].select(*LOG_COLS, text_time("ts"))


@query(
    "user_activity_owned",
    """select o_orderkey, o_totalprice, (select count(*) from lineitem where l_orderkey = o_orderkey) as children
    from (select * from orders where o_custkey = 7 order by o_orderkey desc limit 20)""",
)
def _(spark, folder):
    o, li = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    log = table(spark, folder, "events")
    found = logs.user_activity(
        7, log.select("user_id").distinct(), log, {"orders": (o, "o_custkey", "o_orderkey")}, {"orders": (li, "l_orderkey", "o_orderkey")}
    )
    return found["orders"].select("o_orderkey", "o_totalprice", "children")


@query(
    "lists_with_child_counts",
    "select o_orderkey, o_custkey, count(l_orderkey) as items from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2",
)
def _(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return logs.with_child_counts(o, "o_orderkey", {"items": (table(spark, folder, "lineitem"), "l_orderkey")})


@query(
    "lists_with_parent_name",
    "select o_orderkey, o_totalprice, c_name as customer from orders left join customer on o_custkey = c_custkey and c_acctbal > 0",
)
def _(spark, folder):
    # Some orders then have no known customer.
    known = table(spark, folder, "customer").filter("c_acctbal > 0")
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return logs.with_parent_field(o, "o_custkey", known, "c_custkey", {"c_name": "customer"}).drop("o_custkey")


@query(
    "last_rows_per_parent",
    """select * from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc)::int as place
    from orders) where place <= 5""",
)
def _(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return logs.last_per_parent(o, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).drop("o_orderdate")


STEP_SQL = "case l_linenumber % 5 when 0 then 'cleaning' when 1 then 'eda' when 2 then 'modeling' when 3 then 'other' else 'cleaning' end"


@query(
    "step_categories",
    f"""with s as (select {STEP_SQL} c from lineitem), k as (select unnest(['cleaning', 'eda', 'visualization', 'modeling']) category)
    select category, (select count(*) from s where c = category) as steps, (select count(*) from s) as total_steps from k""",
)
def _(spark, folder):
    n = F.col("l_linenumber") % 5
    category = F.when(n == 0, "cleaning").when(n == 1, "eda").when(n == 2, "modeling").when(n == 3, "other").otherwise("cleaning")
    li = table(spark, folder, "lineitem")
    # Each row stores its list of one step as JSON text.
    lists = li.select(F.to_json(F.array(F.struct(F.lit("t").alias("tool"), category.alias("category")))).alias("steps"))
    return logs.step_categories(lists, "steps")


@query(
    "dashboard_totals",
    f"""select count(*) as total, count(case when status = 'completed' then 1 end) as completed, count(case when status = 'running' then 1 end) as running,
    count(case when status = 'failed' then 1 end) as failed from {JOBS}""",
)
def _(spark, folder):
    counts = logs.status_counts(jobs(spark, folder))
    pick = lambda s: F.sum(F.when(F.col("status") == s, F.col("count"))).alias(s)
    return counts.agg(F.sum("count").alias("total"), pick("completed"), pick("running"), pick("failed"))


@query("latest_activity", "select strftime(greatest((select max(ts) from events), (select max(o_orderdate) from orders)), '%Y-%m-%d %H:%M:%S.%f') as last_activity")
def _(spark, folder):
    found = logs.latest_activity([(table(spark, folder, "events"), "ts"), (table(spark, folder, "orders"), "o_orderdate")])
    return found.select(text_time("last_activity"))


@query(
    "status_counts",
    f"""select s as status, (select count(*) from {JOBS} where status = s) as count
    from (select unnest({list(logs.JOB_STATUSES)}) s)""",
)
def _(spark, folder):
    return logs.status_counts(jobs(spark, folder))


@query(
    "next_pending",
    f"""select o_orderkey, o_orderpriority, {text_time_sql('o_orderdate')} from (select * from {JOBS} where status = 'pending'
    order by o_orderpriority desc, o_orderdate, o_orderkey limit 10)""",
)
def _(spark, folder):
    found = logs.next_pending(jobs(spark, folder), priority="o_orderpriority", created="o_orderdate", key="o_orderkey")
    return found.select("o_orderkey", "o_orderpriority", text_time("o_orderdate"))


@query("ordered_messages", "select conv_id, turn, role, text from conversations where conv_id = 5 order by turn")
def _(spark, folder):
    return logs.ordered_messages(table(spark, folder, "conversations"), 5)


@query("message_sequence", "select conv_id, turn, role, row_number() over (partition by conv_id order by turn)::int as place from conversations")
def _(spark, folder):
    return logs.message_sequence(table(spark, folder, "conversations")).drop("text")


@query(
    "fuzzy_search",
    r"""with w as (select *, unnest(regexp_split_to_array(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^\p{L}\p{N}]+')) x from part where p_size >= 10)
    select distinct p_partkey, p_name, p_brand from w where levenshtein(x, 'widgit') <= 2 or levenshtein(x, 'rng') <= 1""",
)
def _(spark, folder):
    parts = table(spark, folder, "part").filter("p_size >= 10")
    return logs.fuzzy_search(parts, "widgit RNG", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name", "p_brand")


@query(
    "fuzzy_search_log",
    f"""select {LOG_SQL} from events where ts >= timestamp '2024-01-10 00:00:00' and user_id = 3
    and (levenshtein(event_type, 'purchse') <= 2)""",
)
def _(spark, folder):
    found = logs.fuzzy_search(table(spark, folder, "events"), "purchse", ["event_type"], {"user_id": 3}, datetime(2024, 1, 10))
    return found.select(*LOG_COLS, text_time("ts"))


@query(
    "fuzzy_search_all",
    r"""with w as (select *, unnest(regexp_split_to_array(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^\p{L}\p{N}]+')) x from part)
    select distinct p_partkey, p_name, p_brand from w where levenshtein(x, 'widgit') <= 2 or levenshtein(x, 'rng') <= 1""",
)
def _(spark, folder):
    return logs.fuzzy_search(table(spark, folder, "part"), "widgit RNG", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name", "p_brand")


@query(
    "fuzzy_search_page",
    f"""with w as (select * from events where levenshtein(event_type, 'purchse') <= 2)
    select {LOG_SQL}, (select count(*) from w) as total, (select ceil(count(*) / 25)::bigint from w) as pages
    from (select * from w order by ts desc, event_id desc limit 25 offset 25)""",
)
def _(spark, folder):
    found = logs.page_of(logs.fuzzy_search(table(spark, folder, "events"), "purchse", ["event_type"]), 2, 25)
    return found.select(*LOG_COLS, text_time("ts"), "total", "pages")


LOGINS = "select user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as last_login, count(*) as login_count from events where event_type = 'signup' group by 1"


@query("login_rollup", LOGINS)
def _(spark, folder):
    logins = table(spark, folder, "events").filter("event_type = 'signup'")
    return logs.login_rollup(logins).select("user_id", text_time("last_login"), "login_count")


@query(
    "daily_growth",
    f"""with d as (select ts::date as day, count(distinct user_id) u, count(*) e from events group by 1)
    select strftime(a.day, '%Y-%m-%d') as day, a.u as active_users, a.e as events, {rd('(a.e - b.e)::double / nullif(b.e, 0) * 100', 2)} as growth
    from d a left join d b on a.day = b.day + 7""",
)
def _(spark, folder):
    daily = logs.daily_usage(table(spark, folder, "events"))
    return logs.growth(daily, "events").withColumn("day", F.col("day").cast("string"))


def bodies(spark, folder):
    """Request bodies made from the log: a token at the top, a password one level down."""
    ev = table(spark, folder, "events")
    body = F.format_string(
        '{"user": %d, "AuthToken": "t-%d", "meta": {"password": "p%d", "kind": "%s"}, "list": [{"token": %d}]}',
        "user_id", "event_id", "user_id", "event_type", "user_id",
    )
    return ev.select("event_id", F.when(F.col("event_type") == "view", F.col("props")).otherwise(body).alias("body"))


@query(
    "redact_json",
    """select event_id, case when event_type = 'view' then props else '{"user":' || user_id || ',"AuthToken":"[REDACTED]","meta":{"password":"[REDACTED]","kind":"'
    || event_type || '"},"list":[{"token":' || user_id || '}]}' end as body from events""",
)
def _(spark, folder):
    rows = bodies(spark, folder)
    return rows.select("event_id", redact.redact_json(F.col("body"), compact=True).alias("body"))


@query(
    "redact_json_bytes",
    """select event_id, '{ "n": 1.10,' || chr(10) || '"token" : "[REDACTED]", "token":"[REDACTED]",  "kind": "' || event_type || '", "in": {"a":[{"ssn": 1}], "cookie": "[REDACTED]" }, "n": 1e5 }' as body
    from events""",
)
def _(spark, folder):
    """Numbers, spacing, repeated keys and arrays come out as they went in."""
    body = F.format_string('{ "n": 1.10,\n"token" : "%s\\"}", "token":{"id": [%d]},  "kind": "%s", "in": {"a":[{"ssn": 1}], "cookie": [%d, {}] }, "n": 1e5 }', "event_type", "user_id", "event_type", "user_id")
    return table(spark, folder, "events").select("event_id", redact.redact_json(body).alias("body"))


@query(
    "redact_typed",
    """select event_id, '[REDACTED]' as api_key, '{"cookie":"[REDACTED]","kind":"' || event_type || '","inner":{"ssn":"[REDACTED]","id":' || user_id || '}}' as body from events""",
)
def _(spark, folder):
    ev = table(spark, folder, "events")
    inner = F.struct(F.col("user_id").alias("ssn"), F.col("user_id").alias("id"))
    rows = ev.select("event_id", F.col("props").alias("api_key"), F.struct(F.col("props").alias("cookie"), F.col("event_type").alias("kind"), inner.alias("inner")).alias("body"))
    return redact.redact_table(rows).withColumn("body", F.to_json("body"))


@query(
    "shorten_fields",
    "select doc_id, substr(text, 1, 500) as text, nullif(n_chars % 4, 0) as status, nullif(case when doc_id % 3 = 0 then '' else lang end, '') as lang from documents",
)
def _(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", (F.col("n_chars") % 4).alias("status"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("lang")
    )
    return redact.shorten(docs, {"text": 500}, ["status", "lang"])


@query(
    "fuzzy_search_index",
    r"""with w as (select p_partkey, unnest(regexp_split_to_array(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^\p{L}\p{N}]+')) x from part)
    select distinct p_partkey, x as word, t as term from w, (values ('wigdet', 2), ('rgn', 1)) v(t, n) where damerau_levenshtein(x, t) <= n""",
)
def _(spark, folder):
    index = logs.fuzzy_index(table(spark, folder, "part"), "p_partkey", ["p_name", "p_brand", "p_type"])
    return logs.search_index(index, "wigdet RGN").withColumnRenamed("key", "p_partkey")


def rolling_sql(days: int) -> str:
    return f"(select count(distinct user_id) from events e where e.ts::date between d.day - {days - 1} and d.day)"


@query(
    "rolling_users",
    f"""with d as (select unnest(generate_series(min(ts)::date, max(ts)::date, interval 1 day))::date as day from events)
    select strftime(day, '%Y-%m-%d') as day, {rolling_sql(1)} as users_1, {rolling_sql(7)} as users_7, {rolling_sql(30)} as users_30 from d""",
)
def _(spark, folder):
    return logs.rolling_users(table(spark, folder, "events")).withColumn("day", F.col("day").cast("string"))
