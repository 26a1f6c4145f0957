"""Streaming forms, run over everything that is in the folder."""

from pyspark.sql import functions as F

from tidemill.operators import features, modeling
from tidemill.queries.base import fresh_path, query, rd, table, text_time
from tidemill.queries.logs import HOURLY, LOGINS
from tidemill.streaming import jobs


def stream(spark, folder, name):
    """One table of the folder as a stream: a file source over the folder, limited to that file."""
    schema = table(spark, folder, name).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    return reader.parquet(folder)


def landed(spark, df, name):
    """Append the stream to a table and read that table."""
    path = fresh_path(spark, name)
    jobs.start_ingest(df, path, path + "-state", interval=None).awaitTermination()
    return spark.read.parquet(path)


def landed_by_key(spark, df, keys, name):
    """Keep the newest row of each key of a streaming aggregate and read that table."""
    path = fresh_path(spark, name)
    jobs.start_keyed(df, path, path + "-state", interval=None, keys=keys, every=2).awaitTermination()
    return jobs.latest(spark, path, df.schema, keys)


@query(
    "stream_ingest",
    """select event_id, user_id, substr(event_type, 1, 4) as event_type, nullif(value, 0.01) as value, '[REDACTED]' as session_token from events""",
)
def _(spark, folder):
    rows = stream(spark, folder, "events").select(
        "event_id", "user_id", "event_type", F.nullif("value", F.lit(0.01)).alias("value"), F.col("props").alias("session_token")
    )
    return landed(spark, jobs.sanitized(rows, limits={"event_type": 4}), "ingest")


@query("stream_hourly", f"{HOURLY} group by 1")
def _(spark, folder):
    counts = jobs.hourly_stream(stream(spark, folder, "events"), F.col("event_type") == "error")
    return landed_by_key(spark, counts, ["hour"], "hourly")


@query("stream_logins", LOGINS)
def _(spark, folder):
    logins = stream(spark, folder, "events").filter("event_type = 'signup'")
    out = landed_by_key(spark, jobs.login_stream(logins), ["user_id"], "logins")
    return out.select("user_id", text_time("last_login"), "login_count")


@query("stream_login_periods", LOGINS)
def _(spark, folder):
    logins = stream(spark, folder, "events").filter("event_type = 'signup'")
    out = landed_by_key(spark, jobs.login_periods(logins, period="7 days"), ["user_id", "since"], "login-periods")
    return jobs.login_totals(out).select("user_id", text_time("last_login"), "login_count")


@query(
    "stream_score",
    f"""with t as (select regr_slope(o_totalprice, o_custkey) b, regr_intercept(o_totalprice, o_custkey) a from orders
      where ('0x' || substr(md5('42|' || o_orderkey), 1, 8))::bigint / 4294967296.0 >= 0.2)
    select o_orderkey, {rd('a + b * o_custkey', 2)} as prediction from orders, t""",
)
def _(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    model = modeling.train_model(df, "o_totalprice", "linear_regression", key=["o_orderkey"], exclude=["o_orderkey"])
    scored = landed(spark, jobs.score_stream(stream(spark, folder, "orders"), model, ["o_orderkey"]), "scored")
    return scored.select("o_orderkey", F.round(F.round("prediction", 8), 2).alias("prediction"))


@query(
    "stream_transform",
    f"""with s as (select avg(ln(1 + value)) m, stddev_pop(ln(1 + value)) d from events)
    select event_id, {rd('(ln(1 + value) - m) / d', 6)} as value from events, s""",
)
def _(spark, folder):
    batch = table(spark, folder, "events").select("event_id", "value")
    fitted = [features.fit_log_transform(batch, "value")]
    fitted.append(features.fit_standard_scaler(fitted[0].apply(batch), ["value"]))
    out = landed(spark, jobs.transform_stream(stream(spark, folder, "events").select("event_id", "value"), fitted), "transformed")
    return out.select("event_id", F.round(F.round("value", 12), 6).alias("value"))
