"""Logs, redaction, files and streams."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.operators import logs, redact
from tidemill.sources import tables
from tidemill.streaming import jobs


def redacted(spark, texts, nested=True):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return [r["t"] for r in rows.select("id", redact.redact_json(F.col("t"), nested).alias("t")).orderBy("id").collect()]


def plain_redaction(value, nested=True):
    if not isinstance(value, dict):
        return value
    return {k: "[REDACTED]" if redact.is_sensitive(k) else plain_redaction(v) if nested else v for k, v in value.items()}


def test_redaction_is_recursive_but_leaves_arrays(spark):
    text = '{"a":1,"Password1":"x","in":{"my_token":{"k":2},"ok":[{"secret":1}]}}'
    got, same = redacted(spark, [text, "token is not json"])
    assert json.loads(got) == {"a": 1, "Password1": "[REDACTED]", "in": {"my_token": "[REDACTED]", "ok": [{"secret": 1}]}}
    assert same == "token is not json"
    assert json.loads(redacted(spark, ['{"in":{"token":1},"ssn":2}'], False)[0]) == {"in": {"token": 1}, "ssn": "[REDACTED]"}


def test_redaction_keeps_every_other_byte(spark):
    cases = {
        '{"n": 1.10,  "token" :\t"a\\"b" ,\n"n": 1e5}': '{"n": 1.10,  "token" :\t"[REDACTED]" ,\n"n": 1e5}',
        '{"token":1,"token":{"a":[{"x":"}"}]},"z":"\\u00e9"}': '{"token":"[REDACTED]","token":"[REDACTED]","z":"\\u00e9"}',
        '[{"token":1}]': '[{"token":1}]',
        '{"a":[1,{"secret":[2]}],"b":{"cookie":[1,[2]],"c":"secret"},"k":null}': '{"a":[1,{"secret":[2]}],"b":{"cookie":"[REDACTED]","c":"secret"},"k":null}',
        '{"Authorization":"Bearer x': '{"Authorization":"[REDACTED]"',
        '{"a":1,"secret":{"b":[1,': '{"a":1,"secret":"[REDACTED]"',
        '{"to\\u212aen":1,"\\u0053SN":true}': '{"to\\u212aen":"[REDACTED]","\\u0053SN":"[REDACTED]"}',
        'log "token": 5 {"x":{}}': 'log "token": 5 {"x":{}}',
        '{"x":"token: {","y":"\\\\"}': '{"x":"token: {","y":"\\\\"}',
        "": "", "}}token{": "}}token{", '{"token"}': '{"token"}',
    }
    assert redacted(spark, list(cases)) == list(cases.values())
    long = json.dumps({"x" * 50_000: "y" * 200_000, "in": {"token": "z" * 100_000}, "l": list(range(5_000))})
    assert json.loads(redacted(spark, [long])[0]) == plain_redaction(json.loads(long))


def test_redaction_equals_the_recursive_definition(spark):
    rng = random.Random(3)
    names = ["a", "b c", "Token", "x_ssn", "é", "apiKey", 'q"t', "n\\m"]

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind < 4:
            return rng.choice([1, 2.5, None, True, "token", 'a"b{', "", "\\", "[x]: ,"])
        size = rng.randrange(4)
        return [value(depth - 1) for _ in range(size)] if kind == 4 else {rng.choice(names): value(depth - 1) for _ in range(size)}

    values = [{rng.choice(names): value(4) for _ in range(rng.randrange(6))} for _ in range(400)] + [value(3) for _ in range(100)]
    texts = [json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])) for v in values]
    for nested in (True, False):
        assert [json.loads(t) for t in redacted(spark, texts, nested)] == [plain_redaction(v, nested) for v in values]


def test_redaction_needs_no_python_worker(spark):
    df = spark.createDataFrame([("{}",)], "t string").select(redact.redact_json(F.col("t")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_redact_json_column(spark):
    rows = [('{"token":"a b","x":"é"}',), ('{"x": 1}',), (None,), ('{"\\u0074oken":1}',)]
    df = spark.createDataFrame(rows, "body string")
    got = [r["b"] for r in df.select(redact.redact_json(F.col("body")).alias("b")).collect()]
    assert got[:3] == ['{"token":"[REDACTED]","x":"é"}', '{"x": 1}', None]
    # The escaped key keeps its bytes and still reads as the same key.
    assert got[3] == '{"\\u0074oken":"[REDACTED]"}' and json.loads(got[3]) == {"token": "[REDACTED]"}


def test_redact_by_schema(spark):
    df = spark.sql("select 1 as id, 'k' as api_key, named_struct('cookie', 1, 'in', named_struct('ssn', 2, 'v', 3)) as body union all select 2, 'x', null")
    first, second = redact.redact_table(df).orderBy("id").collect()
    assert first["api_key"] == "[REDACTED]" and first["body"]["cookie"] == "[REDACTED]" and first["body"]["in"]["v"] == 3
    assert second["body"] is None


def test_pages_do_not_overlap(spark):
    df = spark.range(105).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") % 7).cast("timestamp_ntz").alias("ts"))
    seen = [r["event_id"] for page in (1, 2, 3) for r in logs.page_of(df, page, 50).collect()]
    assert len(seen) == 105 and len(set(seen)) == 105
    last = logs.page_of(df, 1, 50).collect()[-1]
    after = [r["event_id"] for r in logs.page_after(df, last["ts"], last["event_id"], 50).collect()]
    assert after == seen[50:100]
    assert logs.page_of(df, 1, 50).first()["pages"] == 3


def test_fuzzy_edit_distance(spark):
    assert [logs.edits_allowed(t) for t in ("ab", "abc", "abcdef")] == [0, 1, 2]
    df = spark.createDataFrame([("user.login",), ("user.logout",), ("page.view",)], "action string")
    hit = lambda q: {r["action"] for r in df.filter(logs.fuzzy_match(["action"], q)).collect()}
    # A swap of neighbours is one edit.
    assert hit("lgoin") == {"user.login"} and hit("lgno") == set() and hit("logn") == {"user.login"} and hit("LOGOTU") == {"user.logout"}


def test_last_rows_filter_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("p"), "id")
    plan = logs.last_per_parent(df, "p", [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")


def test_range_filter_reaches_the_reader(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df = logs.filter_log(events, {"event_type": "click"}, start=datetime(2024, 1, 5)).select("user_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "GreaterThanOrEqual(ts" in plan


def test_csv_types_and_missing_words(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,name,score,flag,when,gap\n1,"Braund, ""Mr"" O",NA,True,1/2/1985,\n2,NaN,2.5,False,3/4/1985,\n')
    df = tables.read_csv(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "score": "double", "flag": "boolean", "when": "string", "gap": "double"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, 'Braund, "Mr" O', None, True, "1/2/1985", None), (2, None, 2.5, False, "3/4/1985", None),
    ]
    out = str(tmp_path / "out.csv")
    tables.write_csv(df, out)
    assert tables.infer_types(spark.read.option("header", True).option("escape", '"').csv(out)).count() == 2
    with pytest.raises(ValueError):
        tables.read_csv(spark, "table.xlsx")


def test_ingest_resumes_where_it_stopped(spark, tmp_path):
    source, sink, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    first = spark.range(10).select("id", F.lit("x" * 20).alias("token"))
    first.write.parquet(source)
    stream = lambda: jobs.sanitized(jobs.read_stream(spark, source, first.schema))
    jobs.start_ingest(stream(), sink, state, None).awaitTermination()
    spark.range(10, 15).select("id", F.lit("y").alias("token")).write.mode("append").parquet(source)
    jobs.start_ingest(stream(), sink, state, None).awaitTermination()
    out = spark.read.parquet(sink)
    assert out.count() == 15 and out.filter("token <> '[REDACTED]'").count() == 0


def test_hourly_stream_equals_batch_on_closed_hours(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    error = F.col("event_type") == "error"
    stream = jobs.hourly_stream(jobs.read_stream(spark, str(tmp_path / "in"), events.schema), error)
    jobs.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "state"), None).awaitTermination()
    closed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    every = {tuple(r) for r in logs.hourly(events, error).collect()}
    assert closed and closed <= every and len(every - closed) <= 3


def test_long_chat_is_numbered_across_partitions(spark):
    chat = F.when(F.col("id") % 4 > 0, 0).otherwise(F.col("id"))
    df = spark.range(2000).select(chat.alias("conv_id"), F.col("id").alias("turn")).repartition(11)
    got = logs.message_sequence(df).toPandas().sort_values(["conv_id", "turn"])
    assert (got["place"] == got.groupby("conv_id").cumcount() + 1).all()


def test_parent_fields_with_a_hot_parent_and_orphans(spark):
    fk = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, None).otherwise(F.col("id"))
    child = spark.range(5000).select("id", fk.alias("fk"))
    parent = spark.range(0, 5000, 2).select("id", F.concat(F.lit("p"), "id").alias("name")).union(spark.sql("select 7L, 'hot'"))
    got = logs.with_parent_field(child, "fk", parent, "id", {"name": "parent"}).orderBy("id").collect()
    want = child.join(parent.select(F.col("id").alias("k"), "name"), F.col("fk") == F.col("k"), "left").orderBy("id").collect()
    assert [(r["id"], r["parent"]) for r in got] == [(r["id"], r["name"]) for r in want]


def test_time_bounds_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("select timestamp_ntz '2024-01-30 12:00:00' as ts")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert logs.count_recent(df, datetime(2024, 1, 31, 12)).first()["count"] == 1
        assert logs.count_recent(df, datetime(2024, 1, 31, 12, 0, 1)).first()["count"] == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
