"""Keyed streams: merged batches, restarts, late rows and bounded state."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemill.streaming import jobs

SCHEMA = "user_id long, ts timestamp_ntz"
START = datetime(2024, 1, 1)


def land(spark, folder, days_and_users):
    rows = [(u, START + timedelta(days=d)) for d, u in days_and_users]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def counts(spark, source):
    return jobs.login_stream(jobs.read_stream(spark, source, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1))


def test_merged_batches_give_the_newest_rows_and_few_folders(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    expected = {}
    for run in range(3):  # each run goes on where the last one stopped
        for batch in range(3):
            users = [(run * 3 + batch, u) for u in range(batch, 20)]
            land(spark, source, users)
            for d, u in users:
                expected[u] = (START + timedelta(days=d), expected.get(u, (None, 0))[1] + 1)
        jobs.start_keyed(counts(spark, source), out, state, None, ["user_id"], every=2).awaitTermination()
        schema = counts(spark, source).schema
        got = {r.user_id: (r.last_login, r.login_count) for r in jobs.latest(spark, out, schema, ["user_id"]).collect()}
        assert got == expected
    assert len(list((tmp_path / "out").glob("batch=*"))) <= 4
    assert len(list((tmp_path / "out" / "_merged").glob("upto=*"))) <= 2
    # A merge that is tried again changes nothing; an unfinished one is not read.
    jobs.merge_batches(spark, out, schema, ["user_id"], 7)
    (tmp_path / "out" / "_merged" / "upto=7" / "_SUCCESS").unlink()
    got = {r.user_id: (r.last_login, r.login_count) for r in jobs.latest(spark, out, schema, ["user_id"]).collect()}
    assert got == expected


def test_nothing_written_is_an_empty_table(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v string").schema
    assert jobs.latest(spark, str(tmp_path / "none"), schema, ["k"]).count() == 0


def test_login_periods_drop_old_state_and_late_rows(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = lambda: jobs.login_periods(jobs.read_stream(spark, source, schema, 1), period="10 days")
    run = lambda: jobs.start_keyed(stream(), out, state, None, ["user_id", "since"], every=3)
    sizes = []
    for days in ([(0, u) for u in range(50)], [(30, 1), (31, 1)], [(60, 2)], [(61, 2), (0, 3)], [(90, 4)]):
        land(spark, source, days)
        query = run()
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    # Day 0 came again after its period was closed: left out. The state holds the last periods only.
    assert max(sizes) >= 50 and sizes[-1] <= 2
    totals = jobs.login_totals(jobs.latest(spark, out, stream().schema, ["user_id", "since"]))
    got = {r.user_id: (r.last_login.replace(tzinfo=None), r.login_count) for r in totals.filter(F.col("user_id").isin(1, 2, 3, 4, 9)).collect()}
    day = lambda d: START + timedelta(days=d)
    assert got == {1: (day(31), 3), 2: (day(61), 3), 3: (day(0), 1), 4: (day(90), 2), 9: (day(0), 1)}
    assert totals.count() == 50
