"""Fuzzy search with swapped letters against the plain distance, and rolling users against sets."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemill.operators import logs
from tidemill.streaming import jobs


def alignment(a, b):
    """Optimal string alignment distance."""
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def words(rng, n, letters="abcd"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def test_close_words_are_those_of_the_plain_distance(spark):
    rng = random.Random(5)
    terms = ["ab", "rng", "abca", "abcab", "abcdba", "widget", "aabbcd"]
    pool = words(rng, 1500) + ["rgn", "wigdet", "iwdgte", "widgt", "wdiget", "widgxet", "iwdxget", "", "wwidegt"]
    frame = spark.createDataFrame([(w,) for w in pool], "w string")
    for t in terms:
        got = {r.w for r in frame.where(logs.close_to(F.col("w"), t)).collect()}
        assert got == {w for w in pool if alignment(w, t) <= logs.edits_allowed(t)}, t


def test_index_finds_what_every_row_compared_finds(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, 4)), rng.choice(["RNG-7", "wiDget", None, "x" * 40 + "y"])) for i in range(300)] + [(1000, None, None), (1001, "", "")]
    frame = spark.createDataFrame(rows, "id long, a string, b string")
    index = logs.fuzzy_index(frame, "id", ["a", "b"])
    for query in ("rgn abcda", "wigdet", "x" * 40, "ab"):
        assert {r.key for r in logs.search_index(index, query).collect()} == {r.id for r in logs.fuzzy_search(frame, query, ["a", "b"]).collect()}
    assert logs.search_index(index, " - ").count() == 0


def test_rolling_users_equal_sets(spark):
    rng = random.Random(7)
    start = date(2024, 3, 1)
    rows = [(rng.choice(["ann", "bob", "cid", "dan", None]), datetime(2024, 3, 1) + timedelta(days=rng.choice([0, 1, 2, 9, 10, 25]), hours=rng.randint(0, 23))) for _ in range(60)]
    got = {r.day: (r.users_1, r.users_3, r.users_8) for r in logs.rolling_users(spark.createDataFrame(rows, "user_id string, ts timestamp_ntz"), (3, 8)).collect()}
    known = [(u, t.date()) for u, t in rows if u]
    last = max(d for _, d in known)
    want = {}
    for i in range((last - min(d for _, d in known)).days + 1):
        day = min(d for _, d in known) + timedelta(days=i)
        want[day] = tuple(len({u for u, d in known if timedelta(0) <= day - d < timedelta(days=n)}) for n in (1, 3, 8))
    assert got == want and start in got
    assert logs.rolling_users(spark.createDataFrame([], "user_id string, ts timestamp_ntz")).collect() == []


def test_stream_hours_are_those_of_the_batch_in_any_zone(spark, tmp_path):
    rows = [(1, datetime(2024, 3, 1, 23, 30)), (2, datetime(2024, 3, 2, 0, 10))]
    spark.createDataFrame(rows, "k long, ts timestamp_ntz").selectExpr("k", "to_timestamp(cast(ts as string) || 'Z') as ts").write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        frame = spark.read.parquet(str(tmp_path / "in"))
        counts = jobs.hourly_stream(jobs.read_stream(spark, str(tmp_path / "in"), frame.schema), F.col("k") == 2)
        jobs.start_keyed(counts, str(tmp_path / "out"), str(tmp_path / "state"), None).awaitTermination()
        got = {tuple(r) for r in jobs.latest(spark, str(tmp_path / "out"), counts.schema, ["hour"]).collect()}
        assert got == {tuple(r) for r in logs.hourly(frame, F.col("k") == 2).collect()} == {("2024-03-01T23", 1, 0), ("2024-03-02T00", 1, 1)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
