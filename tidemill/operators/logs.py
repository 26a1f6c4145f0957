"""Search, counts and rollups over activity logs and the tables around them.

Column names are arguments; the defaults fit a log with (event_id, ts, user_id, event_type).
Where the time matters, ``now`` is an argument, so that a result can be repeated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemill.functions.columns import name, require, share, tidy
from tidemill.functions.order import global_index, lookup_by_value
from tidemill.session import checkpointed

# Fixed values
JOB_STATUSES = ("pending", "running", "completed", "failed", "cancelled")
STEP_CATEGORIES = ("cleaning", "eda", "visualization", "modeling")


def time_literal(df: DataFrame, column: str, moment: datetime) -> Column:
    """A literal of the column's own type, so that the comparison reaches the file reader.

    It goes by way of text: a datetime literal would be shifted by the session time zone when the
    column has none.
    """
    return F.lit(moment.isoformat(sep=" ")).cast(df.schema[column].dataType)


def since(df: DataFrame, ts: str, now: datetime, hours: float) -> Column:
    return name(ts) >= time_literal(df, ts, now - timedelta(hours=hours))


def contains(column: str, text: str) -> Column:
    """Case-insensitive substring test."""
    return F.contains(F.lower(name(column).cast("string")), F.lit(text.lower()))


def filter_log(
    df: DataFrame,
    equals: Mapping[str, object] | None = None,
    containing: Mapping[str, str] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    search: str | None = None,
    search_in: Sequence[str] = (),
    ts: str = "ts",
) -> DataFrame:
    """Rows that meet every condition; ``search`` may appear in any of ``search_in``."""
    require(df, [*(equals or {}), *(containing or {}), *search_in, ts])
    for c, value in (equals or {}).items():
        df = df.filter(name(c) == F.lit(value))
    if start is not None:
        df = df.filter(name(ts) >= time_literal(df, ts, start))
    if end is not None:
        df = df.filter(name(ts) <= time_literal(df, ts, end))
    for c, text in (containing or {}).items():
        df = df.filter(contains(c, text))
    if search:
        hit = F.lit(False)
        for c in search_in:
            hit = hit | F.coalesce(contains(c, search), F.lit(False))
        df = df.filter(hit)
    return df


def page_of(df: DataFrame, page: int = 1, limit: int = 50, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """One page, newest first, with the total and the number of pages on each row."""
    if page < 1 or limit < 1:
        raise ValueError("page and limit start at 1")
    total = df.agg(F.count("*").alias("n")).scalar()
    rows = df.orderBy(F.desc(ts), F.desc(key)).offset((page - 1) * limit).limit(limit)
    return rows.withColumn("total", total).withColumn("pages", F.ceil(F.col("total") / F.lit(limit)).cast("long"))


def page_after(df: DataFrame, last_ts: datetime, last_key, limit: int = 50, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """The page that follows a known last row; its cost does not grow with the page number."""
    edge = time_literal(df, ts, last_ts)
    older = df.filter((name(ts) < edge) | ((name(ts) == edge) & (name(key) < F.lit(last_key))))
    return older.orderBy(F.desc(ts), F.desc(key)).limit(limit)


def recent(df: DataFrame, n: int = 30, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """The newest rows."""
    return df.orderBy(F.desc(ts), F.desc(key)).limit(n)


def count_recent(df: DataFrame, now: datetime, hours: float = 24, ts: str = "ts", where: Column | None = None) -> DataFrame:
    """Rows of the last hours, all or those that meet ``where``."""
    rows = df.filter(since(df, ts, now, hours))
    return (rows if where is None else rows.filter(where)).agg(F.count("*").alias("count"))


def top_keys(
    df: DataFrame, keys: Sequence[str], n: int = 10, now: datetime | None = None, hours: float = 24, ts: str = "ts"
) -> DataFrame:
    """The most frequent combinations of ``keys`` whose first key is present."""
    require(df, keys)
    if now is not None:
        df = df.filter(since(df, ts, now, hours))
    counts = df.filter(name(keys[0]).isNotNull()).groupBy(*[name(k) for k in keys]).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), *keys).limit(n)


def hourly(df: DataFrame, error: Column, now: datetime | None = None, hours: float = 24, ts: str = "ts") -> DataFrame:
    """Rows and errors per hour (UTC) that has any, oldest first."""
    if now is not None:
        df = df.filter(since(df, ts, now, hours))
    counts = df.groupBy(utc_hour(df, ts).alias("hour")).agg(F.count("*").alias("total"), F.count_if(error).alias("errors"))
    return counts.orderBy("hour")


def utc_hour(df: DataFrame, ts: str) -> Column:
    """The UTC hour of a time as text; times without a zone are taken as UTC."""
    t = name(ts)
    if isinstance(df.schema[ts].dataType, T.TimestampType):
        t = F.convert_timezone(F.current_timezone(), F.lit("UTC"), t.cast("timestamp_ntz"))
    return F.translate(F.substring(t.cast("timestamp_ntz").cast("string"), 1, 13), " ", "T")


def active_and_new_users(df: DataFrame, now: datetime, user: str = "user_id", ts: str = "ts", hours: float = 24, days: float = 7) -> DataFrame:
    """Users seen in the last hours, and users first seen in the last days."""
    seen = df.groupBy(name(user)).agg(F.max(ts).alias("last"), F.min(ts).alias("first"))
    return seen.agg(
        F.count("*").alias("total_users"),
        F.count_if(since(seen, "last", now, hours)).alias("active_users"),
        F.count_if(since(seen, "first", now, 24 * days)).alias("new_users"),
    )


def kpis(
    log: DataFrame,
    now: datetime,
    error: Column,
    tables: Mapping[str, DataFrame] | None = None,
    jobs: DataFrame | None = None,
    user: str = "user_id",
    ts: str = "ts",
    status: str = "status",
) -> DataFrame:
    """One row: user counts, requests, errors and error rate of the last day, table sizes, job counts."""
    users = active_and_new_users(log, now, user, ts).select(F.struct("total_users", "active_users", "new_users"))
    day = log.filter(since(log, ts, now, 24)).agg(
        F.count("*").alias("requests_24h"), F.count_if(error).alias("errors_24h")
    )
    rate = F.when(F.col("requests_24h") > 0, share(F.col("errors_24h"), F.col("requests_24h"))).otherwise(0.0)
    out = day.withColumn("error_rate", rate).withColumn("__u", users.scalar())
    out = out.select(F.col("__u.*"), *day.columns, "error_rate")
    for label, table in (tables or {}).items():
        out = out.withColumn(f"total_{label}", table.agg(F.count("*")).scalar())
    if jobs is not None:
        counted = jobs.agg(F.struct(*[F.count_if(name(status) == s).alias(f"jobs_{s}") for s in JOB_STATUSES]))
        out = out.withColumn("__j", counted.scalar()).select(*out.columns, F.col("__j.*"))
    return out


def with_child_counts(parent: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Each parent with the number of its rows in every child table.

    A child is counted by key before the join, so the join meets one row per key.
    """
    out = parent
    for label, (child, foreign) in children.items():
        counts = child.groupBy(name(foreign).alias("__key")).agg(F.count("*").alias("__n"))
        out = out.join(counts, name(key) == F.col("__key"), "left")
        out = out.select(*[name(c) for c in parent.columns if c in out.columns],
                         *[name(c) for c in out.columns if c not in parent.columns and not c.startswith("__")],
                         F.coalesce("__n", F.lit(0)).alias(label))
    return out


def with_parent_field(child: DataFrame, foreign: str, parent: DataFrame, key: str, fields: Mapping[str, str]) -> DataFrame:
    """Each child with fields of its parent, NULL when it has none.

    Children are counted per parent first, so that parents with very many of them can be joined
    apart from the rest.
    """
    counts = child.filter(name(foreign).isNotNull()).groupBy(name(foreign).alias("__fk")).agg(F.count("*").alias("__n"))
    side = parent.select(name(key).alias("__key"), *[name(f) for f in fields])
    side = side.join(counts, F.col("__key") == F.col("__fk"))
    return lookup_by_value(child, name(foreign), side, "__key", "__n", child.count(), dict(fields))


def last_per_parent(df: DataFrame, parent: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows per parent in ``order``.

    The rank filter is applied before the shuffle as well, so at most ``k`` rows per parent and
    task travel, also for a parent with very many rows.
    """
    rank = F.row_number().over(Window.partitionBy(name(parent)).orderBy(*order))
    return df.withColumn("place", rank).filter(F.col("place") <= k)


def user_activity(
    user_id, users: DataFrame, log: DataFrame, owned: Mapping[str, tuple[DataFrame, str, str]],
    children: Mapping[str, tuple[DataFrame, str, str]] | None = None, user: str = "user_id", ts: str = "ts", key: str = "event_id",
    log_limit: int = 50, owned_limit: int = 20,
) -> dict[str, DataFrame]:
    """One user's row, newest log rows and newest owned rows.

    ``owned`` maps a label to (table, user column, time column); ``children`` maps the same label to
    (child table, foreign key, key of the owned table), whose counts are then added.
    """
    out = {"user": users.filter(name(user) == F.lit(user_id))}
    out["log"] = recent(log.filter(name(user) == F.lit(user_id)), log_limit, ts, key)
    for label, (table, owner, when) in owned.items():
        rows = table.filter(name(owner) == F.lit(user_id))
        ties = [F.desc(children[label][2])] if children and label in children else []
        rows = rows.orderBy(F.desc(when), *ties).limit(owned_limit)
        if children and label in children:
            child, foreign, own_key = children[label]
            rows = with_child_counts(rows, own_key, {"children": (child, foreign)})
        out[label] = rows
    return out


def status_counts(df: DataFrame, status: str = "status", statuses: Sequence[str] = JOB_STATUSES) -> DataFrame:
    """Rows per status of a fixed list, zeros included, from one aggregate."""
    require(df, [status])
    wide = df.agg(*[F.count_if(name(status) == s).alias(f"s{i}") for i, s in enumerate(statuses)])
    rows = [F.struct(F.lit(s).alias("status"), F.col(f"s{i}").alias("count")) for i, s in enumerate(statuses)]
    return wide.select(F.inline(F.array(*rows)))


def next_pending(df: DataFrame, n: int = 10, status: str = "status", priority: str = "priority", created: str = "created_at", key: str | None = None) -> DataFrame:
    """Pending rows by highest priority, then oldest."""
    order = [F.desc(priority), F.asc(created)] + ([F.asc(key)] if key else [])
    return df.filter(name(status) == "pending").orderBy(*order).limit(n)


def step_categories(df: DataFrame, steps: str, categories: Sequence[str] = STEP_CATEGORIES) -> DataFrame:
    """Steps per fixed category in a column of JSON step lists, zeros included, and all steps."""
    parsed = F.from_json(name(steps), "array<struct<category string>>")
    each = df.select(F.explode(parsed).alias("s")).select(F.col("s.category").alias("category"))
    wide = each.agg(*[F.count_if(F.col("category") == c).alias(f"c{i}") for i, c in enumerate(categories)], F.count("*").alias("all"))
    rows = [F.struct(F.lit(c).alias("category"), F.col(f"c{i}").alias("steps"), F.col("all").alias("total_steps")) for i, c in enumerate(categories)]
    return wide.select(F.inline(F.array(*rows)))


def latest_activity(tables: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """The newest time over several tables."""
    parts = [df.agg(F.max(name(c)).cast("timestamp_ntz").alias("t")) for df, c in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.max("t").alias("last_activity"))


def ordered_messages(df: DataFrame, chat_id, chat: str = "conv_id", order: str = "turn") -> DataFrame:
    """The messages of one chat, oldest first."""
    return df.filter(name(chat) == F.lit(chat_id)).orderBy(order)


def message_sequence(df: DataFrame, chat: str = "conv_id", order: str = "turn") -> DataFrame:
    """All messages with their place in their chat, counted from 1.

    Messages are numbered over the whole table in range partitions; a chat's first number is then
    taken off. So no chat, however long, is brought into one task.
    """
    numbered = global_index(df, [chat, order], "__at")
    firsts = numbered.groupBy(name(chat).alias("__chat")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    out = lookup_by_value(numbered, name(chat), firsts, "__chat", "__n", numbered.count(), {"__first": "__first"})
    return out.select(*[name(c) for c in df.columns], (F.col("__at") - F.col("__first") + 1).cast("int").alias("place"))


def edits_allowed(term: str) -> int:
    """How many single-character edits a search term tolerates, by its length."""
    return 0 if len(term) < 3 else 1 if len(term) < 6 else 2


def search_terms(query: str) -> list[str]:
    return [t for t in "".join(ch if ch.isalnum() else " " for ch in query.lower()).split()]


def row_words(fields: Sequence[str]) -> Column:
    """The lower-case words of some fields."""
    return F.split(F.lower(F.concat_ws(" ", *[name(c).cast("string") for c in fields])), "[^\\p{L}\\p{N}]+")


def close_to(word: Column, term: str) -> Column:
    """True where the word becomes the term by no more edits than ``edits_allowed``: a letter put in, left out or
    replaced, or two neighbours swapped, of which neither is edited again (optimal string alignment)."""
    n = edits_allowed(term)
    if n == 0:
        return word == term
    hit = F.levenshtein(word, F.lit(term), n) >= 0
    swaps = [(term[:i], term[i + 1] + term[i], term[i + 2 :]) for i in range(len(term) - 1) if term[i] != term[i + 1]]
    if n == 1:
        return hit | word.isin([a + ab + b for a, ab, b in swaps])
    # One swap at a stated place, and one more edit on either side of it; a second swap is one of those.
    for a, ab, b in swaps:
        before, after = F.left(word, F.char_length(word) - len(ab + b)), F.substring(word, len(a + ab) + 1, 1 << 20)
        hit = hit | (F.endswith(word, F.lit(ab + b)) & (F.levenshtein(before, F.lit(a), 1) >= 0)) | (F.startswith(word, F.lit(a + ab)) & (F.levenshtein(after, F.lit(b), 1) >= 0))
    pairs = [term[:i] + term[i + 1] + term[i] + term[i + 2 : j] + term[j + 1] + term[j] + term[j + 2 :] for i in range(len(term) - 1) for j in range(i + 2, len(term) - 1)]
    return hit | word.isin(pairs) if pairs else hit


def fuzzy_match(fields: Sequence[str], query: str) -> Column:
    """True where any word of any field is close to any word of the query."""
    terms = search_terms(query)
    return F.exists(row_words(fields), lambda word: reduce(lambda a, b: a | b, [close_to(word, t) for t in terms], F.lit(False)))


def shortened(word: Column) -> Column:
    """The word and what is left of it without any one or two of its letters. Words within two edits of each other share one."""
    def less(w: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.char_length(w))))
        return F.when(F.char_length(w) > 0, cut).otherwise(F.array().cast("array<string>"))

    once = less(word)
    return F.array_distinct(F.concat(F.array(word), once, F.flatten(F.transform(once, less))))


#: Words up to this length are found by their shortened forms, whose number grows with its square; longer ones one by one.
INDEXED_LENGTH = 32


@dataclass
class FuzzyIndex:
    """Distinct words by the hashes of their shortened forms, and the rows that hold each word; both stored."""

    forms: DataFrame
    words: DataFrame
    postings: DataFrame


def fuzzy_index(df: DataFrame, key: str, fields: Sequence[str]) -> FuzzyIndex:
    """An index for many searches over one table, whose work follows its distinct words."""
    require(df, [key, *fields])
    postings = df.select(name(key).alias("key"), F.explode(F.array_distinct(row_words(fields))).alias("word")).where("word != ''")
    postings = checkpointed(postings.distinct())
    words = checkpointed(postings.select("word").distinct())
    short = words.where(F.char_length("word") <= INDEXED_LENGTH)
    forms = checkpointed(short.select("word", F.explode(F.transform(shortened(F.col("word")), lambda x: F.xxhash64(x))).alias("form")).distinct())
    return FuzzyIndex(forms, words, postings)


def search_index(index: FuzzyIndex, query: str) -> DataFrame:
    """(``key``, ``word``, ``term``) of the rows with a word close to a term of the query.

    Only words that share a shortened form with a term are compared with it.
    """
    spark = index.words.sparkSession
    terms = search_terms(query)
    if not terms:
        return index.postings.select("key", "word", F.col("word").alias("term")).limit(0)
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    own = asked.select("term", F.explode(F.transform(shortened(F.col("term")), lambda x: F.xxhash64(x))).alias("form"))
    # The forms of the few terms of one query.
    pairs = index.forms.join(F.broadcast(own), "form").select("word", "term").distinct()
    long = index.words.where(F.char_length("word") > INDEXED_LENGTH).select("word", F.explode(F.array(*[F.lit(t) for t in dict.fromkeys(terms)])).alias("term"))
    judged = reduce(lambda a, b: a | b, [(F.col("term") == t) & close_to(F.col("word"), t) for t in terms])
    found = pairs.unionByName(long).where(judged)
    return index.postings.join(found, "word").select("key", "word", "term")


def fuzzy_search(
    df: DataFrame, query: str, fields: Sequence[str], equals: Mapping[str, object] | None = None,
    start: datetime | None = None, end: datetime | None = None, ts: str = "ts", exact: bool = False,
) -> DataFrame:
    """Rows whose words match the query; the cheap filters run first. ``exact`` asks for substrings."""
    if exact:
        return filter_log(df, equals, None, start, end, query, fields, ts)
    for c, value in (equals or {}).items():
        df = df.filter(name(c) == F.lit(value))
    if start is not None or end is not None:
        df = filter_log(df, start=start, end=end, ts=ts)
    return df.filter(fuzzy_match(fields, query)) if query else df


def login_rollup(df: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Last login and number of logins per user."""
    return df.groupBy(name(user)).agg(F.max(ts).alias("last_login"), F.count("*").alias("login_count"))


def users_page(
    users: DataFrame, logins: DataFrame, children: Mapping[str, tuple[DataFrame, str]], page: int = 1, limit: int = 20,
    key: str = "user_id", user: str = "user_id", ts: str = "ts",
) -> DataFrame:
    """One page of users by last login, newest first, with counts, the total and the number of pages.

    Users who never logged in come last; equal times go by key, higher first. Counts are worked out
    for the users of the page only.
    """
    seen = login_rollup(logins, user, ts).withColumnRenamed(user, "__user")
    rows = users.join(seen, name(key) == F.col("__user"), "left").drop("__user")
    found = page_of(rows.withColumn("login_count", F.coalesce("login_count", F.lit(0))), page, limit, "last_login", key)
    return with_child_counts(found, key, children)


def daily_usage(df: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Active users and rows per day."""
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count_distinct(name(user)).alias("active_users"), F.count("*").alias("events"))


def growth(daily: DataFrame, value: str = "active_users", days: int = 7) -> DataFrame:
    """Percent change of a daily series against ``days`` earlier.

    The series has one row per day, and the earlier day is found by an equi-join on the date.
    """
    before = daily.select(F.date_add("day", days).alias("day"), name(value).alias("__before"))
    change = F.try_divide((name(value) - F.col("__before")).cast("double"), F.col("__before").cast("double")) * 100
    return daily.join(before, "day", "left").select(*daily.columns, tidy(change, 2).alias("growth"))


def rolling_users(df: DataFrame, windows: Sequence[int] = (7, 30), user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Distinct users of each day and of the last ``windows`` days, for every day from the first to the last, empty ones too.

    Users are numbered, and a day's users are bits of bitmaps, one for each range of numbers. A window is the union of its days'
    bitmaps, so rows are read once and no user is counted again for each window.
    """
    require(df, [user, ts])
    rows = df.select(name(user).alias("user"), F.to_date(name(ts)).alias("day")).where("user is not null and day is not null").distinct()
    rows = checkpointed(rows)
    numbered = checkpointed(global_index(rows.select("user").distinct(), ["user"], "number"))
    marked = rows.join(numbered, "user").select("day", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("bit"))
    days = checkpointed(marked.groupBy("day", "bucket").agg(F.bitmap_construct_agg("bit").alias("users")))
    spans = [1, *windows]

    def offsets(n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.lit(n).alias("span"), i.alias("off")))

    later = F.flatten(F.array(*map(offsets, spans)))
    spread = days.select("bucket", "users", "day", F.inline(later)).select("span", F.date_add("day", F.col("off")).alias("day"), "bucket", "users")
    counts = spread.groupBy("span", "day", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("users")).alias("n")).groupBy("span", "day").agg(F.sum("n").alias("n"))
    # One row per day from the first to the last.
    calendar = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    wide = counts.groupBy("day").agg(*[F.max(F.when(F.col("span") == n, F.col("n"))).alias(f"users_{n}") for n in spans])
    return calendar.join(wide, "day", "left").select("day", *[F.coalesce(f"users_{n}", F.lit(0)).alias(f"users_{n}") for n in spans])
